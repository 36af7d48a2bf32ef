"""Log folders followed as a stream into a table of lines.

Each micro-batch is written under its own number, so a batch that runs again after a failure writes the same rows in the
same place. Beside its lines it leaves the state of all files: how often each was replaced and how many lines it has, so
that the next batch numbers on without reading lines again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import ship
from tidemark.sources.tail import LogTail

_STATE = "file string, generation int, n_lines bigint, batch bigint"


def follow(spark: SparkSession, path: str, suffix: str = ".log", **options: str) -> DataFrame:
    """A streaming DataFrame of the whole lines appended to the files of a folder."""
    ship(spark)
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(path=path, suffix=suffix, **options).load()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _state_before(spark: SparkSession, out: str, batch: int) -> DataFrame:
    if not _exists(spark, f"{out}/state"):
        return spark.createDataFrame([], _STATE)
    states = spark.read.schema(_STATE).parquet(f"{out}/state").where(F.col("batch") < batch)
    last = states.agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == F.lit(last)) if last is not None else states


def write_batch(rows: DataFrame, batch: int, out: str) -> None:
    """Lines of one batch with their numbers, and the state of all files after it."""
    spark = rows.sparkSession
    rows = rows.persist()
    try:
        before = _state_before(spark, out, batch)
        # lines are numbered within stretches, stretches one after the other from one small row each
        counts = rows.where("line is not null").groupBy("file", "stretch").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        replaced = rows.groupBy("file").agg(F.max("replaced").alias("replaced"))
        known = before.select("file", "generation", "n_lines").join(replaced, "file", "full_outer")
        anew = F.coalesce("replaced", F.lit(False))
        base = known.select(
            "file", (F.coalesce("generation", F.lit(0)) + anew.cast("int")).alias("generation"), F.when(anew, 0).otherwise(F.coalesce("n_lines", F.lit(0))).cast("bigint").alias("base")
        )
        starts = counts.withColumn("skipped", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(base, "file")
        place = F.row_number().over(Window.partitionBy("file", "stretch").orderBy("byte_offset"))
        lines = rows.where("line is not null").withColumn("_n", place).join(starts, ["file", "stretch"])
        lines = lines.select("file", (F.col("base") + F.col("skipped") + F.col("_n")).alias("line_no"), "byte_offset", "line", "generation")
        lines.write.mode("overwrite").parquet(f"{out}/lines/batch={batch}")
        after = base.join(counts.groupBy("file").agg(F.sum("n").alias("new")), "file", "left")
        after.select("file", "generation", (F.col("base") + F.coalesce("new", F.lit(0))).alias("n_lines")).write.mode("overwrite").parquet(f"{out}/state/batch={batch}")
    finally:
        rows.unpersist()


def into_table(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """All lines there are now; replays after a failure leave no double rows."""
    writer = lines.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, out))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_lines(spark: SparkSession, out: str) -> DataFrame:
    """(file, line_no, byte_offset, line) as the files are now: what was there before a file was replaced is left out."""
    lines = spark.read.parquet(f"{out}/lines")
    newest = _state_before(spark, out, 1 << 62).select("file", "generation")
    return lines.join(newest, ["file", "generation"]).select("file", "line_no", "byte_offset", "line")
