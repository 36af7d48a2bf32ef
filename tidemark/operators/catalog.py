"""Index maintenance as set operations on snapshots: upsert, change detection, prune, drift, tail plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the last by the given columns."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def changed(files: DataFrame, stored: DataFrame, key: str, hash_column: str) -> DataFrame:
    """Files whose hash differs from the stored one, and whether they are new."""
    known = stored.select(key, F.col(hash_column).alias("_stored"), F.lit(True).alias("_known"))
    joined = files.join(known, key, "left")
    return joined.where(~F.col(hash_column).eqNullSafe(F.col("_stored"))).withColumn("is_new", F.col("_known").isNull()).drop("_stored", "_known")


def prune(indexed: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Indexed rows whose file is no longer there."""
    return indexed.join(listing.select(key).distinct(), key, "left_anti")


def drift(catalog: DataFrame, partitions: DataFrame, key: str) -> DataFrame:
    """Names that only one side has, or whose counts differ."""
    a = catalog.select(key, F.lit(True).alias("in_catalog"))
    b = partitions.groupBy(key).agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("in_catalog").isNull(), "orphan").otherwise("ok")
    return a.join(b, key, "full_outer").select(key, F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def match_removed(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows of exactly this file; only where there are none, rows whose path ends with it or contains it."""
    hit = F.when(F.col(column) == name, 2).when(F.col(column).contains(name), 1).otherwise(0)
    best = rows.agg(F.max(hit).alias("_best"))
    return rows.withColumn("_hit", hit).join(best, (F.col("_hit") == F.col("_best")) & (F.col("_hit") > 0)).drop("_hit", "_best")


def tail_plan(size: Column, offset: Column) -> tuple[Column, Column]:
    """Byte to read on from and what to do: a file that shrank is read anew, one of the same size not at all."""
    action = F.when(size < offset, "replace").when(size == offset, "skip").otherwise("append")
    return F.when(size < offset, 0).otherwise(offset), action


def file_type(path: Column, types: dict[str, str], default: str) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))), F.lit(default))
