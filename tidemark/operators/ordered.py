"""Order-dependent columns over long sequences: solved block by block, the ends of blocks carried over.

A sequence (one file, say) may hold a third of all rows, so none is put into one window: rows are windowed within blocks
of consecutive positions, and one small row per block carries what later blocks need to know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192


def _blocks(df: DataFrame, part: str, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / block)).repartition(part, "_block")


def _carry(ends: DataFrame, part: str) -> DataFrame:
    before = Window.partitionBy(part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(part, "_block", F.last("_end", ignorenulls=True).over(before).alias("_before"))


def with_previous(df: DataFrame, part: str, order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds the value of the row before, in order, within the part; null for the first."""
    rows = _blocks(df, part, order, block)
    inner = Window.partitionBy(part, "_block").orderBy(order)
    rows = rows.withColumn("_own", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    ends = rows.groupBy(part, "_block").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_end"))
    joined = rows.join(_carry(ends, part), [part, "_block"])
    return joined.withColumn(out, F.coalesce("_own", "_before")["v"]).drop("_own", "_before", "_block")


def with_last(df: DataFrame, part: str, order: str, flag: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds the position of the last flagged row up to and with this one; null before the first."""
    rows = _blocks(df, part, order, block)
    inner = Window.partitionBy(part, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.last(F.when(F.col(flag), F.col(order)), ignorenulls=True).over(inner))
    ends = rows.groupBy(part, "_block").agg(F.max("_own").alias("_end"))
    joined = rows.join(_carry(ends, part), [part, "_block"])
    return joined.withColumn(out, F.coalesce("_own", "_before")).drop("_own", "_before", "_block")
