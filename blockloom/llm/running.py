"""Ranks and running sums inside groups of any size.

A group's rows are ordered by a uniform 63-bit random key. Equal ranges of the key make cells of CELL rows at most on
average, so a group that holds a third of all rows is spread over as many tasks as it needs: each cell is summed with
partial aggregation, the small table of cell sums gets the offsets, and only rows of one cell meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 4_096


def random_key(seed: int, *columns: str) -> Column:
    """A uniform non-negative 63-bit key from the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1)


def running(df: DataFrame, group: str, key: str, ties: list[str], value: Column, into: str, rows: int, cell_rows: int = CELL) -> DataFrame:
    """df with column into: the sum of value over the rows of its group that come before it by key, then ties.

    group is never null; rows is the number of rows of df, or an upper bound; key holds uniform non-negative 63-bit
    numbers. Rows that are equal in group, key and ties get their places among each other in any order.
    """
    cells = max(1, -(-rows // cell_rows))
    cell = F.expr(f"`{key}` div {-(-(1 << 63) // cells)}L") if cells > 1 else F.lit(0).cast("long")
    df = df.withColumns({"_v": value.cast("long"), "_cell": cell})
    sums = df.groupBy(group, "_cell").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_cell").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_inside", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(sums, [group, "_cell"])
    return out.withColumn(into, F.col("_inside") + F.col("_before")).drop("_v", "_cell", "_inside", "_before")
