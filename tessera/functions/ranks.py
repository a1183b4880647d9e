"""Ranks that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one order-column range that get their numbers in one task, about.
RANGE = 4096


def numbered(df: DataFrame, group: str, order: str, name: str, kind: str = "long") -> DataFrame:
    """df with name = rank (from 0) by the integer column order within group.

    Two levels, so that a group with a third of all rows isn't sorted in one
    task: ranks within ranges of the order column, plus the rows of earlier
    ranges of the group. Ranges are as wide as the column is sparse.
    """
    span = df.agg(F.min(order).alias("_lo"), ((F.max(order) - F.min(order) + 1).cast("double") / F.count(order) * RANGE).alias("_wide"))
    known = df.crossJoin(F.broadcast(span)).withColumn("_range", F.floor((F.col(order) - F.col("_lo")) / F.col("_wide"))).drop("_lo", "_wide")
    sizes = known.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(group, "_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) - 1
    return known.withColumn(name, inside).join(offsets, [group, "_range"]).withColumn(name, (F.col(name) + F.col("_before")).cast(kind)).drop("_range", "_before")
