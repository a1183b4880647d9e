"""Running totals of groups of any size.

A window sorts a group in one task. Groups of more than ``MOST`` rows are cut into
segments instead: their rows are dealt by ranges of group and order, whatever columns
these are, and written once, so that both passes see the same segments. The first pass
totals each segment, the second runs within segments and adds what the earlier segments
of the group came to. Only the first group of a segment can have begun before it, so there
is one carry a segment at most, and carries can be sent to every task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import folder
from ..sources.tables import input_bytes

#: Rows of a group that one task may sort, and bytes of files that a row takes at least:
#: where the files below hold fewer, groups are not counted first.
MOST, ROW_BYTES = 1_000_000, 16

_AGGREGATES = {"sum": F.sum, "count": F.count, "max": F.max}
_JOINED = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b)}


def _plain(df: DataFrame, group: list[str], order: list, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    by = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: _AGGREGATES[kind](c).over(by) for name, (kind, c) in totals.items()})


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def running(df: DataFrame, group: list[str], order: list, totals: dict[str, tuple[str, Column]], most: int | None = None) -> DataFrame:
    """df with each of totals (name: kind and column; sum, count or max) over the rows of
    its group up to this one. order tells the rows of a group apart."""
    most = MOST if most is None else most
    spark = df.sparkSession
    if 0 < input_bytes(df) < most * ROW_BYTES:
        return _plain(df, group, order, totals)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    rows = sizes.agg(F.sum("_n")).head()[0]
    if not rows:
        return _plain(df, group, order, totals)
    at = folder(spark, "scan")
    sizes.select(*group).write.parquet(f"{at}/large")
    large = F.broadcast(spark.read.parquet(f"{at}/large"))  # rows / most groups at most
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2 * rows // most + 1)
    warm = df.join(large, _same(df, large, group), "left_semi")
    warm.repartitionByRange(parts, *group, *order).withColumn("_segment", F.spark_partition_id()).write.parquet(f"{at}/rows")
    cut = spark.read.schema(warm.withColumn("_segment", F.lit(0)).schema).parquet(f"{at}/rows")
    own = cut.groupBy(*group, "_segment").agg(*[_AGGREGATES[kind](c).alias(f"_{name}") for name, (kind, c) in totals.items()])
    before = Window.partitionBy(*group).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    joined = {name: F.max(f"_{name}") if kind == "max" else F.sum(f"_{name}") for name, (kind, _) in totals.items()}
    carry = own.select(*group, "_segment", F.row_number().over(Window.partitionBy(*group).orderBy("_segment")).alias("_place"), *[c.over(before).alias(f"_{name}") for name, c in joined.items()])
    carry = F.broadcast(carry.where("_place > 1").drop("_place"))
    local = _plain(cut, [*group, "_segment"], order, totals)
    held = local.join(carry, _same(local, carry, [*group, "_segment"]), "left")
    out = held.select(*[local[c] for c in df.columns], *[_JOINED[kind](local[name], carry[f"_{name}"]).alias(name) for name, (kind, _) in totals.items()])
    cold = _plain(df.join(large, _same(df, large, group), "left_anti"), group, order, totals)
    return cold.unionByName(out)
