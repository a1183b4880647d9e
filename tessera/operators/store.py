"""Writing chunk rows: upserts, per-source replacement, migration of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def insert_new(held: DataFrame, batch: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Rows of batch to append: ids that are not held; of equal ids the first."""
    first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), seq).alias("r")).select("r.*")
    return first.join(held.select(key), key, "left_anti").select(*batch.columns)


def replaced(held: DataFrame, batch: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """held with batch over it; of equal ids of the batch the last."""
    last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), seq).alias("r")).select("r.*")
    return held.join(last.select(key), key, "left_anti").unionByName(last.select(*held.columns))


def replace_sources(path: str, rows: DataFrame) -> None:
    """Overwrites the partitions of the sources in rows and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_path").parquet(path)


def not_cached(sources: DataFrame, held: DataFrame) -> DataFrame:
    return sources.join(held.select("source_path").distinct(), "source_path", "left_anti")


def migrated(rows: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows under portable keys, conflicts) of legacy paths.

    Of the paths that share a portable key the key itself is preferred, else the
    smallest; all of them must hold the same multiset of payloads (compared by its size
    and two sums of 64-bit hashes, so a path's payloads are never gathered).
    """
    keyed = rows.withColumn("target", X.portable_key(F.col("source_path")))
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), F.to_json(F.struct(*payload))).cast("decimal(20,0)"))
    each = keyed.groupBy("target", "source_path").agg(F.count(F.lit(1)).alias("n"), total(0).alias("h"), total(1).alias("g")).select("target", "source_path", F.struct("n", "h", "g").alias("payload"))
    choice = each.groupBy("target").agg(F.min_by("source_path", F.struct((F.col("source_path") != F.col("target")).alias("o"), "source_path")).alias("chosen"), F.count_distinct("payload").alias("n_payloads"), F.count(F.lit(1)).alias("n_paths"))
    kept = keyed.join(choice.where("n_payloads = 1").select("target", F.col("chosen").alias("source_path")), ["target", "source_path"], "left_semi")
    return kept.withColumn("source_path", F.col("target")).drop("target"), choice.where("n_payloads > 1")
