"""Operator 3: exact dedup with a persistent digest index (native).

The index is a folder of the shared store that outlives the session: two tables,
bucketed and sorted by the SHA-256 of a text. ``owners`` has one row a digest
(``digest binary, keep_id long``); ``counts`` has, for each batch, how many of its
rows hold a digest. A small file beside them says how many buckets there are, so
any later session opens the tables as they were written.

A batch is digested once and aggregated by digest before any shuffle of rows. Its
digests are anti-joined with ``owners`` by sort-merge (the index is read in its
buckets, without a shuffle) and what is new is appended; its counts are appended
too. One writer at a time; a batch that fails before its last append can be added
again under the same name, which adds nothing twice.

Defined results: a null text counts as empty, so null and '' are equal. A digest
that the index holds from an earlier batch keeps its first owner. Within a batch the
largest doc_id owns a text, and :func:`exact_dedup` adds the rows of a table in
batches of descending doc_id ranges, so that the largest doc_id of all stays.
Repeated rows with one doc_id count in group_size and are all marked alike; a group
whose doc_ids are all null has a null keep_id and keeps every row. Empty tables give
empty results. Only doc_id and text are read, so other columns of any name do not
matter.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Stage, file_system, n_partitions, shared_dir

#: A digest of more than this share of all rows is joined by broadcast: at most
#: 1 / HOT_SHARE digests can have so many, whatever the input.
HOT_SHARE = 0.001
#: Batches in which :func:`exact_dedup` adds a table to the index.
BATCHES = 2

_TABLES = {"owners": "digest binary, keep_id long", "counts": "digest binary, n long, batch string"}


def text_digest(text: Column) -> Column:
    """The binary SHA-256 of a whole text in UTF-8; a null one counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the digest of the text."""
    return docs.select(F.col(doc_id).alias("doc_id"), text_digest(F.col(text)).alias("digest"))


class DigestIndex:
    """The index below a path; opened if it is there, else made when first used."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex[:12]}").rstrip("/")
        held = self._described()
        if held and buckets not in (None, held["buckets"]):
            raise ValueError(f"the index has {held['buckets']} buckets")
        self.buckets = held["buckets"] if held else buckets or n_partitions(spark)
        if not held:
            self._describe()
        if path is None:
            fs, at = file_system(spark, self.path)
            fs.deleteOnExit(at)
        for table, schema in _TABLES.items():
            spark.sql(f"create table if not exists {self._name(table)} ({schema}) using parquet clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.path}/{table}'")

    def _name(self, table: str) -> str:
        """The tables' names in this session's catalog; the path decides them."""
        return f"digest_{table}_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"

    def _described(self) -> dict | None:
        fs, at = file_system(self.spark, f"{self.path}/index.json")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _describe(self) -> None:
        fs, at = file_system(self.spark, f"{self.path}/index.json")
        stream = fs.create(at, False)
        stream.write(bytearray(json.dumps({"buckets": self.buckets}).encode()))
        stream.close()

    def owners(self) -> DataFrame:
        """digest, keep_id."""
        return self.spark.table(self._name("owners"))

    def read(self) -> DataFrame:
        """digest, keep_id, group_size over all batches; joined bucket by bucket."""
        sizes = self.spark.table(self._name("counts")).groupBy("digest").agg(F.sum("n").alias("group_size"))
        return self.owners().hint("merge").join(sizes.hint("merge"), "digest")

    def _append(self, rows: DataFrame, table: str) -> None:
        out = rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
        out.option("path", f"{self.path}/{table}").mode("append").saveAsTable(self._name(table))

    def add(self, rows: DataFrame, batch: str | None = None) -> None:
        """Adds a batch of rows (doc_id, digest): owners of new digests, counts of all."""
        batch = batch or uuid.uuid4().hex
        counts = self.spark.table(self._name("counts"))
        if not counts.where(F.col("batch") == batch).isEmpty():
            return
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        new = groups.select("digest", "keep_id").hint("merge").join(self.owners().select("digest").hint("merge"), "digest", "left_anti")
        self._append(new, "owners")
        self._append(groups.select("digest", "n", F.lit(batch).alias("batch")), "counts")


def marked(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows (doc_id, digest) with keep_id, group_size and kept of held.

    Hot digests, of which there can be at most 1 / HOT_SHARE, are looked up by
    broadcast; all others by sort-merge with the buckets.
    """
    total = held.agg(F.sum("group_size").alias("n"))
    hot = held.join(F.broadcast(total), F.col("group_size") > F.col("n") * HOT_SHARE).select("digest", F.col("keep_id").alias("hot_keep"), F.col("group_size").alias("hot_size"))
    seen = rows.join(F.broadcast(hot), "digest", "left")
    cold = seen.where("hot_size is null").select("doc_id", "digest")
    cold = cold.hint("merge").join(held.hint("merge"), "digest")
    warm = seen.where("hot_size is not null").select("doc_id", "digest", F.col("hot_keep").alias("keep_id"), F.col("hot_size").alias("group_size"))
    both = warm.unionByName(cold.select(*warm.columns))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def descending_batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """rows (doc_id, …) in n ranges of doc_id, the largest ids first; null ids last."""
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)])).first()[0] if n > 1 else None
    limits = sorted(set(cuts or ()), reverse=True)
    above, out = F.lit(True), []
    for low in limits:
        own = F.coalesce(F.col("doc_id") >= low, F.lit(False))
        out.append(rows.where(above & own))
        above = ~own
    return [*out, rows.where(above)]


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept."""
    spark = docs.sparkSession
    stage = Stage(spark, "exact")
    rows = stage.save(digests(docs, doc_id, text), "digests")
    index = index or DigestIndex(spark)
    for batch in descending_batches(rows, batches):
        index.add(batch)
    return marked(rows, index.read())


def kept_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs of which doc_id and text are those of a row of kept (doc_id, digest)."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), text_digest(F.col("text")).alias("digest")).alias("d")
    keys = kept.select("doc_id", "digest").distinct().alias("k")
    same = F.col("d.id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.digest") == F.col("k.digest"))
    return rows.join(keys, same, "left_semi").select("doc.*")


def keep_first_owner(docs: DataFrame) -> DataFrame:
    """docs without the copies; all columns stay (pipeline stage)."""
    return kept_rows(docs, exact_dedup(docs).where("kept"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
select doc_id, max(doc_id) over (partition by sha) as keep_id, count(*) over (partition by sha) as group_size,
  doc_id = max(doc_id) over (partition by sha) as kept, sha as text_sha256
from (select doc_id, sha256(coalesce(text, '')) as sha from documents)
"""
