"""Intermediate tables in the folder that all executors share.

Every multi-step operator cuts its lineage by writing a table below
``spark.checkpoint.dir`` and reading it again: a lost executor then costs the
running step only. The setting is read from the session. Where it is unset, a
session on a local master (a test, the bench) gets a folder of its own below the
system's temporary folder; on a cluster that is an error, since executors would not
see one another's files.

Tables are dropped by the operator as soon as no later step reads them; what a
result still reads goes when the application ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import input_bytes, spread


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = root + (os.pathsep + have if have else "")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else ""
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{tempfile.gettempdir()}/tessera-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Stage:
    """Tables of one run of one operator, each written once."""

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        fs, at = file_system(spark, self.root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Writes df and reads it back with the same schema, even when empty."""
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Deletes tables that no later step reads."""
        for table in tables:
            fs, at = file_system(self.spark, self.path(table))
            fs.delete(at, True)

    def keep(self, *tables: str) -> None:
        """Deletes all tables but these."""
        fs, at = file_system(self.spark, self.root)
        self.drop(*{x.getPath().getName() for x in fs.listStatus(at)} - set(tables))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, or columns of it, on all cores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(docs.select(*columns) if columns else docs)


#: Bits of the filter that `among` sends to all tasks (8 MB), and of a row of it.
FILTER_BITS, PAGE_BITS = 1 << 26, 1 << 15


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in wanted, and a few others: those whose hashed key is not
    in a bitmap of bounded size are left out, so that a join by key shuffles what it needs.

    No row with a wanted key is lost. Beyond some ten million keys the bitmap fills up and
    more rows of other keys stay; an exact join follows.
    """
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    page, bit = F.floor(at / PAGE_BITS).cast("int").alias("_page"), (at % PAGE_BITS).cast("int").alias("_bit")
    pages = wanted.where(F.col(key).isNotNull()).select(page, bit).repartition("_page").groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.select("*", page, bit).join(F.broadcast(pages), "_page").where(F.getbit(byte, F.col("_bit") % 8) == 1)
    return met.drop("_page", "_bit", "_bits")


#: Bytes of input files that one shard or one hash range is meant to hold.
SHARD_BYTES = 64 << 20


def n_shards(docs: DataFrame, most_bytes: int = SHARD_BYTES) -> int:
    """How many shards of about most_bytes the tables below docs make; the shuffle
    partitions at least, so that small inputs keep all cores busy."""
    return max(n_partitions(docs.sparkSession), input_bytes(docs) // most_bytes + 1)
