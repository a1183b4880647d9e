"""Continuous ingestion of chunk rows (an extension: the batch upsert as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store


def upsert_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> StreamingQuery:
    """Appends ids that target doesn't hold, batch by batch, until the source is read.

    A batch that is run again after a failure adds nothing twice, as its ids are
    held then.
    """

    def step(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("seq", F.monotonically_increasing_id())
        try:
            held = session.read.parquet(target)
        except Exception as e:  # the first batch: there is no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            held = session.createDataFrame([], batch.schema)
        store.insert_new(held, rows).drop("seq").write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_costs(steps: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls and cost by tool and time window of a stream of steps."""
    return steps.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost").alias("cost")).select(F.col("w.start").alias("start"), "tool", "calls", "cost")
