"""Writers of artifacts. Each writes a folder; names follow ``base/run_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the per-question table, in order.
PER_QUESTION = ("question_id", "answer_format", "status", "prediction", "gold", "accuracy", "token_f1", "anls")


def output_dir(base: str, run_id: str | None, group_by_run: bool = True) -> str:
    return f"{base.rstrip('/')}/{run_id}" if group_by_run and run_id else base.rstrip("/")


def submission(rows: DataFrame, path: str) -> int:
    """question_id and prediction of rows that have one; writes nothing when none has."""
    told = rows.where(F.col("prediction").isNotNull()).select("question_id", "prediction")
    n = told.count()
    if n:
        told.write.mode("overwrite").json(path)
    return n


def debug(counts: DataFrame, path: str, **metadata) -> None:
    """One JSON row beside a submission: its counts (see ``scoring.submission_counts``)
    and what else is told."""
    counts.withColumns({"debug_schema_version": F.lit(1), **{k: F.lit(v) for k, v in metadata.items()}}).coalesce(1).write.mode("overwrite").json(path)


def report(rows: DataFrame, path: str) -> None:
    """An evaluation report (see ``scoring.report``) as one JSON object: counts, overall
    and breakdowns by dimension and key."""
    metrics = F.struct("n", "accuracy", "token_f1", "anls")
    entries = lambda c, v: F.map_from_entries(F.array_sort(F.collect_list(F.when(c, F.struct("key", v.alias("v"))))))
    group = rows.where("section not in ('counts', 'overall')").groupBy("section").agg(entries(F.lit(True), metrics).alias("v"))
    every = F.map_from_entries(F.collect_list(F.struct("section", "v")))
    ordered = lambda m: F.map_from_entries(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k, m[k])))
    breakdowns = group.agg(every.alias("m")).select(ordered(F.col("m")).alias("breakdowns"))
    head = rows.agg(entries(F.col("section") == "counts", F.col("n")).alias("counts"), F.max(F.when(F.col("section") == "overall", metrics)).alias("overall"))
    head.crossJoin(breakdowns).coalesce(1).write.mode("overwrite").json(path)  # one row each


def summary(rows: DataFrame) -> str:
    """One line a column of a one-row aggregate, for a console."""
    return "\n".join(f"{k.replace('_', ' ').capitalize()}: {v}" for k, v in rows.first().asDict().items())


def split_logs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without logs, (test_id, agentic_log, agentic_debug) where either is there)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    logs = rows.where(filled("agentic_log") | filled("agentic_debug")).select("test_id", "agentic_log", "agentic_debug")
    return rows.drop("agentic_log", "agentic_debug"), logs


def per_question(rows: DataFrame, path: str) -> None:
    rows.select(*PER_QUESTION).write.mode("overwrite").option("header", True).csv(path)


def results(rows: DataFrame, metrics: DataFrame, path: str, **metadata) -> None:
    """One JSON row of metadata and metrics, and the result rows beside it."""
    head = metrics.withColumns({k: F.lit(v) for k, v in metadata.items()})
    head.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    rows.write.mode("overwrite").json(f"{path}/results")


def frozen(rows: DataFrame, seq: str, path: str) -> None:
    """Selected rows as JSON lines in source order; one small file by design."""
    rows.orderBy(seq).select(F.to_json(F.struct(*[c for c in rows.columns if c != seq])).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append(rows: DataFrame, path: str) -> None:
    """Adds JSON lines as files of their own, so a record that a broken writer left
    unfinished never runs into a new one; ``tolerant`` skips it."""
    rows.write.mode("append").json(path)


def tolerant(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def emptied(spark, paths: dict[str, str]) -> list[str]:
    """Overwrites each Parquet table that is there with an empty one; their names."""
    done = []
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name, path in paths.items():
        at = hadoop.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            schema = spark.read.parquet(path).schema
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
            done.append(name)
    return done


def predictions(rows: DataFrame, path: str) -> None:
    """Answered questions as JSON lines that ``files.predictions`` reads: question_id,
    prediction, status and whatever else rows have; a question without a prediction has ''
    and the status it came with, or failed."""
    blank = F.col("prediction").isNull()
    status = F.coalesce("status", F.when(blank, "failed").otherwise("success")) if "status" in rows.columns else F.when(blank, "failed").otherwise("success")
    rows.withColumns({"status": status, "prediction": F.coalesce("prediction", F.lit(""))}).write.mode("overwrite").json(path)
