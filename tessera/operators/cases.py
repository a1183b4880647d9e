"""Question sets: filters, resolution, sampling, resume, frozen ids, availability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.ranks import numbered


def matches(question: str | None = None, source: str | None = None, subset: list[str] | None = None, text: Column | None = None, ids: Column | None = None, sources: Column | None = None) -> Column:
    """Substring tests of a case: any subset part in its id, the question in text or
    id, the source in any of its sources; what is not given holds. Texts that case folding
    makes equal are alike."""
    has = lambda c, s: F.contains(X.casefolded(c), F.lit(s.casefold()))
    out = F.lit(True)
    if subset:
        out = out & reduce(lambda a, b: a | b, [F.contains(ids, F.lit(s)) for s in subset])
    if question:
        out = out & (has(text, question) | has(ids, question))
    if source:
        # One text of all sources: folded at once, and no source holds what divides them.
        if "\x1f" in source:
            return F.lit(False)
        out = out & has(F.array_join(sources, "\x1f"), source)
    return out


def ordered(df: DataFrame, seq: str) -> DataFrame:
    """df with _no, its place by the integer column seq (1, 2, …)."""
    return numbered(df.withColumn("_all", F.lit(0)), "_all", seq, "_no").withColumn("_no", F.col("_no") + 1).drop("_all")


def limited(df: DataFrame, seq: str, limit: int | None) -> DataFrame:
    """The first rows by seq; None is no limit, a negative one drops from the end."""
    if limit is None:
        return df
    if limit >= 0:
        return df.orderBy(seq).limit(limit)
    keep = df.agg(F.greatest(F.count(F.lit(1)) + limit, F.lit(0)).alias("_keep"))
    return ordered(df, seq).crossJoin(F.broadcast(keep)).where("_no <= _keep").drop("_no", "_keep")


def systematic(df: DataFrame, seq: str, every: int) -> DataFrame:
    """Every n-th row by seq, the first included."""
    return df if every <= 1 else ordered(df, seq).where((F.col("_no") - 1) % every == 0).drop("_no")


def resumed(cases: DataFrame, prior: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(carried forward, to run): prior rows that didn't fail are carried, skipped
    ones too."""
    done = prior.where(F.col("status") != "failed")
    return done, cases.join(done.select(key), key, "left_anti")


def overlaid(cases: DataFrame, prior: DataFrame, key: str, fresh: list[str], kept: list[str]) -> DataFrame:
    """cases with a prior prediction's kept columns; fresh columns win."""
    done = prior.where("prediction is not null").select(key, *[F.col(c).alias(f"_{c}") for c in kept])
    out = cases.join(done, key, "left").withColumn("carried_forward", F.col("_prediction").isNotNull() if "prediction" in kept else F.lit(False))
    return out.select(key, *fresh, *[F.col(f"_{c}").alias(c) for c in kept], "carried_forward")


def frozen(questions: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(selected rows, problems): every id must be there exactly once."""
    selected = questions.join(F.broadcast(ids.select(key)) if ids.isLocal() else ids.select(key), key, "left_semi")
    seen = ids.select(key).join(selected.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left")
    problems = seen.where("n is null or n > 1").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    return selected, problems


def availability(documents: DataFrame, catalog: DataFrame, reasons: DataFrame) -> DataFrame:
    """Per case: fatal (a document is not in the catalog), skipped with the reasons of
    all unusable documents, or runnable.

    documents (case_id, document_id), catalog (document_id), reasons (document_id, reason).
    """
    known = catalog.select("document_id").withColumn("_known", F.lit(True))
    rows = documents.join(known, "document_id", "left").join(reasons, "document_id", "left")
    out = rows.groupBy("case_id").agg(F.bool_or(F.col("_known").isNull()).alias("missing"), F.array_sort(F.collect_set(F.when(F.col("reason").isNotNull(), F.concat_ws(": ", "document_id", "reason")))).alias("reasons"))
    route = F.when(F.col("missing"), "fatal").when(F.size("reasons") > 0, "skipped").otherwise("runnable")
    return out.select("case_id", route.alias("route"), F.array_join("reasons", "; ").alias("reasons"))


def question_ids(stem: str, ranges: list[tuple[int, int]], spark) -> DataFrame:
    """Frozen ids of inclusive number ranges."""
    rows = spark.createDataFrame(ranges, "lo long, hi long")
    return rows.select(F.explode(F.sequence("lo", "hi")).alias("n")).select(F.format_string(stem + "%06d", "n").alias("question_id"))


def pruned_messages(rows: DataFrame, run: str, seq: str, role: str) -> DataFrame:
    """rows without the oldest group that an assistant message and the messages of
    other kinds up to the next user or assistant message make."""
    by = Window.partitionBy(run).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    head = F.col(role) == "assistant"
    out = rows.withColumn("_group", F.sum(head.cast("int")).over(by))
    last = F.max(F.when(F.col(role).isin("assistant", "user"), F.struct(F.col(seq), F.col(role)))).over(by)[role]
    out = out.withColumn("_last", F.coalesce(last, F.lit("")))
    return out.where(~((F.col("_group") == 1) & (F.col("_last") == "assistant"))).drop("_group", "_last")


def with_info(questions: DataFrame, info: DataFrame, key: str, seq: str) -> DataFrame:
    """questions with info, a struct of the other columns of info; of several rows of a
    key the last by seq, null where there is none."""
    fields = [c for c in info.columns if c not in (key, seq)]
    last = info.groupBy(key).agg(F.max_by(F.struct(*fields), seq).alias("info"))
    return questions.join(last, key, "left")


def with_files(questions: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """questions of which the file is listed in files (key)."""
    return questions.join(files.select(key).distinct(), key, "left_semi")


def selected(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """known rows of the wanted keys; wanted keys that are not known raise."""
    unknown = [r[0] for r in wanted.select(key).join(known.select(key), key, "left_anti").distinct().orderBy(key).head(10)]
    if unknown:
        raise ValueError(f"unknown {key}: {', '.join(map(str, unknown))}")
    return known.join(wanted.select(key).distinct(), key, "left_semi")


def first_order(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Distinct keys by their first place."""
    return rows.groupBy(key).agg(F.min(seq).alias(seq)).orderBy(seq, key)
