"""Scoring of predictions and aggregation of scores, tokens and cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .scan import running

#: Statuses of a run that could not read its documents; a passing score.
OVERFLOW = ("context_overflow", "vision_unsupported")
PASSING = 0.7
MAX_CALLS, MAX_INPUT, STALE = 30, 500_000, 5
METRICS = ("accuracy", "token_f1", "anls")


def joined(gold: DataFrame, predictions: DataFrame, ignore_missing: bool = False) -> DataFrame:
    """gold with prediction and status; missing ones are '' or dropped."""
    out = gold.join(predictions.select("question_id", "prediction", "status"), "question_id", "inner" if ignore_missing else "left")
    out = out.withColumn("status", F.coalesce("status", F.lit("missing")))
    said = F.when(F.col("status").isin(*OVERFLOW), "CONTEXT_OVERFLOW").otherwise(F.coalesce("prediction", F.lit("")))
    return out.withColumn("prediction", said)


def scored(rows: DataFrame) -> DataFrame:
    """rows (gold, prediction, raw_format, verification_rule) with answer_format and METRICS."""
    kind = X.answer_type(F.col("raw_format"), F.col("verification_rule"))
    p, g = F.col("prediction"), F.col("gold")
    return rows.withColumn("answer_format", kind).withColumns({"accuracy": X.relaxed_accuracy(p, g, F.col("answer_format")), "token_f1": X.token_f1(p, g), "anls": X.anls(p, g)})


def bucket(rows: DataFrame, *keys: str) -> DataFrame:
    """Count and rounded means; an empty input gives zeros when there are no keys."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in METRICS])


def breakdowns(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """The bucket of each key of each dimension, in one pass and by dimension and key;
    arrays count for each of their entries, null, '' and an empty array are ``unknown``."""
    unknown = F.lit("unknown")
    filled = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, c).otherwise(F.array(unknown))
    pair = lambda name, c: F.transform(filled(c), lambda v: F.struct(F.lit(name).alias("dimension"), F.coalesce(F.nullif(v, F.lit("")), unknown).alias("key")))
    every = F.concat(*[pair(n, c) for n, c in dimensions.items()])
    return bucket(rows.select(F.explode(every).alias("d"), *METRICS).select("d.dimension", "d.key", *METRICS), "dimension", "key").orderBy("dimension", "key")


def report(rows: DataFrame, gold: DataFrame, predictions: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """An evaluation as (section, key, n, METRICS): counts of questions and predictions,
    the overall bucket and every breakdown, in report order.

    rows are the scored questions, gold and predictions have a question_id each.
    """
    ids = lambda df: df.select("question_id").distinct()
    number = lambda key, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("counts").alias("section"), F.lit(key).alias("key"), "n")
    counts = [
        number("gold", gold), number("prediction", predictions), number("evaluated", rows),
        number("missing_prediction", ids(gold).join(ids(predictions), "question_id", "left_anti")),
        number("extra_prediction", ids(predictions).join(ids(gold), "question_id", "left_anti")),
    ]
    none = {m: F.lit(None).cast("double") for m in METRICS}
    out = reduce(DataFrame.unionByName, counts).withColumns(none)
    overall = bucket(rows).select(F.lit("overall").alias("section"), F.lit("").alias("key"), "n", *METRICS)
    return out.unionByName(overall).unionByName(breakdowns(rows, dimensions).withColumnRenamed("dimension", "section"))


def last_wins(rows: DataFrame, key: str, seq: Column, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, seq).alias(value), F.count(F.lit(1)).alias("n_rows"))


def latest_success(rows: DataFrame, key: str, seq: Column, value: Column, failed: Column) -> DataFrame:
    """The first row of a key, replaced by the last that didn't fail."""
    good = F.max(F.when(~failed, F.struct(seq.alias("s"), value.alias("v"))))
    return rows.groupBy(key).agg(F.coalesce(good, F.min(F.struct(seq.alias("s"), value.alias("v"))))["v"].alias("value"))


def judge_metrics(rows: DataFrame) -> DataFrame:
    """Over completed rows: mean score, passes, failures, invalid schemas, tokens."""
    done = rows.where("status = 'completed'")
    return done.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("average_score"),
        F.count_if(F.col("score") >= PASSING).alias("passed"),
        F.count_if(F.col("score") < PASSING).alias("failed"),
        F.count_if(~F.col("schema_valid")).alias("schema_invalid"),
        *token_sums(),
    )


#: The kinds of tokens that runs count.
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def token_sums() -> list[Column]:
    """One sum a kind of tokens, 0 for none."""
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS]


def token_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """TOKENS of each group, and total_tokens."""
    return rows.groupBy(*keys).agg(*token_sums()).withColumn("total_tokens", reduce(lambda a, b: a + b, map(F.col, TOKENS)))


#: What becomes of a case.
STATUSES = ("completed", "failed", "skipped")


def run_status(rows: DataFrame) -> DataFrame:
    """How many cases there are of each of STATUSES, and in all."""
    return counted(rows, "status", STATUSES)


def per_document(rows: DataFrame, document: str) -> DataFrame:
    """(document, n): questions of each document, most first."""
    return rows.groupBy(document).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), document)


def submission_counts(rows: DataFrame) -> DataFrame:
    """What a submission's debug file counts, of rows (prediction, outcome,
    carried_forward, TOKENS)."""
    outcomes = [F.count_if(F.col("outcome") == v).alias(n) for v, n in zip(OUTCOMES, (*OUTCOMES[:4], "malformed_omitted", "runtime_error_omitted"), strict=True)]
    carried = F.coalesce("carried_forward", F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("selected"), F.count("prediction").alias("emitted"), *outcomes, F.count_if(carried).alias("carried_forward"), F.count_if(~carried).alias("rerun"), *[x.alias(f"total_{c}") for x, c in zip(token_sums(), TOKENS, strict=True)])


def in_order(rows: DataFrame, wanted: DataFrame, key: str, seq: str) -> DataFrame:
    """rows in the order of wanted (key, seq); what is not wanted goes."""
    return rows.join(wanted.select(key, seq), key).orderBy(seq).select(*rows.columns)


#: Characters of a question that a result keeps.
QUESTION_CHARS = 100


def error_results(rows: DataFrame, error: Column) -> DataFrame:
    """Result rows of cases that failed: test_id, the question's start, status, error."""
    question = F.substring("question", 1, QUESTION_CHARS)
    return rows.select("test_id", question.alias("question"), F.lit("failed").alias("status"), error.alias("error"))


def phase_costs(rows: DataFrame) -> DataFrame:
    """Calls, tokens and cost by phase, and ``total``."""
    out = rows.rollup("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost_usd"), F.grouping("tool").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "total").otherwise(F.col("tool")).alias("phase"), "calls", "tokens", "cost_usd")


def attributed(rows: DataFrame, group: str, seq: list[str], total: str) -> DataFrame:
    """An integer total of each group shared evenly, the rest to the first row."""
    by = Window.partitionBy(group)
    n, first = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(*seq)) == 1
    return rows.withColumn("share", F.expr(f"{total} div 1").cast("long")).withColumn("share", F.floor(F.col("share") / n) + F.when(first, F.col("share") % n).otherwise(0))


def subset_cost(rows: DataFrame, group: str, seq: list[str], selected: Column, tokens: list[str], time: str) -> DataFrame:
    """One row: what selected rows cost, by the tokens columns, total_tokens and time.

    A group's integer totals are shared evenly, the rest goes to its first row; time is
    shared in proportion. Groups are counted, not sorted.
    """
    first = F.min_by(F.struct(selected.alias("s")), F.struct(*seq))["s"]
    each = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.count_if(selected).alias("_k"), first.alias("_first"), *[F.max(c).alias(c) for c in (*tokens, time)])
    share = lambda c: F.floor(F.col(c) / F.col("_n")) * F.col("_k") + F.when(F.col("_first"), F.col(c) % F.col("_n")).otherwise(0)
    out = each.agg(*[F.coalesce(F.sum(share(c)), F.lit(0)).cast("long").alias(c) for c in tokens], F.coalesce(F.sum(F.col(time) * F.col("_k") / F.col("_n")), F.lit(0.0)).alias(time))
    return out.withColumn("total_tokens", reduce(lambda a, b: a + b, [F.col(c) for c in tokens]))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, id, n): what is only, or more often, on one side; one shuffle of counts."""
    sides = left.select("id", F.lit(1).alias("by")).unionByName(right.select("id", F.lit(-1).alias("by")))
    more = sides.groupBy("id").agg(F.sum("by").alias("by")).where("by <> 0")
    return more.select("id", F.abs("by").alias("n"), F.when(F.col("by") > 0, "missing").otherwise("extra").alias("side"))


def stale_streaks(rows: DataFrame, run: str, seq: list[str], key: str) -> DataFrame:
    """rows with step, grew and streak: steps in a row without a key not seen before."""
    first = F.row_number().over(Window.partitionBy(run, key).orderBy(*seq)) == 1
    out = running(rows.withColumn("grew", first & F.col(key).isNotNull()), [run], seq, {"step": ("count", F.lit(1))})
    out = running(out.withColumn("step", F.col("step").cast("int")), [run], seq, {"_grown": ("max", F.when(F.col("grew"), F.col("step")))})
    return out.withColumn("streak", (F.col("step") - F.coalesce("_grown", F.lit(0))).cast("long")).drop("_grown")


def budgets(rows: DataFrame, run: str, seq: list[str], calls: int = MAX_CALLS, most: int = MAX_INPUT) -> DataFrame:
    """rows with used and remaining budget and whether it is exceeded."""
    out = running(rows, [run], seq, {"used_calls": ("count", F.lit(1)), "used_tokens": ("sum", F.col("tokens"))})
    left = lambda limit, used: F.greatest(F.lit(0).cast("long"), F.lit(limit).cast("long") - F.col(used))
    return out.withColumns({"calls_left": left(calls, "used_calls"), "tokens_left": left(most, "used_tokens"), "exceeded": (F.col("used_calls") >= calls) | (F.col("used_tokens") >= most)})


def stop_reason(explicit: Column, exceeded: Column, stale: Column, steps: Column, most: int) -> Column:
    """Explicit, then budget, stale, iterations, none."""
    return F.coalesce(explicit, F.when(exceeded, "budget_exceeded").when(stale, "stale").when(steps >= most, "max_iterations").otherwise("none"))


def recovery_origin(stop_reason: Column, fallback_used: Column, raw: Column) -> Column:
    """How an answer came about: forced synthesis, fallback, repaired text, or direct."""
    broken = raw.isNotNull() & F.try_parse_json(raw).isNull()
    return F.when(F.contains(F.coalesce(stop_reason, F.lit("")), F.lit("forced_final_synthesis")), "recovered").when(F.coalesce(fallback_used, F.lit(False)), "recovered_fallback").when(broken, "recovered").otherwise("direct")


#: Outcomes of an answer, in the order of reports.
OUTCOMES = ("direct", "recovered", "recovered_fallback", "explicit_unanswerable", "malformed", "failed")


def outcome(error: Column, has_payload: Column, answer: Column, unanswerable: Column, origin: Column) -> Column:
    """Class of an answer: an error first, then what the payload says, then its origin."""
    said_none = answer.isNull() | F.coalesce(unanswerable, F.lit(False))
    return F.when(error, "failed").when(~has_payload, "malformed").when(said_none, "explicit_unanswerable").otherwise(origin)


def first_present(*columns: Column) -> Column:
    """The first of several aliases that is not null, else ''."""
    return F.coalesce(*columns, F.lit(""))


#: Names under which a result may hold its question, answers and status.
ALIASES = {"question": ("question",), "reference": ("gold_answer", "reference", "benchmark_answer", "golden_answer"), "generated": ("generated_answer", "generated", "mafin_answer", "answer")}


def normalised_results(rows: DataFrame) -> DataFrame:
    """rows with question, reference and generated of the first alias that is there and
    not null, else '', and status, else ``completed``."""
    said = {n: first_present(*[F.col(a).cast("string") for a in names if a in rows.columns]) for n, names in ALIASES.items()}
    status = F.coalesce(F.col("status"), F.lit("completed")) if "status" in rows.columns else F.lit("completed")
    return rows.withColumns({**said, "status": status})


def evaluation_route(question: Column, reference: Column, generated: Column) -> Column:
    """What happens to a result before judging: a missing question or answer fails it,
    a missing reference skips it."""
    return F.when(question == "", "failed").when(reference == "", "skipped").when(generated == "", "failed").otherwise("judge")


def counted(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count(F.lit(1)).alias("total"))
