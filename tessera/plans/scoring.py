"""Named scoring and aggregation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import scoring as S
from ..sources import tables as T

_NS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return T.qa(spark, d).select("question_id", X.normalised_answer(F.col("prediction")).alias("normalised"))


def extract_number(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("about $"), F.format_string("%.2f", "o_totalprice"), F.lit(" for "), F.col("o_orderkey").cast("string"))
    none = F.when(F.col("o_orderkey") % 5 == 0, F.lit("none")).otherwise(raw)
    return T.table(spark, d, "orders").select("o_orderkey", X.number(none).alias("number"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part")
    return p.select("p_partkey", F.col("p_name").alias("a"), F.concat(F.expr("substring(p_name, 2)"), F.lit(" "), F.substring("p_type", 1, 4)).alias("b"))


def anls_score(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("p_partkey", F.levenshtein("a", "b").alias("distance"), F.round(X.similarity(a, b), 6).alias("similarity"), F.round(X.anls(a, b), 6).alias("anls"))


def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return T.qa(spark, d).select("question_id", F.round(X.token_f1(F.col("prediction"), F.col("gold")), 6).alias("f1"))


def _rows(spark: SparkSession, d: str, ignore_missing: bool = False) -> DataFrame:
    qa = T.qa(spark, d)
    said = qa.where("answered").select("question_id", "prediction", F.when(F.col("question_id").endswith("13"), "context_overflow").otherwise("success").alias("status"))
    return S.scored(S.joined(qa.drop("prediction", "answered"), said, ignore_missing))


def relaxed_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("question_id", "answer_format", "status", "accuracy")


def eval_overall(spark: SparkSession, d: str) -> DataFrame:
    return S.bucket(_rows(spark, d))


def eval_ignore_missing(spark: SparkSession, d: str) -> DataFrame:
    return S.bucket(_rows(spark, d, True))


def _dimensions() -> dict:
    """The dimensions of a report; the question's key stands in for what parts lack."""
    one = lambda c: F.array(c)
    split = F.when(F.col("question_id").endswith("7"), "single_doc").otherwise("cross_doc")
    return {
        "split": one(split), "domain": one(F.col("domain")), "reasoning_type": one(F.element_at(F.split("reasoning_type", " "), 1)),
        "answer_format": one(F.nullif(F.col("raw_format"), F.lit("None"))), "difficulty": one(F.nullif(F.col("difficulty"), F.lit("0"))),
        "doc_type": one(F.upper("domain")), "evidence_source": F.when(F.col("difficulty") != "2", F.split("reasoning_type", " ")),
    }


def eval_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    return S.breakdowns(_rows(spark, d), _dimensions())


def _said(spark: SparkSession, d: str) -> DataFrame:
    return T.qa(spark, d).where("answered").select("question_id").unionByName(T.table(spark, d, "nation").select(F.concat(F.lit("x"), "n_nationkey").alias("question_id")))


def eval_report(spark: SparkSession, d: str) -> DataFrame:
    return S.report(_rows(spark, d, True), T.qa(spark, d), _said(spark, d), _dimensions())


def missing_extra_predictions(spark: SparkSession, d: str) -> DataFrame:
    qa, said = T.qa(spark, d), _said(spark, d)
    missing = qa.select("question_id").join(said, "question_id", "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(said.join(qa.select("question_id"), "question_id", "left_anti").withColumn("side", F.lit("extra")))


def prediction_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return S.last_wins(T.steps(spark, d), "key", F.struct("ts", "event_id"), "event_id")


def latest_successful(spark: SparkSession, d: str) -> DataFrame:
    s = T.steps(spark, d)
    failed = F.col("tool") == s.agg(F.max("tool").alias("t")).select("t").scalar()
    return S.latest_success(s, "run", F.struct("ts", "event_id"), F.col("event_id"), failed)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    l = T.table(spark, d, "labels")  # noqa: E741
    status = F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("completed")
    return l.select(status.alias("status"), (F.col("quality") * 0.8 + F.col("toxic") * 0.1).alias("score"), (F.col("toxic") == 0).alias("schema_valid"), (F.col("doc_id") * 3).alias("input_tokens"), F.col("doc_id").alias("output_tokens"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1).alias("cache_read_tokens"), F.lit(2).alias("cache_write_tokens"), "doc_id")


def judge_metrics(spark: SparkSession, d: str) -> DataFrame:
    return S.judge_metrics(_judged(spark, d))


def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.token_totals(_judged(spark, d), "status")


def run_status(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(spark, d)
    return S.run_status(rows.withColumn("status", F.when(F.col("doc_id") % 7 == 0, "skipped").otherwise(F.col("status"))))


def questions_per_document(spark: SparkSession, d: str) -> DataFrame:
    return S.per_document(T.qa(spark, d), "reasoning_type")


def expected_order(spark: SparkSession, d: str) -> DataFrame:
    """Results in the order in which their questions were asked for."""
    wanted = T.table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("q"), "p_partkey").alias("question_id"), (-F.col("p_partkey")).alias("place"))
    return S.in_order(T.qa(spark, d).select("question_id", "prediction"), wanted, "question_id", "place")


def score_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(spark, d).where("status = 'completed'")
    return rows.groupBy(X.status_label(F.col("score")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("key")
    raw = F.when(k % 4 == 0, "plain text").when(k % 4 == 1, '{"answer": 1}')
    origin = S.recovery_origin(F.when(k % 11 == 0, "forced_final_synthesis"), k % 13 == 0, raw)
    rows = T.steps(spark, d).withColumn("outcome", S.outcome(k % 17 == 1, k % 5 != 4, F.when(k % 3 != 1, F.col("tool")), k % 7 == 3, origin))
    return S.counted(rows, "outcome", S.OUTCOMES)


def submission_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("key")
    outcome = S.outcome(k % 17 == 1, k % 5 != 4, F.when(k % 3 != 1, F.col("tool")), F.lit(False), S.recovery_origin(F.lit(None), k % 13 == 0, F.lit(None)))
    rows = T.steps(spark, d).select(outcome.alias("outcome"), F.when(k % 3 > 0, F.col("tool")).alias("prediction"), (k % 4 == 0).alias("carried_forward"), F.col("tokens").alias("input_tokens"), k.alias("output_tokens"), F.lit(0).alias("cache_read_tokens"), F.when(k % 2 == 0, k).alias("cache_write_tokens"))
    return S.submission_counts(rows)


def evaluation_routes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = T.table(spark, d, "part")
    question, reference = S.first_present(F.when(k % 10 > 0, F.col("p_name"))), S.first_present(F.when(k % 7 > 0, F.col("p_type")), F.when(k % 14 == 0, F.col("p_brand")))
    return p.groupBy(S.evaluation_route(question, reference, S.first_present(F.when(k % 3 > 0, F.lit("x")))).alias("route")).agg(F.count(F.lit(1)).alias("n"))


#: JSON texts and, beside them, what they read as.
_VALUES = {"true": "True", "null": "", "1.0": "1.0", "17.40": "17.4", "-0.5": "-0.5", "1e2": "100.0", "0.00001": "1e-05", "0.0001": "0.0001", "12345678.25": "12345678.25", "1e16": "1e+16", "123456789012345.0": "123456789012345.0", "9007199254740993": "9007199254740993", "[1,2]": "[1, 2]"}


def string_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    more = F.when(k % 16 == 13, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(k % 16 == 14, F.concat(F.lit('{"b": "x, y: \\"z\\"", "a": '), "props", F.lit("}"))).otherwise(k.cast("string"))
    raw = F.when(k % 16 < len(_VALUES), F.try_element_at(F.array(*map(F.lit, _VALUES)), (k % 16 + 1).cast("int"))).otherwise(more)
    return T.table(spark, d, "events").select("event_id", X.string_value(F.parse_json(raw)).alias("value"))


def phase_cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return S.phase_costs(T.steps(spark, d))


def token_attribution(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "lineitem").join(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    # Line numbers repeat within an order, so ties are broken by all other keys.
    return S.attributed(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"], "cast(floor(o_totalprice) as bigint)").groupBy("l_orderkey").agg(F.sum("share").alias("tokens"), F.max("share").alias("largest"), F.min("share").alias("least"))


def token_subset_cost(spark: SparkSession, d: str) -> DataFrame:
    """What the returned lines cost of their orders' tokens and time."""
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor("o_totalprice").alias("prompt_tokens"), F.col("o_custkey").alias("completion_tokens"), (F.col("o_totalprice") / 100).alias("time"))
    rows = T.table(spark, d, "lineitem").join(o, "l_orderkey")
    seq = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"]
    found = S.subset_cost(rows, "l_orderkey", seq, F.col("l_returnflag") == "R", ["prompt_tokens", "completion_tokens"], "time")
    return found.withColumn("time", F.round("time", 2))


def tokens_per_question(spark: SparkSession, d: str) -> DataFrame:
    s = T.steps(spark, d).groupBy("run").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return s.agg(F.bround(F.coalesce(F.sum("tokens"), F.lit(0)) / n, 0).cast("long").alias("tokens_per_question"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)) / n, 6).alias("cost_per_question"))


def multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    got = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return S.multiset_difference(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), got)


def stale_streak(spark: SparkSession, d: str) -> DataFrame:
    rows = S.stale_streaks(T.steps(spark, d), "run", ["ts", "event_id"], "key")
    stop = F.min(F.when((F.col("streak") >= S.STALE) & (F.col("step") >= 2), F.col("step")))
    return rows.groupBy("run").agg(F.max("streak").cast("long").alias("longest"), stop.cast("long").alias("stop_step"), F.count_if("grew").alias("distinct_keys"))


def budget_cutoff(spark: SparkSession, d: str) -> DataFrame:
    rows = S.budgets(T.steps(spark, d), "run", ["ts", "event_id"])
    return rows.groupBy("run").agg(F.min(F.when(F.col("exceeded"), F.col("used_calls"))).alias("stop_call"), F.min("calls_left").alias("calls_left"), F.min("tokens_left").alias("tokens_left"))


def stop_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = S.stale_streaks(S.budgets(T.steps(spark, d), "run", ["ts", "event_id"]), "run", ["ts", "event_id"], "key")
    runs = rows.groupBy("run").agg(F.max("exceeded").alias("exceeded"), F.max((F.col("streak") >= 2) & (F.col("step") >= 2)).alias("stale"), F.count(F.lit(1)).alias("steps"))
    explicit = F.when(F.col("run") % 9 == 0, "submitted")
    return runs.select("run", S.stop_reason(explicit, F.col("exceeded"), F.col("stale"), F.col("steps"), 8).alias("reason"))


def doc_id_sha1(spark: SparkSession, d: str) -> DataFrame:
    c = T.chunks(spark, d)
    title = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("section_title"))
    return c.select("id", X.chunk_identity(F.col("source_kind"), F.col("source_path"), F.col("chunk_index"), F.col("section_id"), title).alias("identity"))


def fake_embed(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "benchmark").select("item_id", F.posexplode(V.hash_embedding(F.col("text"))).alias("j", "x"))
    return rows.select("item_id", F.col("j").cast("long").alias("j"), F.round("x", 6).alias("x"))


def document_uuid(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "nation").select("n_name", X.name_uuid(_NS, F.col("n_name")).alias("uuid"))


_DAMAGE = ("concat('```json\n', props, ',\n```')", "substring(props, 1, length(props) - 1)", "concat('// note\n', props)", "concat('[', props)", "props", "'not json'")


def json_clean_repair(spark: SparkSession, d: str) -> DataFrame:
    damaged = F.element_at(F.array(*[F.expr(x) for x in _DAMAGE]), (F.col("event_id") % 6 + 1).cast("int"))
    value = X.parsed_json(damaged)
    k = F.coalesce(F.try_variant_get(value, "$.k", "bigint"), F.try_variant_get(value, "$[0].k", "bigint"))
    return T.table(spark, d, "events").select("event_id", k.alias("k"), F.schema_of_variant(value).isNotNull().alias("parsed"))


_LET = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _norm(c: str) -> str:
    last = "trim(regexp_replace(regexp_replace(regexp_replace(n4, '[^\\w\\s.%-]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
    out = last
    for i, p in reversed(list(enumerate(X.PREFIXES, 1))):
        out = _LET(f"case when starts_with(n{i}, '{p}') then {_STRIP(f'substr(n{i}, {len(p) + 1})')} else n{i} end", f"n{i + 1}", out)
    return _LET(f"lower({_STRIP(c)})", "n1", out)


_NUM = lambda c: f"try_cast(nullif(regexp_extract(regexp_replace({c}, '[, ]', '', 'g'), '[-+]?\\d*\\.?\\d+'), '') as double)"


def _sim(a: str, b: str) -> str:
    x, y = f"lower({_STRIP(a)})", f"lower({_STRIP(b)})"
    return f"case when {x} = '' and {y} = '' then 1.0 when {x} = '' or {y} = '' then 0.0 else 1 - levenshtein({x}, {y}) / greatest(length({x}), length({y})) end::double"


_HAS = lambda c, words: "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"
_TYPE = "case raw_format " + " ".join(f"when '{k}' then '{v}'" for k, v in X.FORMATS.items()) + " else lower(raw_format) end"
_EVAL = f"""{T.QA_SQL},
said as (select question_id, prediction as pr, case when question_id like '%13' then 'context_overflow' else 'success' end as st from qa where answered),
j as (select question_id, domain, reasoning_type, raw_format, difficulty, gold, {_TYPE} as answer_format, coalesce(st, 'missing') as status,
  case when st in ('context_overflow', 'vision_unsupported') then 'CONTEXT_OVERFLOW' else coalesce(pr, '') end as prediction from qa {{how}} join said using (question_id)),
n as (select *, {_norm("prediction")} as p, {_norm("gold")} as g from j),
t as (select *, {_NUM("p")} as np, {_NUM("g")} as ng, case when {_HAS("p", X.YES)} then true when {_HAS("p", X.NO)} then false end as yes,
  list_filter(list_distinct(string_split(p, ' ')), lambda x: x <> '') as tp, list_filter(list_distinct(string_split(g, ' ')), lambda x: x <> '') as tg from n),
s as (select *, case when answer_format = 'unanswerable' then {_HAS("p", X.UNANSWERABLE)}
    when answer_format = 'boolean' then coalesce(yes = {_HAS("g", X.YES)}, false)
    when answer_format in ('numeric', 'percentage') and np is not null and ng is not null then case when ng = 0 then abs(np) < 1e-6 else abs(np - ng) / abs(ng) <= 0.05 end
    else (g <> '' and contains(p, g)) or {_sim("p", "g")} >= 0.8 end::int::double as accuracy,
  {_sim("prediction", "gold")} as sim, len(list_intersect(tp, tg)) as both_n from t),
r as (select *, case when sim >= 0.5 then sim else 0.0 end as anls,
  case when len(tg) = 0 then case when len(tp) = 0 then 1.0 else 0.0 end when len(tp) = 0 or both_n = 0 then 0.0 else 2 * (both_n / len(tp)) * (both_n / len(tg)) / (both_n / len(tp) + both_n / len(tg)) end::double as token_f1 from s)"""
_MEANS = ", ".join(f"round(coalesce(avg({m}), 0.0), 6) as {m}" for m in S.METRICS)
_LEFT, _INNER = _EVAL.format(how="left"), _EVAL.format(how="inner")
_M = "accuracy, token_f1, anls from r"
_EACH = f"""e0 as (select 'split' as dimension, case when question_id like '%7' then 'single_doc' else 'cross_doc' end as key, {_M} union all select 'domain', domain, {_M} union all select 'reasoning_type', string_split(reasoning_type, ' ')[1], {_M}
  union all select 'answer_format', nullif(raw_format, 'None'), {_M} union all select 'difficulty', nullif(difficulty, '0'), {_M} union all select 'doc_type', upper(domain), {_M}
  union all select 'evidence_source', unnest(case when difficulty <> '2' then string_split(reasoning_type, ' ') else ['unknown'] end), {_M}),
e as (select dimension, coalesce(nullif(key, ''), 'unknown') as key, accuracy, token_f1, anls from e0)"""
_STALE = f"""{T.STEPS_SQL}, f as (select *, row_number() over (partition by run order by ts, event_id) as step, key is not null and row_number() over (partition by run, key order by ts, event_id) = 1 as grew from steps {{where}}),
i as (select *, sum(grew::int) over (partition by run order by ts, event_id) as island from f),
k as (select *, sum((not grew)::int) over (partition by run, island order by ts, event_id) as streak from i)"""
_JUDGED = "j as (select case when doc_id % 11 = 0 then 'failed' else 'completed' end as status, quality * 0.8::double + toxic * 0.1::double as score, toxic = 0 as valid, doc_id * 3 as i, doc_id as o, case when doc_id % 2 = 0 then doc_id + 1 end as cr, 2 as cw, doc_id from labels)"
_SUMS = ", ".join(f"coalesce(sum({a}), 0)::bigint as {b}" for a, b in zip(("i", "o", "cr", "cw"), S.TOKENS, strict=True))

QUERIES = {f.__name__: f for f in (normalize_answer, extract_number, anls_score, token_f1, relaxed_accuracy, eval_overall, eval_ignore_missing, eval_breakdowns, eval_report, missing_extra_predictions, prediction_last_wins, latest_successful, judge_metrics, token_totals, run_status, questions_per_document, expected_order, score_labels, outcome_counts, submission_counts, evaluation_routes, string_values, phase_cost_rollup, token_attribution, token_subset_cost, tokens_per_question, multiset_diff, stale_streak, budget_cutoff, stop_reasons, doc_id_sha1, fake_embed, document_uuid, json_clean_repair)}

ORACLE_SQL = {
    "normalize_answer": f"with {T.QA_SQL} select question_id, {_norm('prediction')} as normalised from qa",
    "extract_number": f"select o_orderkey, {_NUM('case when o_orderkey % 5 = 0 then chr(110) || chr(111) else concat(chr(36), printf(chr(37) || chr(46) || chr(50) || chr(102), o_totalprice), chr(32), o_orderkey) end')} as number from orders".replace("concat(chr(36), ", "concat('about $', ").replace(", chr(32), o_orderkey", ", ' for ', o_orderkey"),
    "anls_score": f"with x as (select p_partkey, p_name as a, substr(p_name, 2) || ' ' || substr(p_type, 1, 4) as b from part), s as (select *, {_sim('a', 'b')} as s from x) select p_partkey, levenshtein(a, b)::int as distance, round(s, 6) as similarity, round(case when s >= 0.5 then s else 0.0 end, 6) as anls from s",
    "token_f1": f"with {T.QA_SQL}, t as (select question_id, list_filter(list_distinct(string_split({_norm('prediction')}, ' ')), lambda x: x <> '') as p, list_filter(list_distinct(string_split({_norm('gold')}, ' ')), lambda x: x <> '') as g from qa), b as (select *, len(list_intersect(p, g)) as n from t) select question_id, round(case when len(g) = 0 then case when len(p) = 0 then 1.0 else 0.0 end when len(p) = 0 or n = 0 then 0.0 else 2 * (n / len(p)) * (n / len(g)) / (n / len(p) + n / len(g)) end::double, 6) as f1 from b",
    "relaxed_accuracy": f"with {_LEFT} select question_id, answer_format, status, accuracy from r",
    "eval_overall": f"with {_LEFT} select count(*) as n, {_MEANS} from r",
    "eval_ignore_missing": f"with {_INNER} select count(*) as n, {_MEANS} from r",
    "eval_breakdowns": f"with {_LEFT}, {_EACH} select dimension, key, count(*) as n, {_MEANS} from e group by all",
    "eval_report": f"""with {_INNER}, {_EACH}, said2 as (select question_id from qa where answered union all select 'x' || n_nationkey from nation),
c as (select 'gold' as key, count(*) as n from qa union all select 'prediction', count(*) from said2 union all select 'evaluated', count(*) from r
  union all select 'missing_prediction', count(*) from qa anti join said2 using (question_id) union all select 'extra_prediction', count(*) from said2 anti join qa using (question_id))
select 'counts' as section, key, n, null::double as accuracy, null::double as token_f1, null::double as anls from c
union all select 'overall', '', count(*), {_MEANS} from r union all select dimension, key, count(*), {_MEANS} from e group by dimension, key""",
    "missing_extra_predictions": f"with {T.QA_SQL}, s as (select question_id from qa where answered union all select 'x' || n_nationkey from nation) select question_id, 'missing' as side from qa anti join s using (question_id) union all select question_id, 'extra' from s anti join qa using (question_id)",
    "prediction_last_wins": f"with {T.STEPS_SQL} select key, arg_max(event_id, (ts, event_id)) as event_id, count(*) as n_rows from steps group by key",
    "latest_successful": f"with {T.STEPS_SQL} select run, coalesce(arg_max(event_id, (ts, event_id)) filter (tool <> (select max(tool) from steps)), arg_min(event_id, (ts, event_id))) as value from steps group by run",
    "judge_metrics": f"with {_JUDGED} select count(*) as evaluated, round(coalesce(avg(score), 0.0), 6) as average_score, count(*) filter (score >= 0.7) as passed, count(*) filter (score < 0.7) as failed, count(*) filter (not valid) as schema_invalid, {_SUMS} from j where status = 'completed'",
    "token_totals": f"with {_JUDGED}, s as (select status, {_SUMS} from j group by 1) select *, input_tokens + output_tokens + cache_read_tokens + cache_write_tokens as total_tokens from s",
    "run_status": f"with {_JUDGED}, s as (select case when doc_id % 7 = 0 then 'skipped' else status end as status from j) select " + ", ".join(f"count(*) filter (status = '{v}') as {v}" for v in S.STATUSES) + ", count(*) as total from s",
    "questions_per_document": f"with {T.QA_SQL} select reasoning_type, count(*) as n from qa group by 1",
    "expected_order": f"with {T.QA_SQL} select question_id, prediction from qa where substr(question_id, 2)::int % 3 <> 0",
    "score_labels": f"with {_JUDGED} select case when score >= 0.7 then 'PASS' else 'FAIL' end as label, count(*) as n from j where status = 'completed' group by 1",
    "outcome_counts": f"""with {T.STEPS_SQL}, o as (select case when key % 17 = 1 then 'failed' when key % 5 = 4 then 'malformed' when key % 3 = 1 or key % 7 = 3 then 'explicit_unanswerable' when key % 11 = 0 then 'recovered' when key % 13 = 0 then 'recovered_fallback' when key % 4 = 0 then 'recovered' else 'direct' end as o from steps)
select """ + ", ".join(f"count(*) filter (o = '{v}') as {v}" for v in S.OUTCOMES) + ", count(*) as total from o",
    "evaluation_routes": "select case when p_partkey % 10 = 0 then 'failed' when p_partkey % 7 = 0 and p_partkey % 14 <> 0 then 'skipped' when p_partkey % 3 = 0 then 'failed' else 'judge' end as route, count(*) as n from part group by 1",
    "string_values": "select event_id, case event_id % 16 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(_VALUES.values())) + """ when 13 then event_type when 14 then '{"a": ' || replace(replace(replace(props, ' ', ''), ':', ': '), ',', ', ') || ', "b": "x, y: \\"z\\""}' else event_id::varchar end as value from events""",
    "submission_counts": f"""with {T.STEPS_SQL}, o as (select *, case when key % 17 = 1 then 'runtime_error_omitted' when key % 5 = 4 then 'malformed_omitted' when key % 3 = 1 then 'explicit_unanswerable' when key % 13 = 0 then 'recovered_fallback' else 'direct' end as o from steps)
select count(*) as selected, count(*) filter (key % 3 > 0) as emitted, """ + ", ".join(f"count(*) filter (o = '{v}') as {v}" for v in ("direct", "recovered", "recovered_fallback", "explicit_unanswerable", "malformed_omitted", "runtime_error_omitted")) + """, count(*) filter (key % 4 = 0) as carried_forward, count(*) filter (key % 4 <> 0 or key is null) as rerun,
  sum(tokens)::bigint as total_input_tokens, sum(key)::bigint as total_output_tokens, 0::bigint as total_cache_read_tokens, sum(case when key % 2 = 0 then key end)::bigint as total_cache_write_tokens from o""",
    "document_uuid": f"with h as (select n_name, sha1(unhex('{_NS.replace('-', '')}') || n_name::blob) as h from nation) select n_name, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), lower(to_hex((('0x' || substr(h, 17, 2))::int & 63) | 128)) || substr(h, 19, 2), substr(h, 21, 12)) as uuid from h",
    "phase_cost_rollup": f"with {T.STEPS_SQL} select case when grouping(tool) = 1 then 'total' else tool end as phase, count(*) as calls, sum(tokens)::bigint as tokens, round(sum(cost), 6) as cost_usd from steps group by rollup (tool)",
    "token_subset_cost": """with t as (select l_orderkey, floor(o_totalprice)::bigint as p, o_custkey as c, o_totalprice / 100 as t, l_returnflag = 'R' as sel, count(*) over (partition by l_orderkey) as n,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) as r from lineitem join orders on o_orderkey = l_orderkey),
s as (select p // n + case when r = 1 then p % n else 0 end as p, c // n + case when r = 1 then c % n else 0 end as c, t / n as t from t where sel)
select sum(p)::bigint as prompt_tokens, sum(c)::bigint as completion_tokens, round(sum(t), 2) as time, (sum(p) + sum(c))::bigint as total_tokens from s""",
    "token_attribution": "with t as (select l_orderkey, floor(o_totalprice)::bigint as total, count(*) over (partition by l_orderkey) as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as r from lineitem join orders on o_orderkey = l_orderkey), s as (select l_orderkey, total // n + case when r = 1 then total % n else 0 end as share from t) select l_orderkey, sum(share)::bigint as tokens, max(share) as largest, min(share) as least from s group by 1",
    "tokens_per_question": f"with {T.STEPS_SQL}, r as (select run, sum(tokens) as t, sum(cost) as c from steps group by 1) select round_even(coalesce(sum(t), 0) / greatest(count(*), 1), 0)::bigint as tokens_per_question, round(coalesce(sum(c), 0.0) / greatest(count(*), 1), 6) as cost_per_question from r",
    "multiset_diff": "with e as (select o_orderkey as id from orders), g as (select l_orderkey as id from lineitem) select id, count(*) as n, 'missing' as side from (select id from e except all select id from g) group by id union all select id, count(*), 'extra' from (select id from g except all select id from e) group by id",
    "stale_streak": f"with {_STALE.format(where='')} select run, max(streak)::bigint as longest, min(step) filter (streak >= 5 and step >= 2) as stop_step, count(*) filter (grew) as distinct_keys from k group by run",
    "budget_cutoff": f"with {T.STEPS_SQL}, u as (select run, count(*) over w as c, sum(tokens) over w as t from steps window w as (partition by run order by ts, event_id)) select run, min(c) filter (c >= 30 or t >= 500000) as stop_call, min(greatest(0, 30 - c)) as calls_left, min(greatest(0, 500000 - t))::bigint as tokens_left from u group by run",
    "stop_reasons": f"with {_STALE.format(where='')}, b as (select *, count(*) over w as c, sum(tokens) over w as t from k window w as (partition by run order by ts, event_id)), r as (select run, bool_or(c >= 30 or t >= 500000) as ex, bool_or(streak >= 2 and step >= 2) as stale, count(*) as n from b group by run) select run, case when run % 9 = 0 then 'submitted' when ex then 'budget_exceeded' when stale then 'stale' when n >= 8 then 'max_iterations' else 'none' end as reason from r",
    "doc_id_sha1": f"with {T.CHUNKS_SQL} select id, sha1(concat_ws('::', source_kind, source_path, chunk_index, section_id, case when doc_id % 4 = 0 then 'None' else section_title end)) as identity from chunks",
    "fake_embed": "with e as (select item_id, list_transform(range(64), lambda j: ('0x' || substr(sha256(text), (2 * (j % 32) + 1)::bigint, 2))::int / 255.0::double * 2 - 1) as v from benchmark), n as (select item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from e) select item_id, unnest(range(64)) as j, round(unnest(v) / n, 6) as x from n",
    "json_clean_repair": "select event_id, case when event_id % 6 = 5 then null else (props->>'$.k')::bigint end as k, event_id % 6 <> 5 as parsed from events",
}
