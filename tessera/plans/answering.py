"""Named queries of answering, stitching and reshaping with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fragments as G
from ..functions import text as X
from ..operators.answering import Answers
from ..operators.answering import judged as J
from ..sources import shared
from ..sources import tables as T
from .scoring import _NS as NAMESPACE


def _speaker(broken: bool):
    """Answers with a question's first word; while broken, some raise or say nothing."""

    def ask(row: dict) -> dict:
        if broken and row["qid"] % 5 == 1:
            raise ValueError(f"no answer to {row['qid']}")
        return {"answer": "" if broken and row["qid"] % 5 == 2 else row["question"].split()[0], "loops": 1, "input_tokens": len(row["question"])}

    return ask


def answer_resume(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over the benchmark's items: of the first some fail; the second answers these
    and the ones that the first's limit left out, and no other again."""
    q = T.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    n = q.count()
    answers, who = Answers(spark, shared.folder(spark, "answers")), {"answer_model": "first word", "data_fingerprint": "1"}
    answers.run(q, lambda: _speaker(True), who, limit=n - n // 4, size=max(1, n // 3))
    answers.run(q, lambda: _speaker(False), who, size=max(1, n // 3))
    tries = answers.rows().groupBy("qid").agg(F.count(F.lit(1)).alias("tries"), F.max("error").alias("first_error"))
    return answers.latest().join(tries, "qid").select("qid", "pred_answer", "input_tokens", "tries", "first_error")


def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Parts as cases; the judge's replies are JSON, JSON in a fence, words, cut JSON, noise."""
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_type").alias("question"), F.col("p_name").alias("reference"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("generated"))
    return J(p, lambda: _judge).select("case_id", "score", F.col("reasoning").alias("reasoning"))


def _judge(prompt: str) -> str:
    lines = dict(x.split(": ", 1) for x in prompt.split("\n")[:3])
    same = str(lines["Answer"] == lines["Reference answer"]).lower()
    form = len(lines["Question"]) % 5
    if form == 4:
        raise ValueError("the judge is away")
    return [f'{{"correct": {same}, "reasoning": "by name"}}', f'```json\n{{"correct": {same}, "reasoning": "fenced"}}\n```', f"I think that is {same}.", f'{{"correct": {same}, "reasoning": "cut", "more": "te'][form]


def toc_stitch(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as a table of contents in JSON, cut into three fragments that
    repeat a little, some of them fenced, and stitched again."""
    o = T.table(spark, d, "orders")
    entry = F.struct(F.col("o_orderkey").cast("string").alias("structure"), F.concat("o_orderpriority", F.lit(' "{}] '), F.col("o_orderstatus")).alias("title"), F.dayofmonth("o_orderdate").alias("page"))
    whole = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("table_of_contents"))).alias("t"))
    third, twice = F.floor(F.length("t") / 3).cast("int"), F.floor(F.length("t") * 2 / 3).cast("int")
    fence = lambda c: F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("```json\n"), c, F.lit("\n```"))).otherwise(c)
    parts = F.array(F.substr("t", F.lit(1), third), fence(F.substr("t", third - 19, twice - third + 20)), fence(F.substr("t", F.when(F.col("o_custkey") % 3 == 0, twice + 1).otherwise(twice - 29))))
    found = whole.select("o_custkey", F.explode(G.contents(G.stitched(parts))).alias("e"))
    return found.select("o_custkey", "e.structure", "e.title", "e.page")


def question_reshape(spark: SparkSession, d: str) -> DataFrame:
    """Question rows in the form of another tool: answers as a list, a document's UUID."""
    q = T.qa(spark, d)
    answer = F.to_json(F.array(F.struct(F.col("gold").alias("free_form_answer"), F.array().cast("array<string>").alias("evidence"))))
    return q.select("question_id", answer.alias("answer"), F.col("gold").alias("gold_answer"), F.col("reasoning_type").alias("question_type"), F.col("domain").alias("doc_name"), X.name_uuid(NAMESPACE, F.col("domain")).alias("doc_uuid"))


QUERIES = {f.__name__: f for f in (answer_resume, judged_answers, toc_stitch, question_reshape)}

ORACLE_SQL = {
    "answer_resume": """with q as (select item_id as qid, text, row_number() over (order by item_id) as i, count(*) over () as n from benchmark)
select qid, string_split_regex(trim(text), '\\s+')[1] as pred_answer, length(text) as input_tokens, case when i <= n - n // 4 and qid % 5 in (1, 2) then 2 else 1 end::bigint as tries,
  case when i <= n - n // 4 and qid % 5 = 1 then 'no answer to ' || qid when i <= n - n // 4 and qid % 5 = 2 then 'the answer is empty' end as first_error from q""",
    "judged_answers": """select p_partkey as case_id, case when length(p_type) % 5 < 4 and (p_size % 2 = 0 or p_brand = p_name) then 1.0::double else 0.0::double end as score,
  (['by name', 'fenced', '', 'cut', 'Error: the judge is away'])[length(p_type) % 5 + 1] as reasoning from part""",
    "question_reshape": f"""with {T.QA_SQL}, h as (select *, sha1(unhex('{NAMESPACE.replace("-", "")}') || domain::blob) as h from qa)
select question_id, '[' || to_json({{'free_form_answer': gold, 'evidence': []::varchar[]}})::varchar || ']' as answer, gold as gold_answer, reasoning_type as question_type, domain as doc_name,
  concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), lower(to_hex((('0x' || substr(h, 17, 2))::int & 63) | 128)) || substr(h, 19, 2), substr(h, 21, 12)) as doc_uuid from h""",
    "toc_stitch": """select o_custkey, o_orderkey::varchar as structure, o_orderpriority || ' "{}] ' || o_orderstatus as title, day(o_orderdate)::varchar as page from orders""",
}
