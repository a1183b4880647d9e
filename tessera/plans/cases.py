"""Named case and store queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import cases as C
from ..operators import store as K
from ..sources import tables as T


def case_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents")
    test = C.matches("LICENSED", "SRC1", ["1", "7"], F.col("text"), F.col("doc_id").cast("string"), F.array("source"))
    return docs.where(test).select("doc_id", "source")


def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.systematic(T.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 7)


def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """A positive limit keeps the first rows in order."""
    return C.limited(T.table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 50)


def negative_limit(spark: SparkSession, d: str) -> DataFrame:
    return C.limited(T.table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", -10)


def _prior(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").where("o_orderkey % 3 = 0")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("skipped")
    return o.select("o_orderkey", status.alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("prediction"))


def resume_split(spark: SparkSession, d: str) -> DataFrame:
    cases = T.table(spark, d, "orders").select("o_orderkey")
    carried, todo = C.resumed(cases, _prior(spark, d), "o_orderkey")
    return carried.select("o_orderkey", "status").unionByName(todo.select("o_orderkey", F.lit("new").alias("status")))


def resume_overlay(spark: SparkSession, d: str) -> DataFrame:
    cases = T.table(spark, d, "orders").select("o_orderkey", F.lower("o_orderstatus").alias("fresh"))
    return C.overlaid(cases, _prior(spark, d), "o_orderkey", ["fresh"], ["prediction"])


def frozen_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = C.question_ids("set_x_", [(1, 40), (100, 120), (999_990, 999_999)], spark)
    questions = T.table(spark, d, "orders").select(F.format_string("set_x_%06d", "o_orderkey").alias("question_id"), "o_orderkey")
    selected, problems = C.frozen(questions, ids, "question_id")
    return selected.select("question_id", F.lit("selected").alias("kind")).unionByName(problems.select("question_id", F.lit("missing").alias("kind")))


def catalog_left_join(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = T.table(spark, d, "documents"), T.table(spark, d, "labels")
    pairs = docs.select((F.col("doc_id") / 3).cast("long").alias("case_id"), F.col("doc_id").cast("string").alias("document_id"))
    known = docs.where("doc_id % 19 <> 4").select(F.col("doc_id").cast("string").alias("document_id"))
    reasons = labels.where("quality = 0").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("file is unusable").alias("reason"))
    return C.availability(pairs, known, reasons)


def _held(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.md5("text").alias("content"), F.lit(0).cast("long").alias("seq"))


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """New rows; each id of the batch comes twice."""
    b = T.table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("seq"), "lang")
    return b.select("id", F.concat("lang", F.lit("-"), F.col("seq").cast("string")).alias("content"), "seq")


def upsert_skip(spark: SparkSession, d: str) -> DataFrame:
    return K.insert_new(_held(spark, d), _batch(spark, d))


def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    return K.replaced(_held(spark, d), _batch(spark, d))


def uncached_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents")
    return K.not_cached(docs.select(F.col("source").alias("source_path")).distinct(), docs.where("doc_id % 50 < 12").select(F.col("source").alias("source_path")))


def source_key_migration(spark: SparkSession, d: str) -> DataFrame:
    """Three pages a key; up to three paths, of equal or different payloads, lead to one."""
    number = F.floor(F.col("page_id") / 3)
    key = F.concat(F.lit("datasets/web/"), number.cast("string"), F.lit(".html"))
    rows = T.table(spark, d, "pages").select("page_id", key.alias("key"), (number % 8).alias("m"), F.md5("html").alias("content"))
    old = rows.where("m <> 1").select(F.when(F.col("m") % 2 == 0, F.concat(F.lit("/old/checkout/"), "key")).otherwise(F.concat(F.lit("C:\\work\\"), F.replace("key", F.lit("/"), F.lit("\\")))).alias("source_path"), F.when(F.col("m") == 3, F.lit("other")).otherwise(F.col("content")).alias("content"))
    copy = rows.where("m in (2, 3, 4) or m = 5 and page_id % 3 > 0").select(F.concat(F.lit("/srv/copy/"), "key").alias("source_path"), "content")
    new = rows.where("m in (1, 2, 3, 4)").select(F.col("key").alias("source_path"), "content")
    kept, conflicts = K.migrated(old.unionByName(copy).unionByName(new), ["content"])
    return kept.select("source_path", F.col("content").alias("value"), F.lit("kept").alias("kind")).unionByName(conflicts.select(F.col("target").alias("source_path"), F.col("n_paths").cast("string").alias("value"), F.lit("conflict").alias("kind")))


def prune_oldest_tool_group(spark: SparkSession, d: str) -> DataFrame:
    return C.pruned_messages(T.table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


def blank_filter(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 4 == 0, F.lit(" \n\t ")).otherwise(F.col("text"))
    return T.table(spark, d, "conversations").where(~X.is_blank(text)).select("conv_id", "turn")


def tool_call_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first 128 calls of each run, and whether any were dropped; a run is cut to one
    call more before it is counted."""
    rank = F.row_number().over(Window.partitionBy("run").orderBy("ts", "event_id"))
    first = T.steps(spark, d).select("run", "ts", "event_id").withColumn("rank", rank).where("rank <= 129")
    return first.groupBy("run").agg(F.count_if(F.col("rank") <= 128).alias("kept"), (F.count(F.lit(1)) > 128).alias("capped"))


_PRIOR = "p as (select o_orderkey, case o_orderstatus when 'F' then 'failed' when 'O' then 'completed' else 'skipped' end as status, case when o_orderkey % 2 = 0 then o_orderpriority end as prediction from orders where o_orderkey % 3 = 0)"
_HELD = "h as (select doc_id as id, md5(text) as content, 0::bigint as seq from documents where doc_id % 2 = 0), b as (select doc_id as id, lang || '-' || s as content, s as seq from documents, (values (1::bigint), (2::bigint)) x(s) where doc_id % 3 = 0)"

QUERIES = {f.__name__: f for f in (case_filter, systematic_sample, first_rows, negative_limit, resume_split, resume_overlay, frozen_ids, catalog_left_join, upsert_skip, upsert_replace, uncached_sources, source_key_migration, prune_oldest_tool_group, blank_filter, tool_call_cap)}

ORACLE_SQL = {
    "case_filter": "select doc_id, source from documents where (contains(doc_id::varchar, '1') or contains(doc_id::varchar, '7')) and (contains(lower(text), 'licensed') or contains(lower(doc_id::varchar), 'licensed')) and contains(lower(source), 'src1')",
    "first_rows": "select c_custkey, c_name from customer order by c_custkey limit 50",
    "systematic_sample": "with l as (select o_orderkey, o_custkey, row_number() over (order by o_orderkey) as n from orders) select o_orderkey, o_custkey from l where (n - 1) % 7 = 0",
    "negative_limit": "select c_custkey, c_name from customer qualify row_number() over (order by c_custkey) <= count(*) over () - 10",
    "resume_split": f"with {_PRIOR} select o_orderkey, status from p where status <> 'failed' union all select o_orderkey, 'new' from orders where o_orderkey not in (select o_orderkey from p where status <> 'failed')",
    "resume_overlay": f"with {_PRIOR} select o_orderkey, lower(o_orderstatus) as fresh, p.prediction, p.prediction is not null as carried_forward from orders left join (select * from p where prediction is not null) p using (o_orderkey)",
    "frozen_ids": "with i as (select printf('set_x_%06d', n) as question_id from (select unnest(range(1, 41)) as n union all select unnest(range(100, 121)) union all select unnest(range(999990, 1000000)))), q as (select printf('set_x_%06d', o_orderkey) as question_id from orders) select question_id, 'selected' as kind from q semi join i using (question_id) union all select question_id, 'missing' from i anti join q using (question_id)",
    "catalog_left_join": """with r as (select doc_id // 3 as case_id, doc_id, doc_id % 19 = 4 as missing, exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 0) as bad from documents d)
select case_id, case when bool_or(missing) then 'fatal' when bool_or(bad) then 'skipped' else 'runnable' end as route, coalesce(string_agg(doc_id || ': file is unusable', '; ' order by doc_id || ': file is unusable') filter (bad), '') as reasons from r group by case_id""",
    "upsert_skip": f"with {_HELD} select id, content, seq from b where seq = 1 and id not in (select id from h)",
    "upsert_replace": f"with {_HELD} select id, content, seq from h where id not in (select id from b) union all select id, content, seq from b where seq = 2",
    "uncached_sources": "select distinct source as source_path from documents where source not in (select source from documents where doc_id % 50 < 12)",
    "source_key_migration": """with p as (select page_id, 'datasets/web/' || (page_id // 3) || '.html' as key, (page_id // 3) % 8 as m, md5(html) as content from pages),
a as (select key, case when m % 2 = 0 then '/old/checkout/' || key else 'C:\\work\\' || replace(key, '/', '\\') end as path, case when m = 3 then 'other' else content end as content from p where m <> 1
  union all select key, '/srv/copy/' || key, content from p where m in (2, 3, 4) or m = 5 and page_id % 3 > 0
  union all select key, key, content from p where m in (1, 2, 3, 4)),
s as (select key, path, list_sort(list(content)) as held from a group by all),
c as (select key, count(distinct held) as n_held, count(*) as n_paths, arg_min(path, (path <> key, path)) as chosen from s group by key)
select a.key as source_path, content as value, 'kept' as kind from a join c on c.key = a.key and chosen = path where n_held = 1 union all select key, n_paths::varchar, 'conflict' from c where n_held > 1""",
    "prune_oldest_tool_group": """with g as (select conv_id, turn, role, sum((role = 'assistant')::int) over w as n, max(case when role in ('assistant', 'user') then turn end) over w as last from conversations window w as (partition by conv_id order by turn)),
x as (select g.*, (select c.role from conversations c where c.conv_id = g.conv_id and c.turn = g.last) as last_role from g) select conv_id, turn, role from x where not (n = 1 and coalesce(last_role, '') = 'assistant')""",
    "blank_filter": "select conv_id, turn from conversations where turn % 4 <> 0 and trim(text) <> ''",
    "tool_call_cap": f"with {T.STEPS_SQL} select run, least(count(*), 128) as kept, count(*) > 128 as capped from steps group by run",
}
