"""Named queries of readers, writers and document sources with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import cases as C
from ..operators import documents as D
from ..sources import files, shared, sinks
from ..sources import tables as T

_ROOT = "https:"


def prediction_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as predictions in JSON lines of five shapes, read back."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("q"), k.cast("string"))
    line = (
        F.when(k % 5 == 0, F.to_json(F.struct(name.alias("question_id"), F.col("p_name").alias("prediction"))))
        .when(k % 5 == 1, F.to_json(F.struct(name.alias("question_id"), F.struct(F.col("p_size").alias("value")).alias("answer"), F.lit("late").alias("status"))))
        .when(k % 5 == 2, F.to_json(F.struct(name.alias("question_id"), F.col("p_brand").alias("response"), F.col("p_name").alias("output"))))
        .when(k % 5 == 3, F.concat(F.lit("  "), F.to_json(F.struct(name.alias("question_id"), F.lit(True).alias("model_answer")))))
        .otherwise(F.concat(F.lit('{"question_id": "'), name, F.lit('", "prediction": null, "output": "x"}')))
    )
    path = f"{shared.folder(spark, 'predictions')}/lines.jsonl"
    T.table(spark, d, "part").select(line.alias("value")).write.text(path)
    return files.predictions(spark, path)


def predictions_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What the writer of predictions leaves, by the lenient reader and as predictions."""
    rows = T.qa(spark, d).select("question_id", F.when(F.col("answered"), F.col("prediction")).alias("prediction"), "domain")
    path = f"{shared.folder(spark, 'predictions')}/out.jsonl"
    sinks.predictions(rows, path)
    raw = files.jsonl(spark, path, "question_id string, domain string")
    return files.predictions(spark, path).join(raw, "question_id")


def submission_check(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a strict submission with faults of nine kinds; how many of each."""
    k = F.col("c_custkey")
    own = F.concat(F.lit('"c'), k.cast("string"), F.lit('"'))
    line = (
        F.when(k % 20 == 1, "not json").when(k % 20 == 2, "[1]").when(k % 20 == 3, F.concat(F.lit('{"question_id": '), own, F.lit("}")))
        .when(k % 20 == 4, '{"question_id": "  ", "prediction": "a"}').when(k % 20 == 5, F.concat(F.lit('{"question_id": '), k.cast("string"), F.lit(', "prediction": "a"}')))
        .when(k % 20 == 6, F.concat(F.lit('{"question_id": '), own, F.lit(', "prediction": 3}'))).when(k % 20 == 7, '{"question_id": " same ", "prediction": "a"}')
        .when(k % 20 == 8, F.concat(F.lit('{"question_id": '), own, F.lit(', "prediction": "a", "more": 1}'))).when(k % 20 == 9, "   ")
        .otherwise(F.concat(F.lit('{"question_id": '), own, F.lit(', "prediction": "a"}')))
    )
    path = f"{shared.folder(spark, 'submission')}/in.jsonl"
    T.table(spark, d, "customer").select(line.alias("value")).write.text(path)
    return files.submission_problems(spark, path).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def canonical_props(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", X.canonical_json(F.col("props")).alias("canonical"))


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Previews, file names and keys below a root of every page."""
    url = F.regexp_replace("url", "^http:", "https:")
    return T.table(spark, d, "pages").select("page_id", F.md5(X.preview(F.col("html"), 120)).alias("preview_md5"), X.safe_name(F.col("url")).alias("name"), X.relative_key(url, _ROOT).alias("key"))


def vector_texts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as JSON and read again."""
    back = V.deserialised(V.serialised(F.col("embedding")))
    total = F.aggregate(back, F.lit(0.0), lambda s, x: s + x)
    return T.table(spark, d, "embeddings").select("vec_id", F.size(back).alias("n"), F.round(total, 4).alias("total"), (back == F.col("embedding").cast("array<double>")).alias("same"))


def scoped_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in a scope of a file and a section, and those that a list of indexes names."""
    rows = T.chunks(spark, d)
    base = P.equal("source_kind", "local")
    scope, label = P.scope(base, "src4", None, "EN")
    one = rows.where(P.compiled(scope)).select("id", F.lit(label).alias("by"))
    ignored, everything = P.scope(base, None, None, "EN")
    two = rows.where(P.compiled(ignored)).select("id", F.lit(everything).alias("by"))
    three = rows.where(P.compiled(P.chunk_filter("src3", [7, 0, 5, 7]))).select("id", F.lit("indexes").alias("by"))
    return one.unionByName(two).unionByName(three)


def questions_with_info(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the last of their lines, those that a listing of customers has."""
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    info = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).alias("seq"), "l_partkey", "l_suppkey")
    listed = T.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = C.with_files(C.with_info(o, info, "o_orderkey", "seq"), listed, "o_custkey")
    known = C.selected(T.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey")), T.table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("o_custkey")), "c_nationkey")
    return rows.join(known, "o_custkey").select("o_orderkey", "o_custkey", "c_nationkey", "info.l_partkey", "info.l_suppkey")


def keys_in_first_order(spark: SparkSession, d: str) -> DataFrame:
    return C.first_order(T.steps(spark, d).where("key is not null").select("key", "event_id"), "key", "event_id")


def body_items(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents of nested groups: six turns a group, three in each of its
    own; some turns of every third conversation have their text from a markdown file."""
    c = T.table(spark, d, "conversations").withColumns({"doc": F.col("conv_id"), "ref": F.concat(F.lit("t"), F.col("turn").cast("string"))})
    header = F.col("role") == "system"
    own = c.select("doc", "ref", F.lit("text").alias("kind"), F.when(header, "section_header").otherwise("paragraph").alias("label"), F.when(F.col("turn") % 4 == 3, " ").otherwise(F.col("text")).alias("text"), F.when(F.col("turn") % 2 == 1, (F.col("turn") / 3).cast("int")).alias("page"), F.when(header, 1).alias("level"))
    top, low = F.floor(F.col("turn") / 6), F.floor(F.col("turn") / 3)
    name = lambda mark, n: F.concat(F.lit(mark), n.cast("string"))
    groups = c.select("doc", F.explode(F.array(name("G", top), name("g", low))).alias("ref")).distinct().select("doc", "ref", F.lit("group").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("level"))
    edge = lambda parent, n, child: c.select("doc", parent.alias("parent"), n.cast("int").alias("ord"), child.alias("child"))
    edges = edge(F.lit(D.BODY), top, name("G", top)).union(edge(name("G", top), low, name("g", low))).distinct().union(edge(name("g", low), F.col("turn"), F.col("ref"))).union(edge(F.lit(D.BODY), F.lit(10_000), F.lit("nothing")).distinct())
    override = c.where("role <> 'assistant' and conv_id % 3 = 0").select("doc", "ref", F.concat(F.lit("## "), "text", F.lit(" (md)")).alias("text"))
    return D.body_items(own.unionByName(groups), edges, override).select("doc", "pos", "label", "level", "page", F.md5("text").alias("text_md5"))


def _lengths():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def sentence_index(spark: SparkSession, d: str) -> DataFrame:
    """A sentence index of each source, and whether it holds for the texts once the German
    ones have changed."""
    docs = T.table(spark, d, "documents").select(F.col("source").alias("document"), "doc_id", F.col("text").alias("content"), "lang")
    path = f"{shared.folder(spark, 'sentences')}/index"
    D.build_sentence_index(docs.drop("lang"), "document", "doc_id", _lengths, "length", path)
    changed = docs.withColumn("content", F.when(F.col("lang") == "de", F.concat("content", F.lit("!"))).otherwise(F.col("content"))).drop("lang")
    size = spark.read.parquet(path).groupBy(F.col("document").cast("string").alias("document")).agg(F.count(F.lit(1)).alias("sentences"), F.round(F.sum(F.element_at("embedding", 1)), 3).alias("firsts"))
    return D.index_matches(changed, "document", "doc_id", "length", path).join(size, "document", "left").select("document", "matches", "sentences", "firsts")


QUERIES = {f.__name__: f for f in (prediction_shapes, predictions_round_trip, submission_check, canonical_props, page_texts, vector_texts, scoped_chunks, questions_with_info, keys_in_first_order, body_items, sentence_index)}

_SENTENCES = "list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 10)"

ORACLE_SQL = {
    "prediction_shapes": "select 'q' || p_partkey as question_id, case p_partkey % 5 when 0 then p_name when 1 then p_size::varchar when 2 then p_brand when 3 then 'True' else '' end as prediction, case when p_partkey % 5 = 1 then 'late' else 'success' end as status from part",
    "predictions_round_trip": f"with {T.QA_SQL} select question_id, case when answered then prediction else '' end as prediction, case when answered then 'success' else 'failed' end as status, domain from qa",
    "submission_check": """with p as (select case c_custkey % 20 when 1 then 'not JSON' when 2 then 'no object' when 3 then 'keys' when 4 then 'id is blank' when 5 then 'id is no text' when 6 then 'prediction is no text' when 8 then 'keys' end as problem from customer),
t as (select count(*) as n from customer where c_custkey % 20 = 7)
select problem, count(*) as n from p where problem is not null group by 1 union all select 'id is there twice', 1 from t where n > 1""",
    "canonical_props": "select event_id, replace(props, ' ', '') as canonical from events",
    "page_texts": """with p as (select *, replace(html, chr(10), '\\n') as line from pages)
select page_id, md5(case when length(line) <= 120 then line else substr(line, 1, 120) || '... (' || length(html) || ' chars)' end) as preview_md5, regexp_replace(url, '[^\\w\\-.]', '_', 'g') as name, regexp_replace(url, '^https?:/', '') as key from p""",
    "vector_texts": "select vec_id, len(embedding)::int as n, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total, true as same from embeddings",
    "scoped_chunks": f"with {T.CHUNKS_SQL} select id, 'src4 / EN' as \"by\" from chunks where source_path = 'src4' and section_title = 'EN' union all select id, 'all files' from chunks union all select id, 'indexes' from chunks where source_path = 'src3' and chunk_index in (0, 5, 7)",
    "questions_with_info": """with l as (select l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey)) as l_partkey, arg_max(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) as l_suppkey from lineitem group by 1)
select o_orderkey, o_custkey, c_nationkey, l_partkey, l_suppkey from orders join customer on c_custkey = o_custkey left join l on l_orderkey = o_orderkey where c_acctbal > 0""",
    "keys_in_first_order": f"with {T.STEPS_SQL} select key, min(event_id) as event_id from steps where key is not null group by key",
    "body_items": """with c as (select conv_id as doc, turn, turn // 3 as low, role = 'system' as head, case when turn % 2 = 1 then turn // 3 end as page,
    case when role <> 'assistant' and conv_id % 3 = 0 then case when role = 'system' then '' else '## ' end || text || ' (md)' when turn % 4 = 3 then ' ' else text end as text from conversations),
m as (select *, bool_or(head) over (partition by doc, low) as mixed, sum(head::int) over (partition by doc, low order by turn) as run from c),
i as (select doc, turn, 'section_header' as label, 1 as level, page, text, true as mixed from m where head
  union all select doc, min(turn), 'grouped_paragraph', null, arg_min(page, turn) filter (page is not null), string_agg(text, ' ' order by turn), any_value(mixed) from m where not head group by doc, low, run)
select doc, row_number() over (partition by doc order by turn) - 1 as pos, label, level, page::int as page, md5(text) as text_md5 from i where mixed or trim(text) <> ''""",
    "sentence_index": f"""with d as (select source, lang, unnest({_SENTENCES}) as s from documents),
n as (select source, count(*) as sentences, round(sum(length(s) / sqrt(length(s) * length(s) + 1)), 3) as firsts from d group by 1)
select source as document, bool_and(lang <> 'de') as matches, any_value(sentences) as sentences, any_value(firsts) as firsts from documents left join n using (source) group by 1""",
}
