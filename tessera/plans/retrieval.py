"""Named retrieval and navigation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import predicates as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import retrieval as R
from ..operators.termindex import TermIndex
from ..operators.vectorindex import VectorIndex
from ..sources import shared
from ..sources import tables as T

QUESTION = "then licensed the reating edes then"
FILTER = P.both(P.equal("section_id", "en"), {"operator": "OR", "conditions": [P.equal("source_path", "src3"), {"field": "chunk_index", "operator": "in", "value": [0, 1, 2]}]})
CHUNKS, CATALOG = T.CHUNKS_SQL, T.CATALOG_SQL
_COLUMNS = ("id", "source_path", "chunk_index", "section_id")


#: Keys and order of chunks before they are numbered.
_KEYS = ("source_path", "doc_id")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, label, score): all vectors against the question's."""
    e = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return R.vector_scores(e, _question(spark, d))


_VECTORS = f"{CHUNKS}, vectors as (select c.*, embedding::double[] as embedding, label from chunks c left join embeddings on vec_id = doc_id)"


def _question(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "embeddings").where("vec_id = 7").select(F.col("embedding").alias("q"))


_Q = "q as (select embedding::double[] as q from embeddings where vec_id = 7)"


def filter_ast_and_or(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(spark, d).where(P.compiled(FILTER)).select(*_COLUMNS)


def filter_empty_in(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(spark, d).where(P.compiled({"field": "section_id", "operator": "in", "value": []})).select(*_COLUMNS)


def scan_ordered_by_source(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(spark, d).select(*_COLUMNS, F.length("content").alias("chars")).orderBy(*R.ORDER)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    found = R.scored_topk(T.unnumbered(spark, d).select("id", *_KEYS), _scored(spark, d).drop("label"), "doc_id", order=_KEYS)
    return T.located(spark, d, found).select(*R.ORDER, F.round("score", 6).alias("score"))


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = T.unnumbered(spark, d).where(P.compiled(P.equal("section_id", "en")))
    found = R.scored_topk(rows.select("id", *_KEYS), _scored(spark, d).where("label = 1").drop("label"), "doc_id", 10, _KEYS)
    return T.located(spark, d, found).select(*R.ORDER, F.round("score", 6).alias("score"))


def _vector_index(spark: SparkSession, d: str) -> VectorIndex:
    def build(path: str) -> None:
        VectorIndex(spark, path).build(T.table(spark, d, "embeddings"), row_id="vec_id")

    return VectorIndex(spark, shared.kept(spark, "vector-cells", [f"{d}/embeddings.parquet"], build))


def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector against all of them, by a kept index of cells."""
    queries = T.table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = _vector_index(spark, d).search(queries, 5)[0]
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "benchmark").select("item_id", F.array_join(X.query_terms(F.col("text")), " ").alias("tokens"))


def _chunk_index(spark: SparkSession, d: str) -> TermIndex:
    """The term index of the chunks, built once for the documents as they are."""

    def build(path: str) -> None:
        TermIndex(spark, path).append(T.unnumbered(spark, d).select("id", *_KEYS, "section_id", "content"), kept=T.with_index)

    return TermIndex(spark, shared.kept(spark, "chunk-terms", [f"{d}/documents.parquet"], build))


def _section_index(spark: SparkSession, d: str) -> TermIndex:
    def build(path: str) -> None:
        TermIndex(spark, path).append(_sections(spark, d).select("source_path", "section_id", "ordinal", "content"))

    return TermIndex(spark, shared.kept(spark, "section-terms", [f"{d}/{t}.parquet" for t in ("region", "nation", "customer", "orders")], build))


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_index(spark, d).statistics()


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = _chunk_index(spark, d).search(QUESTION)
    return found.select(*R.ORDER, F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Statistics are of all chunks, results of one section."""
    found = _chunk_index(spark, d).search(QUESTION, 30, P.compiled(P.equal("section_id", "en")))
    return found.select(*R.ORDER, F.round("bm25", 6).alias("bm25"))


def bm25_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """An index of its own: two sources deleted, one of them and a third replaced."""
    path = shared.folder(spark, "terms")
    index = TermIndex(spark, path)
    rows = T.unnumbered(spark, d).select("id", *_KEYS, "section_id", "content")
    index.append(rows, kept=T.with_index)
    index.delete(F.col("source_path").isin("src1", "src2"))
    index.replace(rows.where("source_path in ('src2', 'src3')").withColumn("content", F.concat("content", F.lit(" licensed reating"))), kept=T.with_index)
    return index.search(QUESTION).select(*R.ORDER, F.round("bm25", 6).alias("bm25"))


def keyword_like_fallback(spark: SparkSession, d: str) -> DataFrame:
    found = R.like_topk(T.unnumbered(spark, d).select("id", *_KEYS, "content"), "licensed token", order=_KEYS)
    return T.located(spark, d, found.drop("content")).select(*R.ORDER, F.round("score", 6).alias("score"))


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Chunks are known by the term index; their texts are not read."""
    index = _chunk_index(spark, d)
    e = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    found = R.hybrid(index.documents(), QUESTION, _question(spark, d), index=index, vectors=(e, "doc_id"))
    return found.select("source_path", "chunk_index", F.round("rrf", 6).alias("rrf"), "hits", F.round("best_score", 6).alias("best_score"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """Section records of the catalog: title, then the breadcrumb."""
    c = T.catalog(spark, d)
    # Titles come to a section by its chain, so no file's titles are held together.
    links = c.select("source_path", "id", F.posexplode("chain").alias("at", "up"))
    titles = c.where("level < 3").select("source_path", F.col("id").alias("up"), F.col("title").alias("up_title"))
    named = links.join(titles, ["source_path", "up"], "left").groupBy("source_path", "id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("up_title", "up").alias("t")))).alias("names"))
    crumb = F.array_join(F.transform("names", lambda x: x["t"]), " > ")
    known = c.where("chunk_count > 0 and trim(title) <> ''").join(named, ["source_path", "id"], "left")
    return known.select("source_path", F.col("id").alias("section_id"), "title", "level", "chain", "chunk_count", "ordinal", F.when(F.size("chain") == 0, F.col("title")).otherwise(F.concat("title", F.lit("\n"), crumb, F.lit(" > "), "title")).alias("content"), F.when(F.size("chain") == 0, F.col("title")).otherwise(F.concat(crumb, F.lit(" > "), "title")).alias("breadcrumb"))


_SECTIONS = f"""{CATALOG}, names as (select id, title from catalog where level < 3),
crumbs as (select c.id, string_agg(coalesce(n.title, x.x), ' > ' order by x.o) as crumb from catalog c, unnest(chain) with ordinality x(x, o) left join names n on n.id = x.x group by c.id),
sections as (select source_path, c.id as section_id, title, level, chain, chunk_count, ordinal, case when crumb is null then title else title || chr(10) || crumb || ' > ' || title end as content,
  case when crumb is null then title else crumb || ' > ' || title end as breadcrumb from catalog c left join crumbs b using (id) where chunk_count > 0 and trim(title) <> '')"""
_TOC_QUERY = "france asia 17"


def toc_rrf(spark: SparkSession, d: str) -> DataFrame:
    s = _sections(spark, d)
    keys = ["source_path", "section_id"]
    q = spark.range(1).select(V.hash_embedding(F.lit(_TOC_QUERY)).alias("q"))
    semantic = R.vector_topk(s.select(*keys, "ordinal", V.hash_embedding(F.col("content")).alias("embedding")), q, R.LEG, order=("source_path", "ordinal"))
    lexical = _section_index(spark, d).search(_TOC_QUERY, order=("source_path", "ordinal"))
    found = R.fused([R.ranked(semantic, 0, keys, [F.desc("score"), "source_path", "ordinal"]), R.ranked(lexical, 1, keys, ["bm25", "source_path", "ordinal"])], keys, R.TOC)
    return found.select(*keys, F.round("rrf", 6).alias("rrf"), "hits", F.round("best_score", 6).alias("best_score"))


def fuzzy_file_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every page asks for a file among all pages and sources: by its path, by its last
    part in upper case, by a part with other separators, by a text around it."""
    pages = T.table(spark, d, "pages")
    last = F.substring_index("url", "/", -1)
    form = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, F.upper(last)).when(F.col("page_id") % 4 == 2, F.translate(last, "?=&#", "_.-_")).otherwise(F.concat(F.lit("the file src"), (F.col("page_id") % 30).cast("string"), F.lit(" of "), last))
    wanted = pages.select(form.alias("file_id")).distinct()
    sources = T.table(spark, d, "documents").select(F.concat(F.lit("data/"), "source").alias("source_path"))
    return R.resolve_file(wanted, pages.select(F.col("url").alias("source_path")).union(sources))


def fuzzy_title_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's name as a title, and as a needle in one of four forms."""
    c = T.table(spark, d, "customer")
    k, name = F.col("c_custkey"), F.col("c_name")
    form = F.when(k % 4 == 0, name).when(k % 4 == 1, F.upper(name)).when(k % 4 == 2, F.substr(name, F.length(name) - 4)).otherwise(F.concat(F.lit(" _"), F.lower(name), F.lit("-")))
    return R.resolve_title(c.select(form.alias("needle")).distinct(), c.select(name.alias("title"), k.alias("ordinal")))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """(answer_id, pos, chunk_id): three chunks that each benchmark item cites."""
    return T.table(spark, d, "benchmark").select(F.col("item_id").alias("answer_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.concat(F.lit("src"), ((F.col("item_id") + i) % 22).cast("string"), F.lit("::"), (F.col("item_id") * 3 + i).cast("string")).alias("chunk_id")) for i in range(3)])).alias("s")).select("answer_id", "s.pos", "s.chunk_id")


def chunk_window(spark: SparkSession, d: str) -> DataFrame:
    """The windows around all chunks that benchmark items cite."""
    return R.chunk_window(T.chunks(spark, d), R.parse_chunk_ids(_cited(spark, d)), 1, 2).select(*_COLUMNS).orderBy(*R.ORDER)


#: Chunk ids of ten kinds, read by both engines.
_ID = """case c_custkey % 10 when 0 then c_mktsegment || '/b.pdf::' || cast(c_custkey as string) when 1 then c_name || '::y::7' when 2 then c_name when 3 then c_name || '::' when 4 then c_name || '::x1'
  when 5 then c_name || '::-' || cast(c_custkey as string) when 6 then '::' || cast(c_custkey as string) when 7 then c_name || ':: ' || cast(c_custkey as string) || ' ' when 8 then c_name || '::1_0' else c_name || '::+5' end"""


def chunk_id_parse_errors(spark: SparkSession, d: str) -> DataFrame:
    return R.parse_chunk_ids(T.table(spark, d, "customer").select(F.expr(_ID).alias("chunk_id")))


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = T.chunks(spark, d).where(P.compiled(P.section_filter("src4", "fr")))
    return rows.select(*R.ORDER, R.rendered_chunk().alias("rendered")).orderBy(*R.ORDER)


def quote_resolution(spark: SparkSession, d: str) -> DataFrame:
    found = R.quotes(_cited(spark, d), T.chunks(spark, d).select("source_path", "chunk_index", "content", "id"))
    return found.select("answer_id", "pos", "chunk_id", F.md5("exact_quote").alias("quote_md5"), F.length("exact_quote").alias("quote_chars"))


def synthesis_context(spark: SparkSession, d: str) -> DataFrame:
    return R.context_prefix(T.chunks(spark, d), "source_path", ["chunk_index"]).select("source_path", "chunk_index", F.col("used_chars").cast("long").alias("used_chars"))


def dedupe_returned(spark: SparkSession, d: str) -> DataFrame:
    rows = R.returned_once(T.steps(spark, d).where("key is not null"), "run", ["ts", "event_id"], ["key"])
    return rows.groupBy("run").agg(F.count_if("is_new").alias("new_chunks"), F.count_if(~F.col("is_new")).alias("already_returned"), F.min(F.when(F.col("is_new"), F.col("event_id"))).alias("first_event"))


def evidence_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = R.returned_once(T.steps(spark, d).where("key is not null"), "run", ["ts", "event_id"], ["key"]).where("is_new")
    order = F.row_number().over(Window.partitionBy("run").orderBy("ts", "event_id"))
    return rows.select("run", "key", "event_id", order.cast("long").alias("evidence_no"))


def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """Available files: with sections, or without where there are too few orders."""
    s = _sections(spark, d).groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    files = T.table(spark, d, "region").select(F.col("r_name").alias("source_path")).unionByName(T.table(spark, d, "documents").select(F.col("source").alias("source_path")).distinct())
    has = F.concat(F.lit("  |  "), F.col("n").cast("string"), F.lit(" sections  |  TOC available"))
    return files.join(s, "source_path", "left").select("source_path", F.concat(F.lit("- "), X.basename(F.col("source_path")), F.lit("  |  source_path: "), "source_path", F.coalesce(has, F.lit("  |  no TOC"))).alias("line"))


def _bm25_sql(rows: str, query: str, order: str, limit: int, more: str) -> str:
    tokens = R.query_tokens(query)
    terms = ", ".join(f"('{t}', {tokens.count(t)})" for t in dict.fromkeys(tokens))
    return f"""
w as (select *, regexp_extract_all(strip_accents(lower(content)), '([\\p{{L}}\\p{{N}}]+)', 1) as terms from {rows}),
st as (select count(*) as n, avg(len(terms)) as avgdl from w),
qt as (select * from (values {terms}) x(term, qn)),
tf as (select {more}, len(terms) as dl, term, qn, len(list_filter(terms, lambda x: x = term)) as tf from w, qt),
df as (select term, count(*) filter (tf > 0) as df from tf group by term),
kw as (select {more}, -sum(qn * case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as bm25
  from tf join df using (term), st where tf > 0 group by {more}),
lex as (select {more}, bm25, 1 / (1 + abs(bm25)) as score, row_number() over (order by bm25, {order}) as rank from kw qualify rank <= {limit})"""


def _fuse_sql(keys: str, k: int) -> str:
    return f"""
u as (select {keys}, score, rank, 0 as leg from sem union all select {keys}, score, rank, 1 from lex),
fu as (select {keys}, sum(1 / (60 + rank)) as rrf, count(*) as hits, max(coalesce(score, 0.0)) as best_score, min(leg * 1000000 + rank) as seen from u group by all)
select {keys}, round(rrf, 6) as rrf, hits, round(best_score, 6) as best_score from (select * from fu order by round(rrf, 12) desc, hits desc, best_score desc, seen limit {k})"""


_COS = "list_cosine_similarity(embedding, q)"
_HASH = lambda c: f"list_transform(range(64), lambda j: ('0x' || substr(sha256({c}), (2 * (j % 32) + 1)::bigint, 2))::int / 255.0::double * 2 - 1)"
_FOLD = "strip_accents(lower({}))"
_KEY = lambda c: f"trim(regexp_replace(strip_accents(lower({c})), '[\\s_.\\-]+', ' ', 'g'))"

QUERIES = {f.__name__: f for f in (filter_ast_and_or, filter_empty_in, scan_ordered_by_source, vector_topk, vector_topk_filtered, vector_topk_batch, query_tokens, bm25_term_stats, bm25_topk, bm25_filtered, bm25_after_delete, keyword_like_fallback, hybrid_rrf, toc_rrf, fuzzy_file_resolve, fuzzy_title_resolve, chunk_window, chunk_id_parse_errors, section_chunks, quote_resolution, synthesis_context, dedupe_returned, evidence_first_seen, file_listing)}

ORACLE_SQL = {
    "filter_ast_and_or": f"with {CHUNKS} select id, source_path, chunk_index, section_id from chunks where section_id = 'en' and (source_path = 'src3' or chunk_index in (0, 1, 2))",
    "filter_empty_in": f"with {CHUNKS} select id, source_path, chunk_index, section_id from chunks where false",
    "scan_ordered_by_source": f"with {CHUNKS} select id, source_path, chunk_index, section_id, length(content)::int as chars from chunks order by source_path, chunk_index, id",
    "vector_topk": f"with {_VECTORS}, {_Q} select id, source_path, chunk_index, round({_COS}, 6) as score from vectors, q where embedding is not null order by {_COS} desc, source_path, chunk_index, id limit 30",
    "vector_topk_filtered": f"with {_VECTORS}, {_Q} select id, source_path, chunk_index, round({_COS}, 6) as score from vectors, q where embedding is not null and section_id = 'en' and label = 1 order by {_COS} desc, source_path, chunk_index, id limit 10",
    "vector_topk_batch": "with e as (select vec_id, embedding::double[] as v from embeddings), s as (select q.vec_id as query_id, e.vec_id as id, list_cosine_similarity(e.v, q.v) as s from e, e q where q.vec_id % 20 = 0) select query_id, id, row_number() over (partition by query_id order by s desc, id) as rank, round(s, 6) as score from s qualify rank <= 5",
    "query_tokens": "select item_id, array_to_string(list_transform(regexp_extract_all(text, '([0-9A-Za-z_]+)', 1), lambda x: lower(x)), ' ') as tokens from benchmark",
    "bm25_term_stats": "with e as (select doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '([\\p{L}\\p{N}]+)', 1)) as term from documents), t as (select doc_id, term, count(*) as tf from e group by all) select term, count(*) as df, sum(tf)::bigint as cf, max(tf) as max_tf from t group by term",
    "bm25_topk": f"with {CHUNKS}, {_bm25_sql('chunks', QUESTION, 'source_path, chunk_index', 30, 'source_path, chunk_index, id')} select source_path, chunk_index, id, round(bm25, 6) as bm25, round(score, 6) as score from lex",
    "bm25_filtered": f"with {CHUNKS}, {_bm25_sql('chunks', QUESTION, 'source_path, chunk_index', 1 << 60, 'source_path, chunk_index, id, section_id')} select source_path, chunk_index, id, round(bm25, 6) as bm25 from lex where section_id = 'en' qualify row_number() over (order by lex.bm25, source_path, chunk_index) <= 30",
    "bm25_after_delete": f"""with {CHUNKS}, live as (select source_path, chunk_index, id, content from chunks where source_path not in ('src1', 'src2', 'src3')
  union all select source_path, chunk_index, id, content || ' licensed reating' from chunks where source_path in ('src2', 'src3')),
{_bm25_sql('live', QUESTION, 'source_path, chunk_index', 30, 'source_path, chunk_index, id')} select source_path, chunk_index, id, round(bm25, 6) as bm25 from lex""",
    "keyword_like_fallback": f"with {CHUNKS}, c as (select * from chunks where lower(content) like '%licensed%' or lower(content) like '%token%' order by source_path, chunk_index limit 30) select source_path, chunk_index, id, round((contains(lower(content), 'licensed')::int + contains(lower(content), 'token')::int) / 2, 6) as score from c",
    "hybrid_rrf": f"""with {_VECTORS}, {_Q},
sem as (select source_path, chunk_index, {_COS} as score, row_number() over (order by {_COS} desc, source_path, chunk_index, id) as rank from vectors, q where embedding is not null qualify rank <= 30),
{_bm25_sql("chunks", QUESTION, "source_path, chunk_index", 30, "source_path, chunk_index, id")}, {_fuse_sql("source_path, chunk_index", 5)}""",
    "toc_rrf": f"""with {_SECTIONS}, q as (select {_HASH(f"'{_TOC_QUERY}'")} as q), ve as (select source_path, section_id, ordinal, {_HASH("content")} as embedding from sections),
sem as (select source_path, section_id, {_COS} as score, row_number() over (order by {_COS} desc, source_path, ordinal) as rank from ve, q qualify rank <= 30),
{_bm25_sql("sections", _TOC_QUERY, "source_path, ordinal", 30, "source_path, section_id, ordinal")}, {_fuse_sql("source_path, section_id", 10)}""",
    "fuzzy_file_resolve": f"""with p as (select page_id, url, string_split(url, '/')[-1] as last from pages),
n as (select distinct case page_id % 4 when 0 then url when 1 then upper(last) when 2 then translate(last, '?=&#', '_.-_') else 'the file src' || (page_id % 30) || ' of ' || last end as file_id from p),
f as (select distinct source_path, string_split(source_path, '/')[-1] as base from (select url as source_path from pages union all select 'data/' || source from documents)),
m as (select file_id, source_path, case when file_id = source_path then 1 when contains(lower(base), lower(file_id)) or contains(lower(file_id), lower(base)) then 2 when contains({_KEY("base")}, {_KEY("file_id")}) then 3 end as p from n, f),
r as (select file_id, min({{'p': p, 'source_path': source_path}}) as m from m where p is not null group by 1)
select file_id, m.source_path as source_path from n left join r using (file_id)""",
    "fuzzy_title_resolve": f"""with n as (select distinct case c_custkey % 4 when 0 then c_name when 1 then upper(c_name) when 2 then c_name[-5:] else ' _' || lower(c_name) || '-' end as needle from customer),
k as (select needle, {_KEY("needle")} as need from n), t as (select c_name as title, c_custkey as ordinal, {_KEY("c_name")} as key from customer),
m as (select needle, title, ordinal, case when needle = title then 1 when need = key then 2 when need <> '' and contains(key, need) then 3 end as p from k, t),
r as (select needle, min({{'p': p, 'ordinal': ordinal, 'title': title}}) as m from m where p is not null group by 1)
select needle, m.title as title from n left join r using (needle)""",
    "chunk_window": f"""with {CHUNKS}, x as (select item_id, unnest([0, 1, 2]) as pos from benchmark),
k as (select distinct 'src' || ((item_id + pos) % 22) as source_path, unnest(range(greatest(item_id * 3 + pos - 1, 0), item_id * 3 + pos + 3)) as i from x)
select id, c.source_path, chunk_index, section_id from chunks c semi join k on k.source_path = c.source_path and i = chunk_index""",
    "chunk_id_parse_errors": f"""with x as (select {_ID} as chunk_id from customer), p as (select chunk_id, regexp_extract(chunk_id, '(?s)^(.*)::(.*)$', 1) as path, replace(trim(regexp_extract(chunk_id, '(?s)^(.*)::(.*)$', 2)), '_', '') as raw from x),
e as (select *, case when regexp_matches(raw, '^[+-]?[0-9]+$') then try_cast(raw as int) end as i from p), r as (select *, case when not contains(chunk_id, '::') then 'no separator' when i is null then 'index is no integer' when i < 0 then 'index is negative' end as error from e)
select chunk_id, error, case when error is null then path end as source_path, case when error is null then i end as chunk_index from r""",
    "section_chunks": f"with {CHUNKS} select source_path, chunk_index, id, '[CHUNK_ID: ' || source_path || '::' || chunk_index || '] [SECTION_ID: ' || section_id || '] [SECTION: ' || section_title || ']' || chr(10) || content as rendered from chunks where source_path = 'src4' and section_id = 'fr'",
    "quote_resolution": f"""with {CHUNKS}, s as (select item_id as answer_id, unnest([0, 1, 2]) as pos from benchmark), k as (select answer_id, pos, 'src' || ((answer_id + pos) % 22) as sp, (answer_id * 3 + pos) as ci from s)
select answer_id, pos, sp || '::' || ci as chunk_id, md5(nullif(content, '')) as quote_md5, length(nullif(content, ''))::int as quote_chars from k left join chunks c on c.source_path = sp and c.chunk_index = ci""",
    "synthesis_context": f"""with {CHUNKS}, f as (select source_path, chunk_index, content as c, row_number() over (partition by source_path order by chunk_index) as r from chunks qualify r <= 20)
select source_path, chunk_index, sum(length(c)) over (partition by source_path order by chunk_index)::bigint as used_chars from f qualify used_chars <= 45000""",
    "dedupe_returned": f"""with {T.STEPS_SQL}, f as (select *, row_number() over (partition by run, key order by ts, event_id) = 1 as is_new from steps where key is not null)
select run, count(*) filter (is_new) as new_chunks, count(*) filter (not is_new) as already_returned, min(event_id) filter (is_new) as first_event from f group by run""",
    "evidence_first_seen": f"""with {T.STEPS_SQL}, f as (select * from steps where key is not null qualify row_number() over (partition by run, key order by ts, event_id) = 1)
select run, key, event_id, row_number() over (partition by run order by ts, event_id) as evidence_no from f""",
    "file_listing": f"""with {_SECTIONS}, s as (select source_path, count(*) as n from sections group by 1), f as (select r_name as source_path from region union all select distinct source from documents)
select source_path, '- ' || source_path || '  |  source_path: ' || source_path || coalesce('  |  ' || n || ' sections  |  TOC available', '  |  no TOC') as line from f left join s using (source_path)""",
}
