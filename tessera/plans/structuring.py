"""Named chunking and hierarchy queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import chunking as C
from ..operators import indexing as I
from ..operators import toc as O
from ..sources import shared
from ..sources import tables as T
from . import retrieval


def _parts(spark: SparkSession, d: str, pieces) -> DataFrame:
    rows = T.spread(T.table(spark, d, "documents")).select("doc_id", F.posexplode(pieces(F.col("text"))).alias("part", "piece"))
    return rows.select("doc_id", F.col("part").cast("long").alias("part"), F.length("piece").cast("long").alias("chars"), F.md5("piece").alias("piece_md5"))


def split_sentence_boundary(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d, C.sentence_pieces)


def split_for_embedding(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d, C.embeddable_pieces)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return T.items(spark, d).withColumn("page", (F.col("pos") / 3).cast("int"))


def merge_items(spark: SparkSession, d: str) -> DataFrame:
    return C.merged(_items(spark, d)).select("doc", "pos", "label", "level", "page", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def group_under_sections(spark: SparkSession, d: str) -> DataFrame:
    return O.grouped_under_sections(T.items(spark, d)).select("doc", "pos", "label", "section")


def toc_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return O.hierarchy(O.headings(T.items(spark, d))).select("doc", "id", "level", "n_chunks", "parent_id", F.col("depth").cast("long").alias("depth"), F.array_join("chain", "/").alias("chain"), F.md5("breadcrumb").alias("breadcrumb_md5"))


def toc_hierarchy_deep(spark: SparkSession, d: str) -> DataFrame:
    """Headings of nine levels: a run's steps, of which purchases hold nothing."""
    by = Window.partitionBy("run").orderBy("ts", "event_id")
    heads = T.steps(spark, d).select(F.col("run").alias("doc"), F.row_number().over(by).cast("long").alias("section"), F.concat("tool", F.col("event_id").cast("string")).alias("title"), (F.col("key") % 9 + 1).cast("int").alias("level"), F.when(F.col("tool") == "purchase", 0).otherwise(F.col("key") + 1).cast("long").alias("n_chunks"))
    return O.hierarchy(heads.withColumn("kept", F.col("n_chunks") > 0)).select("doc", "id", "level", "n_chunks", "parent_id", F.col("depth").cast("long").alias("depth"), F.array_join("chain", "/").alias("chain"), F.md5("breadcrumb").alias("breadcrumb_md5"))


def toc_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    return retrieval._sections(spark, d).select("source_path", "section_id", "breadcrumb", F.md5("content").alias("content_md5"))


def toc_render(spark: SparkSession, d: str) -> DataFrame:
    rows = T.catalog(spark, d).select("source_path", "ordinal", "id", "title", F.when(F.col("level") > 1, F.col("level") - 1).alias("depth"), "chunk_count", F.when(F.col("chunk_count") > 0, F.col("chunk_count")).alias("page_start"))
    return O.rendered(rows)


def chunk_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = O.grouped_under_sections(T.items(spark, d)).where("label <> 'section_header'")
    return O.numbered_chunks(rows).select("doc", "section", "pos", "chunk_id", "chunk_index", "position")


def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    n = T.table(spark, d, "nation").join(T.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    r = F.col("n_nationkey") % 5
    cells = n.select("r_name", F.lit(5).alias("n_rows"), F.lit(3).alias("n_cols"), r.alias("r"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), v.alias("text")) for c, v in enumerate((F.col("n_name"), F.col("n_nationkey").cast("string"), F.col("r_name")))])).alias("x"), (r == 0).alias("is_header"), F.col("n_nationkey").alias("seq"))
    # One nation a region and row stays, so that a place has one text.
    one = cells.select("r_name", "n_rows", "n_cols", "r", "x.c", "x.text", "is_header", "seq")
    kept = one.groupBy("r_name", "n_rows", "n_cols", "r", "c").agg(F.max_by("text", "seq").alias("text"), F.max("is_header").alias("is_header"), F.max("seq").alias("seq"))
    return C.table_markdown(kept, ["r_name"])


def table_split(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "p_name", "p_type", F.col("p_size").cast("string"), F.format_string("%.2f", "p_retailprice")), F.lit(" |"))
    body = p.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    text = F.concat(F.lit("| item | kind | number | money |\n| --- | --- | --- | --- |\n| name | type | size | price |\n"), "b")
    rows = body.select("p_brand", F.posexplode(C.table_pieces(text, 600)).alias("part", "piece"))
    return rows.select("p_brand", F.col("part").cast("long").alias("part"), F.length("piece").alias("chars"), F.md5("piece").alias("piece_md5"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = X.sentences(F.col("text"))
    return T.table(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "\x1f")).alias("sentences_md5"))


def passage_pack(spark: SparkSession, d: str) -> DataFrame:
    md = F.regexp_replace("text", r"\n", "\n\n")
    rows = T.table(spark, d, "documents").select("doc_id", F.posexplode(C.passages(md)).alias("no", "piece"))
    return rows.select("doc_id", F.col("no").cast("long").alias("no"), F.md5(F.concat("no", F.lit(":"), "piece")).alias("passage_md5"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The catalog's sections as section records; small ones have no page."""
    s = retrieval._sections(spark, d)
    page = F.when(F.col("chunk_count") > 5, F.col("chunk_count"))
    return s.select("source_path", "ordinal", "section_id", F.col("title").alias("section_title"), "breadcrumb", page.alias("page_start"), F.col("chunk_count").alias("direct_chunk_count"), F.length("content").alias("char_count"), "content")


def section_record_revision(spark: SparkSession, d: str) -> DataFrame:
    return O.revision(_records(spark, d)).select("source_path", "revision", F.col("section_count").cast("long").alias("section_count"))


def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """One digest of the corpus: of every source's digests in order."""
    one = O.fingerprint(T.table(spark, d, "documents"), "source", "doc_id", F.sha2("text", 256))
    return one.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "revision"))), lambda x: F.concat_ws(":", x["source"], x["revision"])), "\n"), 256).alias("fingerprint"))


def section_index_state(spark: SparkSession, d: str) -> DataFrame:
    """Regions as files: without a section tree, with a bad one, not indexed, with a stale
    revision, or with as many records of which one has another id."""
    records = _records(spark, d)
    r = T.table(spark, d, "region")
    files = r.select(F.col("r_name").alias("source_path"), (F.col("r_regionkey") != 4).alias("indexed"), (F.col("r_regionkey") != 3).alias("valid"))
    tocs = O.revision(records.where("source_path <> 'AMERICA'"))
    state = tocs.select("source_path", F.when(F.col("source_path") == "ASIA", "old").otherwise(F.col("revision")).alias("revision"), "section_count")
    swapped = F.when(F.col("section_id") == "n0", F.lit("n999")).otherwise(F.col("section_id"))
    held = records.select("source_path", "ordinal", swapped.alias("section_id"), F.lit(True).alias("embedded"))
    return O.index_states(files, tocs, state, records.where("source_path <> 'AMERICA'"), held)


def _parsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return I.parsed(_items(spark, d))


def index_document(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents, from items to the rows to embed and store."""
    rows = I.chunk_rows(*_parsed(spark, d))
    return rows.select("source_path", "chunk_index", "section_id", "section_title", F.array_join("section_chain", "/").alias("chain"), "label", "page", "position", F.length("content").alias("chars"), F.md5("content").alias("content_md5"))


def document_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section tree that comes with :func:`index_document`."""
    sections, _ = _parsed(spark, d)
    return sections.select("doc", "id", "level", "page_start", "char_count", "chunk_count", "parent_id", F.col("depth").cast("long").alias("depth"), F.array_join("section_chain", "/").alias("chain"), F.md5("breadcrumb").alias("breadcrumb_md5"))


def publish_sections(spark: SparkSession, d: str) -> DataFrame:
    """The catalog's sections published twice in the shared folder, the second time with
    one file only, and read back: each file's current records."""
    records = _records(spark, d)
    toc = records.groupBy("source_path").agg(F.count(F.lit(1)).alias("total_sections"), F.sum("direct_chunk_count").alias("total_chunks"))
    toc = toc.withColumn("toc_json", F.to_json(F.struct(F.struct("total_sections").alias("meta"))))
    path = shared.folder(spark, "published")
    I.publish(path, toc, records)
    again = records.where("source_path = 'ASIA' and ordinal > 0").withColumn("section_title", F.upper("section_title"))
    I.publish(path, toc.where("source_path = 'ASIA'"), again)
    return I.current(spark, path, "sections").select("source_path", "ordinal", "section_id", "section_title", "revision", F.col("section_count").cast("long").alias("section_count"))


def _split_sql(most: int | str, marks: tuple[str, ...], extra: int, rows: str = "documents", key: str = "doc_id", names: tuple[str, str] = ("s", "pieces")) -> str:
    """Common tables of a splitter over rows (key, text); most is a number or a column."""
    strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    char = lambda m: " || ".join(f"chr({ord(c)})" for c in m)
    tests = " ".join(f"when strpos(p, {char(m)}) > 0 then most - strpos(reverse(p), {char(m[::-1])}) - {len(m) - 1} + 1" for m in marks)
    s, pieces = names
    return f"""{s} as (select {key}, ({most})::bigint as most, 0::bigint as part, ''::varchar as piece, text as rest, length(text) <= {most} as done from {rows}
  union all select {key}, most, part + 1, case when cut = 0 then rest else {strip("substr(rest, 1, cut)")} end, case when cut = 0 then '' else {strip("substr(rest, cut + 1)")} end, false
  from (select *, case when length(rest) <= most then 0 else case {tests} else most + {extra} end end as cut from (select *, substr(rest, 1, most) as p from {s} where rest <> '' and not done))),
{pieces} as (select {key}, part - 1 as part, piece from {s} where part > 0 union all select {key}, 0, rest from {s} where part = 0 and done)"""


_PARTS = "select doc_id, part, length(piece) as chars, md5(piece) as piece_md5 from pieces"
_MERGED = f"""{T.ITEMS_SQL}, n as (select *, row_number() over (partition by doc order by pos) as i, pos // 3 as page from items),
w as (select doc, 0::bigint as i, 0::bigint as block, null::bigint as room from (select distinct doc from n)
  union all select w.doc, n.i, block + (label in ('section_header', 'table') or room is null or length(text) > room)::int,
    case when label in ('section_header', 'table') then null
      when room is null and length(text) > {C.SOFT} then case when length(text) <= {C.HARD} then {C.SOFT} - length(text) end
      when room is null then {C.SOFT} - length(text) - 2
      when length(text) > room then case when text <> '' then {C.SOFT} - length(text) end
      else room - 2 - length(text) end
  from w join n on n.doc = w.doc and n.i = w.i + 1),
g as (select doc, block, n.i, n.label, level, page, text from w join n using (doc, i)),
alone as (select doc, block, label, level, page, text from g where label in ('section_header', 'table')),
joined as (select doc, block, regexp_replace(string_agg(text, chr(10) || chr(10) order by i), '^\\s+|\\s+$', '', 'g') as text, arg_min(page, i) as page, doc || ':' || block as k from g where label not in ('section_header', 'table') group by doc, block),
{_split_sql(C.HARD, (". ", chr(10), ", ", " "), 1, "joined", "k")},
every as (select doc, block, 0::bigint as part, label, level, page, text from alone union all select doc, block, part, 'paragraph', null, page, piece from pieces join joined using (k) where piece <> '')"""


_ANCESTORS = """a as (select i.doc, i.section, j.section as anc, j.title as anc_title, j.n_chunks > 0 as kept from h i join h j on j.doc = i.doc and j.section < i.section and not exists (select 1 from h k where k.doc = i.doc and k.section > j.section and k.section <= i.section and k.level <= j.level)),
c as (select doc, section, string_agg('section_' || anc, '/' order by anc) filter (kept) as chain, max(anc) filter (kept) as parent, count(*) filter (kept) as depth,
  coalesce(string_agg(anc_title, ' > ' order by anc) filter (kept) || ' > ', '') || coalesce(string_agg(anc_title, ' > ' order by anc) filter (not kept) || ' > ', '') as lead from a group by all)"""
_TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_PARSED = f"""{_MERGED},
m as (select *, row_number() over (partition by doc order by block, part) as pos, sum((label = 'section_header')::int) over (partition by doc order by block, part)::bigint as section from every),
hd as (select doc, section, text as title, coalesce(nullif(level, 0), 1) as level, page as head_page from m where label = 'section_header'),
bd as (select m.doc, m.section, pos, label, page, m.doc || ':' || pos as q, case when m.section = 0 then m.text else {_TRIM('m.text')} end as text, case when m.section = 0 then 1000000000 else greatest({C.LEAST_BODY}, {C.HARD} - length(title) - 2) end as lim
  from m left join hd using (doc, section) where label <> 'section_header'),
{_split_sql("lim", (". ", chr(10), ", ", " "), 1, "(select * from bd where section = 0 or text <> '')", "q", ("bs", "bp"))},
ec as (select doc, section, pos, part, label, page, piece as body from bp join bd using (q)),
sz as (select doc, section, count(*) as n_chunks, sum(length({_TRIM('body')}))::bigint as char_count, arg_min(page, (pos, part)) as first_page from ec where section > 0 group by all),
h as (select hd.*, coalesce(n_chunks, 0) as n_chunks, char_count, first_page from hd left join sz using (doc, section)),
{_ANCESTORS},
se as (select h.doc, h.section, 'section_' || h.section as id, title, level, coalesce(nullif(head_page, 0), first_page) as page_start, char_count, n_chunks as chunk_count, 'section_' || parent as parent_id, coalesce(depth, 0) as depth, coalesce(chain, '') as chain, coalesce(lead, '') || title as breadcrumb from h left join c using (doc, section) where n_chunks > 0),
ch as (select ec.doc, ec.section, row_number() over (partition by ec.doc order by ec.section, pos, part) as chunk_no, case when ec.section > 0 then row_number() over (partition by ec.doc, ec.section order by pos, part) end as position, label, page, id as section_id, title as section_title, chain,
  case when ec.section = 0 then body else breadcrumb || chr(10) || chr(10) || body end as text from ec left join se using (doc, section)),
ct as (select *, doc || ':' || chunk_no as r from ch where trim(text) <> ''),
{_split_sql(C.EMBEDDED, (". ", chr(10), " "), 0, "ct", "r", ("es", "ep"))}"""
_GROUPED = f"{T.ITEMS_SQL}, g as (select *, sum((label = 'section_header')::int) over (partition by doc order by pos)::bigint as section from items)"
_SECTIONS = retrieval._SECTIONS
_LINE = "repeat('  ', greatest(0, coalesce(nullif(depth, 0), 1) - 1)) || '- [' || id || '] ' || title || '  (' || chunk_count || ' chunks, page ' || coalesce(page_start::varchar, '?') || ')'"
_RECORDS = f"{_SECTIONS}, records as (select source_path, ordinal, section_id, title as section_title, breadcrumb, case when chunk_count > 5 then chunk_count end as page_start, chunk_count as direct_chunk_count, length(content)::int as char_count from sections)"
_JSON = "json_object(" + ", ".join(f"'{c}', {c}" for c in O.REVISED) + ")::varchar"
_REV = lambda rows: f"select source_path, sha256('[' || string_agg({_JSON}, ',' order by ordinal) || ']') as revision, count(*) as n from {rows} group by 1"

QUERIES = {f.__name__: f for f in (split_sentence_boundary, split_for_embedding, merge_items, group_under_sections, toc_hierarchy, toc_hierarchy_deep, toc_breadcrumbs, toc_render, chunk_numbering, table_markdown, table_split, sentence_split, passage_pack, section_record_revision, corpus_fingerprint, section_index_state, index_document, document_sections, publish_sections)}

ORACLE_SQL = {
    "split_sentence_boundary": f"with recursive {_split_sql(C.HARD, ('. ', chr(10), ', ', ' '), 1)} {_PARTS}",
    "split_for_embedding": f"with recursive {_split_sql(C.EMBEDDED, ('. ', chr(10), ' '), 0)} {_PARTS}",
    "merge_items": f"with recursive {_MERGED} select doc, row_number() over (partition by doc order by block, part) - 1 as pos, label, level, page, length(text) as chars, md5(text) as text_md5 from every",
    # The heading, of three lines, stands above each part; rows follow while they fit.
    "table_split": """with recursive r as (select p_brand, row_number() over (partition by p_brand order by p_partkey) as i, '| ' || concat_ws(' | ', p_name, p_type, p_size::varchar, printf('%.2f', p_retailprice)) || ' |' as l from part),
h as (select '| item | kind | number | money |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| name | type | size | price |' as h),
s as (select p_brand, 0::bigint as i, -1::bigint as part, 600::bigint as size from (select distinct p_brand from r)
  union all select s.p_brand, r.i, part + (size + 1 + length(l) > 600)::int, case when size + 1 + length(l) > 600 then length(h) else size end + 1 + length(l) from s join r on r.p_brand = s.p_brand and r.i = s.i + 1, h)
select p_brand, part, length(piece)::int as chars, md5(piece) as piece_md5 from (select p_brand, part, max(h) || chr(10) || string_agg(l, chr(10) order by i) as piece from s join r using (p_brand, i), h group by p_brand, part)""",
    "passage_pack": f"""with recursive l as (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, chr(10), chr(10) || chr(10), 'g'), '\\n\\s*\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as bs from documents),
b as (select doc_id, unnest(range(len(bs))) + 1 as i, unnest(bs) as block from l),
n as (select doc_id, block, i, length(block) as n, starts_with(lower(block), '<table') as t, starts_with(block, '#') as h from b),
s as (select doc_id, 0::bigint as i, 0::bigint as pn, 0::bigint as no, 0::bigint as size, false as open from (select distinct doc_id from b)
  union all select doc_id, i, p, p + (t or not (held + n + 2 < {C.PASSAGE} or h))::int, case when t or not (held + n + 2 < {C.PASSAGE} or h) then 0 else held + n + 2 end, not (t or not (held + n + 2 < {C.PASSAGE} or h))
  from (select s.doc_id, n.i, n, t, h, no + (open and (t or (size + n > {C.PASSAGE} and not h)))::int as p, case when open and (t or (size + n > {C.PASSAGE} and not h)) then 0 else size end as held from s join n on n.doc_id = s.doc_id and n.i = s.i + 1))
select doc_id, pn as no, md5(pn || ':' || string_agg(block, chr(10) || chr(10) order by i)) as passage_md5 from s join n using (doc_id, i) group by doc_id, pn""",
    "group_under_sections": f"with {_GROUPED} select doc, pos, label, section from g",
    "toc_hierarchy_deep": f"""with {T.STEPS_SQL}, h as (select run as doc, row_number() over (partition by run order by ts, event_id) as section, tool || event_id as title, (key % 9 + 1)::int as level, case when tool = 'purchase' then 0 else key + 1 end as n_chunks from steps),
p as (select i.doc, i.section, j.section as up, j.title as up_title, j.n_chunks > 0 as kept, j.level as up_level, min(i.level) over (partition by i.doc, j.section order by i.section) as least from h i join h j on i.doc = j.doc and j.section < i.section),
a as (select doc, section, string_agg('section_' || up, '/' order by up) filter (kept) as chain, count(*) filter (kept) as depth, max(up) filter (kept) as parent,
  string_agg(up_title, ' > ' order by up) filter (kept) as kept_titles, string_agg(up_title, ' > ' order by up) filter (not kept) as other_titles from p where up_level < least group by 1, 2)
select doc, 'section_' || section as id, level, n_chunks, 'section_' || parent as parent_id, coalesce(depth, 0)::bigint as depth, coalesce(chain, '') as chain, md5(concat_ws(' > ', kept_titles, other_titles, title)) as breadcrumb_md5
from h left join a using (doc, section) where n_chunks > 0""",
    "toc_hierarchy": f"""with {_GROUPED}, h as (select doc, section, max(case when label = 'section_header' then text end) as title, max(case when label = 'section_header' then level end) as level, count(*) filter (label <> 'section_header') as n_chunks from g where section > 0 group by all),
{_ANCESTORS}
select h.doc, 'section_' || h.section as id, level, n_chunks, 'section_' || parent as parent_id, coalesce(depth, 0) as depth, coalesce(chain, '') as chain, md5(coalesce(lead, '') || title) as breadcrumb_md5 from h left join c using (doc, section) where n_chunks > 0""",
    "toc_breadcrumbs": f"with {_SECTIONS} select source_path, section_id, breadcrumb, md5(content) as content_md5 from sections",
    "toc_render": f"""with {T.CATALOG_SQL}, r as (select *, case when level > 1 then level - 1 end as depth, case when chunk_count > 0 then chunk_count end as page_start from catalog)
select source_path, 'TOC for: ' || source_path || chr(10) || 'Sections: ' || count(*) || '  |  Total chunks: ' || sum(chunk_count)::bigint || chr(10) || chr(10) || string_agg({_LINE}, chr(10) order by ordinal) as rendered from r group by source_path""",
    "chunk_numbering": f"""with {_GROUPED}, x as (select * from g where label <> 'section_header')
select doc, section, pos, row_number() over (partition by doc order by section, pos)::int as chunk_id, (row_number() over (partition by doc order by section = 0, section, pos) - 1)::int as chunk_index,
  case when section > 0 then row_number() over (partition by doc, section order by pos) end::int as position from x""",
    "table_markdown": """with n as (select r_name, n_nationkey % 5 as r, arg_max(n_name, n_nationkey) as name, max(n_nationkey) as k from nation join region on n_regionkey = r_regionkey group by all),
l as (select r_name, g.r, coalesce('| ' || name || ' | ' || k || ' | ' || r_name || ' |', '|  |  |  |') as line from (select r_name, unnest(range(5)) as r from region) g left join n using (r_name, r)),
h as (select r_name, bool_or(r = 0) as head from n group by 1)
select r_name, string_agg(line || case when r = 0 and head then chr(10) || '| --- | --- | --- |' else '' end, chr(10) order by r) as markdown from l join h using (r_name) group by r_name""",
    "sentence_split": "with s as (select doc_id, list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 10) as s from documents) select doc_id, len(s)::int as n, md5(array_to_string(s, chr(31))) as sentences_md5 from s",
    "section_record_revision": f"with {_RECORDS} select source_path, revision, n as section_count from ({_REV('records')})",
    "corpus_fingerprint": f"""with a as (select source, doc_id // {O.SPAN} as i, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) order by doc_id)) as l from documents group by all),
b as (select source, i // {O.SPAN} as j, sha256(string_agg(i || ':' || l, chr(10) order by i)) as l from a group by all),
s as (select source, sha256(string_agg(j || ':' || l, chr(10) order by j)) as r from b group by all) select sha256(string_agg(source || ':' || r, chr(10) order by source)) as fingerprint from s""",
    "section_index_state": f"""with {_SECTIONS}, t as (select source_path, count(*) as n, bool_or(section_id = 'n0') as swapped from sections where source_path <> 'AMERICA' group by 1), f as (select r_name as source_path, r_regionkey <> 4 as indexed, r_regionkey <> 3 as valid from region),
x as (select f.*, n, swapped, case when n is null then 'MISSING_TOC' when not valid then 'INVALID_TOC' when not indexed then 'SOURCE_NOT_INDEXED' else 'OK' end as status from f left join t using (source_path))
select source_path, status, status = 'OK' and (source_path = 'ASIA' or swapped) as rebuild, status = 'OK' as eligible from x""",
    "index_document": f"""with recursive {_PARSED} select doc::varchar as source_path, (row_number() over (partition by doc order by section_id is null, chunk_no, part) - 1)::int as chunk_index, section_id, section_title, chain, label, page::int as page, position::int as position, length(piece)::int as chars, md5(piece) as content_md5
from ep join ct using (r) where piece <> ''""",
    "document_sections": f"with recursive {_PARSED} select doc, id, level, page_start::int as page_start, char_count, chunk_count, parent_id, depth, chain, md5(breadcrumb) as breadcrumb_md5 from se",
    "publish_sections": f"""with {_RECORDS}, o as (select *, false as again from records where source_path <> 'ASIA' union all select * replace (upper(section_title) as section_title), true from records where source_path = 'ASIA' and ordinal > 0),
v as ({_REV('o')})
select source_path, ordinal, section_id, section_title, revision, n as section_count from o join v using (source_path)""",
}
