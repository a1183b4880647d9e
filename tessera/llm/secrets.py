"""Operator 10: secret scans with corpus-wide ownership frequency (native).

Base spans come from three patterns, leftmost and without overlap per kind. The
corpus then decides which candidate values are somebody's own: every value of a
span is hashed, hashes are counted by distinct repository and owner, and a value
with one owner looks live while one with many owners is a copied example. The
same count adds spans of kind ``bare``: tokens of mixed character classes that
stand without any keyword, overlap no base span and belong to one owner only.

Defined results: a null text counts as empty and has no spans; a null repository
or owner counts as ''; a span's positions are code points, the end exclusive;
repeated rows are scanned each on their own and share their owner. Whole texts
are scanned whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import Stage, documents

#: kind -> (order, pattern, group of the value, least length of the value).
#: Letters of keywords are spelled in both cases, so that no engine folds others.
_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
KINDS = {
    "assign": (0, rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 18),
    # Runs of 16 and more are what is left of [0-9a-f]+ after the length test: a
    # greedy run always ends where the class ends.
    "hex": (2, r"[0-9a-f]{16,}", 0, 16),
}
BARE = (3, r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
#: Matches of a text whose positions are summed in one block.
RUN = 64
#: Owners from which on a value counts as a copied example.
COPIED_OWNERS = 3


def spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, ord, end, kind, value>> of one pattern, by start.

    A split by the pattern gives what lies between the matches; running sums of
    both lengths are the positions. They are taken in blocks of RUN matches and then
    over the blocks, as an array that grows match by match is copied each time.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.zip_with(F.arrays_zip(found.alias("m"), values.alias("v")), F.slice(gaps, 1, F.size(found)), lambda x, g: F.struct(F.length(g).alias("g"), F.length(x["m"]).alias("m"), x["v"].alias("v")))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        one = F.struct(begin.alias("start"), F.lit(order).alias("ord"), (begin + x["m"]).alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"))
        return F.struct((begin + x["m"]).alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def blocks(every: Column) -> Column:
        n = F.ceil(F.size(every) / RUN).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.aggregate(F.slice(every, b * RUN + 1, F.lit(RUN)), start, step))

    def joined(own: Column) -> Column:
        begins = F.aggregate(own, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        moved = lambda x, by: F.transform(x["out"], lambda y: F.struct((y["start"] + by).alias("start"), y["ord"].alias("ord"), (y["end"] + by).alias("end"), y["kind"].alias("kind"), y["value"].alias("value")))
        return F.flatten(F.zip_with(own, F.slice(begins, F.lit(1), F.size(own)), moved))

    once = lambda value, body: F.transform(F.array(value), body)[0]
    return F.when(text.rlike(pattern), once(once(steps, blocks), joined)).otherwise(none)


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with arrays base and bare (those over base spans too)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*[spans(whole, k, *v) for k, v in KINDS.items()]))
    bare = F.filter(spans(whole, "bare", *BARE), lambda x: _mixed(x["value"]))
    return docs.withColumn("base", base).withColumn("bare", bare).drop(text)


def clear(each: DataFrame) -> DataFrame:
    """Span rows (row_id, s) without the bare ones that overlap a base span of their row.

    One pass from each side instead of pairs: of the base spans that begin no later the
    furthest end counts, of those that begin later the first.
    """
    base = F.col("s.kind") != "bare"
    start = F.col("s.start")
    before = F.max(F.when(base, F.col("s.end"))).over(Window.partitionBy("row_id").orderBy(start).rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, start)).over(Window.partitionBy("row_id").orderBy(-start).rangeBetween(Window.unboundedPreceding, -1))
    known = each.withColumn("_before", before).withColumn("_after", after)
    return known.where(base | ((F.coalesce("_before", F.lit(0)) <= start) & (F.coalesce(F.col("_after"), F.col("s.end")) >= F.col("s.end")))).drop("_before", "_after")


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, n, n_repositories, n_owners of (value_hash, repository, owner).

    Aggregated level by level, so a value that is everywhere shrinks before
    each shuffle.
    """
    by_repository = candidates.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_repositories"))
    return by_owner.groupBy("value_hash").agg(F.sum("n").alias("n"), F.sum("n_repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def find_secrets(docs: DataFrame, repository: Column, owner: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and added spans, ownership counts."""
    stage = Stage(docs.sparkSession, "secrets")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(repository, F.lit("")).alias("repository"), F.coalesce(owner, F.lit("")).alias("owner"))
    found = stage.save(scan(narrow).withColumn("row_id", F.monotonically_increasing_id()), "spans")
    each = found.select("row_id", "repository", "owner", F.explode(F.concat("base", "bare")).alias("s")).withColumn("value_hash", F.sha2("s.value", 256))
    each = clear(each)
    each = stage.save(each.select("row_id", "repository", "owner", "value_hash", F.col("s.start").alias("start"), F.col("s.ord").alias("ord"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind")), "each")
    owned = stage.save(ownership(each), "owned")
    judged = each.join(owned.select("value_hash", "n_owners"), "value_hash")
    live = F.col("n_owners") == 1
    per_row = judged.groupBy("row_id").agg(
        F.collect_list(F.when((F.col("kind") == "bare") & live, F.struct("start", "ord", "end", "kind"))).alias("added"),
        F.count_if(live).alias("n_live"),
        F.count_if(F.col("n_owners") >= COPIED_OWNERS).alias("n_copied"),
    )
    kept = found.join(per_row, "row_id", "left")
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["kind"].alias("kind")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return kept.select("doc_id", base.alias("base"), F.coalesce("added", F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")).alias("added"), zero("n_live"), zero("n_copied"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query; a source is an owner, its part in one language a repository."""
    docs = documents(spark, sf_dir)
    found = find_secrets(docs, F.concat_ws("/", F.col("source"), F.coalesce("lang", F.lit(""))), F.col("source"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_live",
        "n_copied",
    )


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for kind, (order, pattern, group, least) in {**KINDS, "bare": BARE}.items():
        value = f"regexp_extract_all(t, {quoted(pattern)}, {group})"
        parts.append(f"""
  select doc_id, source, {order} as ord, '{kind}' as kind, least, unnest(range(len(m))) as i, unnest(m) as m, unnest(v) as v, unnest(g[:len(m)]) as g
  from (select doc_id, source, {least} as least, regexp_extract_all(t, {quoted(pattern)}) as m, {value} as v, string_split_regex(t, {quoted(pattern)}) as g from d)""")
    return f"""
with d as (select doc_id, coalesce(source, '') as source, coalesce(text, '') as t from documents),
f as ({" union all ".join(parts)}),
p as (select doc_id, source, ord, kind, v, least, length(m) as n, sum(length(g) + length(m)) over (partition by doc_id, kind order by i) as stop from f),
s as (select doc_id, source, ord, kind, v, stop - n as start, stop from p where length(v) >= least),
b as (select * from s where kind <> 'bare'),
x as (select * from s where kind = 'bare' and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')
  and not exists (select 1 from b where b.doc_id = s.doc_id and s.start < b.stop and b.start < s.stop)),
c as (select * from b union all select * from x),
o as (select v, count(distinct source) as owners from c group by v),
j as (select c.*, owners from c join o using (v)),
r as (select doc_id,
    count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, ord) filter (kind <> 'bare') as base,
    string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, ord) filter (kind <> 'bare' or owners = 1) as spans,
    count(*) filter (owners = 1) as n_live, count(*) filter (owners >= {COPIED_OWNERS}) as n_copied
  from j group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from d left join r using (doc_id)
"""


SQL = _sql()
