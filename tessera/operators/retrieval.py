"""Vector, keyword and fused retrieval; navigation over chunks and sections.

Rankings carry a total order: ties keep the order of a scan (source_path,
chunk_index, id). Wide columns join back after the cut, so scoring reads ids and
vectors only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V
from ..sources import shared
from .containment import containing
from .vectorindex import VectorIndex

#: Depths and constants of fusion.
LEG, FINAL, TOC, K = 30, 5, 10, 60
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
ORDER = ("source_path", "chunk_index", "id")
#: Bounds of a chunk window and of the synthesis context.
WINDOW_MOST, CONTEXT_DOCS, CONTEXT_CHARS = 5, 20, 45_000


#: Needles of a request that are sent to every task and compared with a whole listing.
REQUEST = 32


def vector_scores(rows: DataFrame, query: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with score in the place of their vector, for the one vector of query (column q)."""
    scored = rows.where(F.size(vector) > 0).crossJoin(F.broadcast(query.select("q").limit(1))).withColumn("score", V.cosine(F.col(vector), F.col("q")))
    return scored.where("score is not null").drop("q", vector)


def scored_topk(rows: DataFrame, scores: DataFrame, key: str, k: int = LEG, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The k best rows by the scores (key, score) that they have. Vectors are scored where
    they are read; a shuffle takes narrow rows, whatever size Spark believes they have."""
    return rows.join(scores.hint("merge"), key).orderBy(F.desc("score"), *order).limit(k)


def vector_topk(rows: DataFrame, query: DataFrame, k: int = LEG, vector: str = "embedding", order: tuple[str, ...] = ORDER) -> DataFrame:
    """The k rows nearest to the one vector of query (column q), with score.

    Rows without a vector or of another length don't count. The query is one row
    by contract, so broadcasting it is bounded.
    """
    scored = rows.where(F.size(vector) > 0).crossJoin(F.broadcast(query.select("q").limit(1))).withColumn("score", V.cosine(F.col(vector), F.col("q")))
    return scored.where("score is not null").drop("q").orderBy(F.desc("score"), *order).limit(k or LEG)


def vector_topk_batch(rows: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
    """The k nearest rows (id, embedding) of each query (q), exact: an index of cells is
    built for them, of which only blocks that can hold a neighbour are scored."""
    spark = rows.sparkSession
    index = VectorIndex(spark, shared.folder(spark, "vector-cells")).build(rows)
    found = index.search(queries, k, query_id=query_id)[0]
    kinds = dict(rows.dtypes) | dict(queries.dtypes)
    return found.select(F.col("query_id").cast(kinds[query_id]).alias(query_id), F.col("id").cast(kinds["id"]).alias("id"), "score", "rank")


def query_tokens(query: str) -> list[str]:
    return [t.lower() for t in re.findall("[0-9A-Za-z_]+", query)]


def _tf(terms: Column, token: str) -> Column:
    """How often a token stands in a term array; one with ``_`` is a phrase."""
    words = [w for w in token.split("_") if w]
    if not words:
        return F.lit(0)
    if len(words) == 1:
        return F.size(F.filter(terms, lambda t: t == words[0]))
    starts = F.sequence(F.lit(1), F.greatest(F.size(terms) - len(words) + 1, F.lit(1)))
    return F.size(F.filter(starts, lambda i: reduce(lambda a, b: a & b, [F.get(terms, i - 1 + d) == w for d, w in enumerate(words)])))


def bm25_topk(rows: DataFrame, query: str, k: int = LEG, predicate: Column | None = None, content: str = "content", order: tuple[str, ...] = ("source_path", "chunk_index")) -> DataFrame:
    """The k best rows by BM25, with bm25 (less is better) and score.

    Two scans and one row of statistics, no shuffle of postings: only the query's
    terms are counted, in place. Statistics are of all rows, whatever the filter;
    a term that the query repeats counts each time. The score 1 / (1 + |bm25|)
    falls as matches get better, which only the third key of fusion sees.
    """
    tokens = query_tokens(query)
    distinct = list(dict.fromkeys(tokens))
    if not distinct:
        return rows.limit(0).withColumn("bm25", F.lit(0.0)).withColumn("score", F.lit(0.0))
    counted = rows.withColumn("_terms", X.terms(F.coalesce(F.col(content), F.lit("")))).withColumns({"_dl": F.size("_terms"), **{f"_tf{i}": _tf(F.col("_terms"), t) for i, t in enumerate(distinct)}}).drop("_terms")
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(distinct))])
    seen = counted.where(reduce(lambda a, b: a | b, [F.col(f"_tf{i}") > 0 for i in range(len(distinct))]))
    if predicate is not None:
        seen = seen.where(predicate)

    def part(i: int) -> Column:
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf > 0, idf).otherwise(IDF_FLOOR)
        return tokens.count(distinct[i]) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))

    total = reduce(lambda a, b: a + b, [part(i) for i in range(len(distinct))])
    scored = seen.crossJoin(F.broadcast(stats)).withColumn("bm25", -total).withColumn("score", 1 / (1 + F.abs("bm25")))
    return scored.select(*rows.columns, "bm25", "score").orderBy("bm25", *order).limit(k or LEG)


def like_topk(rows: DataFrame, query: str, k: int = LEG, content: str = "content", order: tuple[str, ...] = ("source_path", "chunk_index")) -> DataFrame:
    """Fallback without an index: any term as a substring, cut in scan order, then
    scored by the share of terms. A ``_`` matches any character in the search only."""
    tokens = query_tokens(query)
    low = F.lower(content)
    if not tokens:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    cut = rows.where(reduce(lambda a, b: a | b, [F.like(low, F.lit(f"%{t}%")) for t in tokens])).orderBy(*order).limit(k)
    hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in tokens])
    return cut.withColumn("score", hits / len(tokens))


def ranked(leg: DataFrame, number: int, keys: list[str], order: list) -> DataFrame:
    """A leg's keys, score and rank; a leg holds at most a few dozen rows."""
    return leg.select(*keys, "score", F.row_number().over(Window.orderBy(*order)).alias("rank"), F.lit(number).alias("leg"))


def fused(legs: list[DataFrame], keys: list[str], k: int) -> DataFrame:
    """Reciprocal-rank fusion of ranked legs.

    By the sum of 1 / (K + rank), then hits, then the best score; what is left
    keeps first-seen order.
    """
    rows = reduce(DataFrame.unionByName, legs)
    out = rows.groupBy(*keys).agg(
        F.sum(1 / (K + F.col("rank"))).alias("rrf"),
        F.count(F.lit(1)).alias("hits"),
        F.max(F.coalesce("score", F.lit(0.0))).alias("best_score"),
        F.min(F.col("leg") * 1_000_000 + F.col("rank")).alias("_seen"),
    )
    return out.orderBy(F.desc(F.round("rrf", 12)), F.desc("hits"), F.desc("best_score"), "_seen").limit(k).drop("_seen")


def hybrid(rows: DataFrame, query: str, vector: DataFrame, k: int = FINAL, predicate: Column | None = None, keys: tuple[str, ...] = ("source_path", "chunk_index"), warn: Callable[[str, Exception], None] | None = None, index=None, vectors: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Vector and keyword legs over chunks, fused by chunk key; index is a term index of
    rows (``termindex.TermIndex``), without one their texts are read. vectors are a table
    with an embedding by a key of rows, and the key; without them rows have embedding.

    With warn, a leg that fails is told and left out; if both fail the second error
    is raised.
    """
    keys = list(keys)
    order = (*keys, "id")
    scoped = rows if predicate is None else rows.where(predicate)
    nearest = lambda: scored_topk(scoped.select(*order, vectors[1]), vector_scores(vectors[0].select(vectors[1], "embedding"), vector), vectors[1], LEG, order) if vectors else vector_topk(scoped.select(*order, "embedding"), vector, LEG, order=order)
    semantic = lambda: ranked(nearest(), 0, keys, [F.desc("score"), *order])
    keyword = lambda: index.search(query, LEG, predicate, tuple(keys)) if index else bm25_topk(rows.select(*order, "section_id", "content"), query, LEG, predicate, order=tuple(keys))
    lexical = lambda: ranked(keyword(), 1, keys, ["bm25", *keys])
    if warn is None:
        return fused([semantic(), lexical()], keys, k)
    legs, failure = [], None
    for name, leg in (("semantic", semantic), ("keyword", lexical)):
        try:
            # A leg is a few dozen rows; it runs here so that its failure is its own.
            found = leg()
            legs.append(rows.sparkSession.createDataFrame(found.collect(), found.schema))
        except Exception as e:
            warn(name, e)
            failure = e
    if not legs:
        raise failure
    return fused(legs, keys, k)


def _scanned(listing: DataFrame, needles: DataFrame, rank: Column, name: str, order: list[str]) -> DataFrame:
    """Each needle's best row of a listing, for a request of few needles."""
    best = listing.crossJoin(F.broadcast(needles)).withColumn("_p", rank).where("_p is not null")
    return best.groupBy(name).agg(F.min(F.struct("_p", *order)).alias("m"))


def resolve_file(wanted: DataFrame, files: DataFrame, few: int = REQUEST) -> DataFrame:
    """(file_id, source_path): exact, then basename containment either way, then the
    folded key. Ties go to the smaller path. Keys are made once a file and once a request;
    a request of more than few needles is looked up by q-grams.
    """
    base = F.lower(X.basename(F.col("source_path")))
    listing = files.select("source_path").distinct().withColumns({"base": base, "b_key": X.match_key(base)})
    needles = wanted.select("file_id", F.lower("file_id").alias("needle")).where("file_id is not null").distinct().withColumn("n_key", X.match_key(F.col("needle")))
    if len(needles.head(few + 1)) <= few:
        # The third rule reads: the base's key starts with or holds the needle's key.
        rank = F.when(F.col("file_id") == F.col("source_path"), 1).when(F.contains("base", "needle") | F.contains("needle", "base"), 2).when(F.contains("b_key", "n_key"), 3)
        best = _scanned(listing, needles, rank, "file_id", ["source_path"])
    else:
        least = F.min("source_path").alias("source_path")
        # Tables of many rows on both sides: shuffled, not collected for a broadcast.
        bases, keys = listing.groupBy("base").agg(least).hint("merge"), listing.groupBy("b_key").agg(least).hint("merge")
        asked = needles.hint("merge")
        held = containing(needles, bases, "needle", "base").toDF("needle", "base")
        holds = containing(bases, needles, "base", "needle").toDF("base", "needle").select("needle", "base")
        by_key = containing(needles, keys, "n_key", "b_key").toDF("n_key", "b_key")
        found = [
            (1, asked.join(listing.select("source_path"), F.col("file_id") == F.col("source_path"))),
            (2, held.unionByName(holds).join(bases, "base").groupBy("needle").agg(least).join(asked, "needle")),
            (3, by_key.join(keys, "b_key").groupBy("n_key").agg(least).join(asked, "n_key")),
            # An empty text is in every other: one row each, the least path there is.
            (2, needles.where("needle = ''").crossJoin(F.broadcast(listing.agg(least)))),
            (2, needles.crossJoin(F.broadcast(listing.where("base = ''").agg(least)))),
            (3, needles.where("n_key = ''").crossJoin(F.broadcast(listing.agg(least)))),
        ]
        rows = reduce(DataFrame.unionByName, [df.select("file_id", F.lit(p).alias("_p"), "source_path") for p, df in found]).where("source_path is not null")
        best = rows.groupBy("file_id").agg(F.min(F.struct("_p", "source_path")).alias("m")).hint("merge")
    return wanted.select("file_id").join(best, "file_id", "left").select("file_id", F.col("m.source_path").alias("source_path"))


def resolve_title(wanted: DataFrame, sections: DataFrame, few: int = REQUEST) -> DataFrame:
    """(needle, title): exact, equal keys, key contained; first in section order. A request
    of more than few needles is looked up by q-grams."""
    listing = sections.select("title", "ordinal").withColumn("key", X.match_key(F.col("title")))
    needles = wanted.select("needle").where("needle is not null").distinct().withColumn("need", X.match_key(F.col("needle")))
    if len(needles.head(few + 1)) <= few:
        rank = F.when(F.col("needle") == F.col("title"), 1).when(F.col("need") == F.col("key"), 2).when((F.col("need") != "") & F.contains("key", "need"), 3)
        best = _scanned(listing, needles, rank, "needle", ["ordinal", "title"])
    else:
        first = F.min(F.struct("ordinal", "title")).alias("o")
        # Tables of many rows on both sides: shuffled, not collected for a broadcast.
        titles, keys = listing.groupBy("title").agg(first).hint("merge"), listing.groupBy("key").agg(first).hint("merge")
        same, alike = F.col("needle") == F.col("title"), F.col("need") == F.col("key")
        # Only needles without a better match are looked up by their runs.
        rest = needles.join(titles, same, "left_anti").join(keys, alike, "left_anti")
        found = [
            (1, needles.join(titles, same)),
            (2, needles.join(keys, alike)),
            (3, containing(rest, keys, "need", "key").toDF("need", "key").join(keys, "key").groupBy("need").agg(F.min("o").alias("o")).join(rest.hint("merge"), "need")),
        ]
        rows = reduce(DataFrame.unionByName, [df.select("needle", F.lit(p).alias("_p"), "o.ordinal", "o.title") for p, df in found])
        best = rows.groupBy("needle").agg(F.min(F.struct("_p", "ordinal", "title")).alias("m")).hint("merge")
    return wanted.select("needle").join(best, "needle", "left").select("needle", F.col("m.title").alias("title"))


def parse_chunk_ids(ids: DataFrame, column: str = "chunk_id") -> DataFrame:
    """ids with source_path, chunk_index and error; the last ``::`` divides."""
    path = F.regexp_extract(column, r"(?s)^(.*)::(.*)$", 1)
    raw = F.regexp_extract(column, r"(?s)^(.*)::(.*)$", 2)
    clean = F.replace(X.stripped(raw), F.lit("_"), F.lit(""))
    index = F.when(clean.rlike(r"^[+-]?[0-9]+$"), clean.try_cast("int"))
    error = F.when(~F.contains(column, F.lit("::")), "no separator").when(index.isNull(), "index is no integer").when(index < 0, "index is negative")
    return ids.withColumn("error", error).withColumn("source_path", F.when(error.isNull(), path)).withColumn("chunk_index", F.when(error.isNull(), index))


def window_keys(keys: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Distinct keys around each key: a range join turned into an equi-join."""
    before, after = (min(max(n, 0), WINDOW_MOST) for n in (before, after))
    spread = F.explode(F.sequence(F.greatest(F.col("chunk_index") - before, F.lit(0)), F.col("chunk_index") + after))
    return keys.select("source_path", spread.alias("chunk_index")).distinct()


def chunk_window(rows: DataFrame, keys: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    return rows.join(window_keys(keys, before, after), ["source_path", "chunk_index"], "left_semi")


def rendered_chunk() -> Column:
    """``[CHUNK_ID: path::index] [SECTION_ID: …] [SECTION: …]`` and the content."""
    tag = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f" [{name}: "), F.col(c), F.lit("]"))).otherwise("")
    return F.concat(F.lit("[CHUNK_ID: "), "source_path", F.lit("::"), F.col("chunk_index").cast("string"), F.lit("]"), tag("SECTION_ID", "section_id"), tag("SECTION", "section_title"), F.lit("\n"), "content")


def returned_once(rows: DataFrame, run: str, seq: list[str], key: list[str]) -> DataFrame:
    """rows with is_new: the first row of a key within a run."""
    return rows.withColumn("is_new", F.row_number().over(Window.partitionBy(run, *key).orderBy(*seq)) == 1)


def context_prefix(rows: DataFrame, group: str, seq: list[str], text: str = "content", most: int = CONTEXT_DOCS, budget: int = CONTEXT_CHARS) -> DataFrame:
    """The first rows of each group, until one would exceed the budget."""
    by = Window.partitionBy(group).orderBy(*seq)
    first = rows.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= most)
    total = F.sum(F.length(text)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("used_chars", total).where(F.col("used_chars") <= budget).drop("_rank")


def quotes(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """sources (answer_id, pos, chunk_id) with exact_quote where the chunk has text."""
    keyed = parse_chunk_ids(sources)
    found = rows.groupBy("source_path", "chunk_index").agg(F.max_by("content", "id").alias("exact_quote"))
    return keyed.join(found, ["source_path", "chunk_index"], "left").select("answer_id", "pos", "chunk_id", F.nullif("exact_quote", F.lit("")).alias("exact_quote"))
