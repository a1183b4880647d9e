"""From parsed items to a published index: sections, chunk payloads, chunk rows, tables.

items (doc, pos, label, level, page, text) are merged, grouped under their headers and
cut into pieces; sections and chunks are two tables of one document each row. A
published index is a folder with three tables. ``toc`` and ``sections`` get a new version
with every publication, ``state`` names the version of each source; a row of ``state`` is
written last, in one commit, so readers see both tables of a version or none of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.shared import CommitLog, ConflictError, file_system
from . import chunking as C
from . import toc as O

#: Fixed value: what stands between a chunk's title and its text.
BELOW = "\n\n"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(title: pd.Series, label: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([C.section_pieces(a, b, t) for a, b, t in zip(title, label, text, strict=True)])


def pieces(title: Column, label: Column, text: Column, hard: int = C.HARD) -> Column:
    """An item's chunk bodies; only items above the limit reach Python."""
    most = F.greatest(F.lit(C.LEAST_BODY), hard - F.length(title) - 2)
    own = X.stripped(text)
    long = F.length(own) > most
    cut = _pieces(F.when(long, title).otherwise(F.lit("")), label, F.when(long, text).otherwise(F.lit("")))
    return F.when(own == "", F.array().cast("array<string>")).when(~long, F.array(own)).otherwise(cut)


def parsed(items: DataFrame, soft: int = C.SOFT, hard: int = C.HARD) -> tuple[DataFrame, DataFrame]:
    """(sections, chunks) of items.

    sections: doc, section, id, title, level, page_start, char_count, chunk_count,
    parent_id, depth, section_chain, breadcrumb, for headers with at least one chunk.
    chunks: doc, chunk_no, id, text, section_id, label, char_count, page, position. A
    section's chunks begin with its breadcrumb; items before the first header are
    chunks as they are.
    """
    rows = O.grouped_under_sections(C.merged(items, soft, hard))
    head = F.col("label") == "section_header"
    heads = rows.where(head).select("doc", "section", F.col("text").alias("title"), F.coalesce(F.nullif("level", F.lit(0)), F.lit(1)).alias("level"), F.col("page").alias("head_page"))
    body = rows.where(~head).join(heads.select("doc", "section", "title"), ["doc", "section"], "left")
    cut = F.when(F.col("section") == 0, F.array("text")).otherwise(pieces(F.coalesce("title", F.lit("")), F.col("label"), F.col("text"), hard))
    each = body.select("doc", "section", "pos", "label", "page", F.posexplode(cut).alias("piece", "body")).withColumn("pos", F.struct("pos", "piece"))
    first = F.min_by("page", "pos")
    sizes = each.where("section > 0").groupBy("doc", "section").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length(X.stripped(F.col("body")))).alias("char_count"), first.alias("first_page"))
    heads = heads.join(sizes, ["doc", "section"], "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))).withColumn("kept", F.col("n_chunks") > 0)
    tree = O.hierarchy(heads).join(heads.select("doc", "section", "char_count", F.coalesce(F.nullif("head_page", F.lit(0)), "first_page").alias("page_start")), ["doc", "section"])
    sections = tree.select("doc", "section", "id", "title", "level", "page_start", "char_count", F.col("n_chunks").alias("chunk_count"), "parent_id", "depth", F.col("chain").alias("section_chain"), "breadcrumb")
    known = sections.select("doc", "section", F.col("id").alias("section_id"), "breadcrumb")
    numbered = O.numbered_chunks(each).join(known, ["doc", "section"], "left")
    text = F.when(F.col("section") == 0, F.col("body")).otherwise(F.concat("breadcrumb", F.lit(BELOW), "body"))
    chunks = numbered.select(
        "doc", F.col("chunk_id").alias("chunk_no"), F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string")).alias("id"), text.alias("text"),
        "section_id", "label", F.length(X.stripped(F.col("body"))).alias("char_count"), "page", "position",
    )
    return sections, chunks


def chunk_rows(sections: DataFrame, chunks: DataFrame, source_kind: str = "local", most: int = C.EMBEDDED) -> DataFrame:
    """Rows to embed and store: texts of at most ``most`` characters with a running
    chunk_index from 0, all section chunks before those without a section."""
    known = sections.select("doc", F.col("id").alias("section_id"), F.col("title").alias("section_title"), "section_chain")
    rows = chunks.where(~X.is_blank(F.col("text"))).join(known, ["doc", "section_id"], "left")
    cut = F.when(F.length("text") <= most, F.array("text")).otherwise(C.embeddable_pieces(F.col("text"), most))
    each = rows.select("doc", "chunk_no", "section_id", "section_title", "section_chain", "page", "label", "position", F.posexplode(cut).alias("part", "content"))
    by = Window.partitionBy("doc").orderBy(F.col("section_id").isNull(), "chunk_no", "part")
    out = each.withColumn("chunk_index", F.row_number().over(by) - 1).withColumns({"source_kind": F.lit(source_kind), "source_path": F.col("doc").cast("string")})
    identity = X.chunk_identity(F.col("source_kind"), F.col("source_path"), F.col("chunk_index"), F.col("section_id"), F.col("section_title"))
    return out.select(identity.alias("id"), "content", "source_kind", "source_path", "chunk_index", "section_id", "section_title", "section_chain", "page", "label", "position")


def tocs(sections: DataFrame, chunks: DataFrame, source_kind: str = "local") -> DataFrame:
    """One row a document: source_path, source_kind, source_name, total_sections,
    total_chunks, toc_json with its meta, toc, sections and orphan chunks."""
    chunk = F.struct("id", "text", "section_id", "label", "char_count", "page", "position")
    of = chunks.groupBy("doc", "section_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", chunk.alias("c")))).alias("l")).select("doc", "section_id", F.transform("l", lambda x: x["c"]).alias("chunks"))
    # Sections without a parent carry no depth and no chain.
    below = F.col("parent_id").isNotNull()
    entry = [F.col("id"), F.col("title"), F.col("page_start"), F.col("char_count"), F.col("chunk_count"), F.col("parent_id"), F.when(below, F.col("depth")).alias("depth"), F.when(below, F.col("section_chain")).alias("section_chain")]
    rows = sections.join(of.withColumnRenamed("section_id", "id"), ["doc", "id"]).select("doc", "section", F.struct(*entry).alias("toc"), F.struct(*entry, "chunks").alias("whole"))
    tree = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("section", "toc"))).alias("t"), F.array_sort(F.collect_list(F.struct("section", "whole"))).alias("s"))
    orphans = of.where("section_id is null").select("doc", F.col("chunks").alias("orphan_chunks"))
    counts = chunks.groupBy("doc").agg(F.count(F.lit(1)).alias("total_chunks"))
    out = counts.join(tree, "doc", "left").join(orphans, "doc", "left")
    total = F.coalesce(F.size("t"), F.lit(0))
    total = F.when(F.col("t").isNull(), 0).otherwise(total)
    none = F.coalesce(F.size("orphan_chunks"), F.lit(0))
    none = F.when(F.col("orphan_chunks").isNull(), 0).otherwise(none)
    name = X.basename(F.col("doc").cast("string"))
    meta = F.struct(name.alias("source"), total.alias("total_sections"), "total_chunks", none.alias("orphan_chunks"))
    empty = lambda c, pick: F.coalesce(F.transform(c, lambda x: x[pick]), F.array())
    whole = F.struct(meta.alias("meta"), empty("t", "toc").alias("toc"), empty("s", "whole").alias("sections"), "orphan_chunks")
    return out.select(F.col("doc").cast("string").alias("source_path"), F.lit(source_kind).alias("source_kind"), name.alias("source_name"), total.alias("total_sections"), "total_chunks", F.to_json(whole).alias("toc_json"))


def section_records(sections: DataFrame, source_kind: str = "local") -> DataFrame:
    """The searchable records of sections: content is the title and, below a parent,
    the breadcrumb."""
    doc = F.col("doc").cast("string")
    title = X.stripped(F.col("title"))
    known = sections.where((title != "") & (F.col("chunk_count") > 0))
    ordinal = (F.row_number().over(Window.partitionBy("doc").orderBy("section")) - 1).cast("long")
    return known.select(
        F.lit(source_kind).alias("source_kind"), doc.alias("source_path"), ordinal.alias("ordinal"), F.col("id").alias("section_id"), title.alias("section_title"), "breadcrumb", "page_start",
        F.col("chunk_count").alias("direct_chunk_count"), F.coalesce("char_count", F.lit(0)).alias("char_count"),
        F.when(F.col("breadcrumb") == title, title).otherwise(F.concat(title, F.lit("\n"), "breadcrumb")).alias("content"),
    )


def publish(path: str, toc: DataFrame, records: DataFrame) -> str:
    """Publishes toc rows and section records together; the version they got.

    All tables are written below a version of their own, then one numbered entry of the
    log names it: readers see the whole version or nothing of it. If another writer's
    entry came first since this call began and has a source in common, ConflictError is
    raised; entries of other sources are no conflict.
    """
    spark = toc.sparkSession
    log = CommitLog(spark, path)
    base, version = log.last(), uuid.uuid4().hex
    at = lambda table, v=version: f"{path}/{table}/version={v}"
    toc.write.parquet(at("toc"))
    records.write.parquet(at("sections"))
    revisions = O.revision(spark.read.schema(records.schema).parquet(at("sections")))
    state = spark.read.schema(toc.schema).parquet(at("toc")).select("source_path").join(revisions, "source_path", "left")
    state.select("source_path", "revision", F.coalesce("section_count", F.lit(0)).alias("section_count")).write.parquet(at("state"))
    own = spark.read.schema(_STATE).parquet(at("state")).select("source_path")

    def disputed(newer: list[tuple[int, dict]]) -> bool:
        theirs = [at("state", e["version"]) for _, e in newer if "version" in e]
        return bool(theirs) and not own.join(spark.read.schema(_STATE).parquet(*theirs), "source_path", "left_semi").isEmpty()

    log.commit({"version": version}, base, disputed)
    return version


_STATE = "source_path string, revision string, section_count int"


def published(path: str, made: Callable[[], tuple[DataFrame, DataFrame]], tries: int = 5) -> str:
    """Publishes what made() gives (toc, records), made anew after each conflict."""
    for left in range(tries - 1, -1, -1):
        try:
            return publish(path, *made())
        except ConflictError:
            if not left:
                raise
    raise AssertionError


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(entry, version) of the log that have not expired."""
    entries = CommitLog(spark, path).entries()
    gone = {v for _, e in entries for v in e.get("expired", [])}
    return [(n, e["version"]) for n, e in entries if "version" in e and e["version"] not in gone]


def _last(spark: SparkSession, path: str, versions: list[tuple[int, str]]) -> DataFrame:
    """(source_path, version, revision, section_count): each source's last entry."""
    state = spark.read.schema(f"{_STATE}, version string").option("basePath", f"{path}/state").parquet(*[f"{path}/state/version={v}" for _, v in versions])
    numbers = F.broadcast(spark.createDataFrame(versions, "entry long, version string"))  # a row a publication
    return state.join(numbers, "version").groupBy("source_path").agg(F.max_by(F.struct("version", "revision", "section_count"), "entry").alias("s")).select("source_path", "s.*")


def current(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of a table (toc or sections) in each source's newest version, with
    their revision. What is published later does not change the result."""
    versions = _versions(spark, path)
    if not versions:
        raise ValueError(f"nothing is published at {path}")
    rows = spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/version={v}" for _, v in versions])
    return rows.join(_last(spark, path, versions), ["source_path", "version"]).drop("version")


def expire(spark: SparkSession, path: str, keep: int = 10) -> list[str]:
    """Deletes versions that no source reads any more, but for the last keep of the log;
    the log says so before the files go. Readers that began before may still want them, so
    keep is more than are published while a query runs."""
    versions = _versions(spark, path)
    if len(versions) <= keep:
        return []
    used = {r["version"] for r in _last(spark, path, versions).select("version").distinct().collect()}
    gone = [v for _, v in versions[: len(versions) - keep] if v not in used]
    if gone:
        log = CommitLog(spark, path)
        log.commit({"expired": gone}, log.last(), lambda newer: False)
        for v in gone:
            for table in ("toc", "sections", "state"):
                fs, at = file_system(spark, f"{path}/{table}/version={v}")
                fs.delete(at, True)
    return gone


def load_tocs(spark: SparkSession, path: str, source_paths: list[str]) -> DataFrame:
    """(source_path, toc_json) of the named sources; nothing is found where nothing can
    be read."""
    schema = "source_path string, toc_json string"
    if not source_paths:
        return spark.createDataFrame([], schema)
    try:
        return current(spark, path, "toc").where(F.col("source_path").isin(*source_paths) & F.try_parse_json("toc_json").isNotNull()).select("source_path", "toc_json")
    except Exception:  # a caller without an index works without one
        return spark.createDataFrame([], schema)


def load_toc_strict(spark: SparkSession, path: str, source_path: str) -> DataFrame:
    """(source_path, total_chunks, toc variant) of one source; JSON that is no object raises."""
    value = F.parse_json("toc_json")
    good = F.when(F.schema_of_variant(value).startswith("OBJECT"), value).otherwise(F.raise_error(F.lit("TOC payload is not an object")).cast("variant"))
    return current(spark, path, "toc").where(F.col("source_path") == source_path).select("source_path", "total_chunks", good.alias("toc"))
