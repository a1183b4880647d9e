"""Parsed documents as tables: references, groups, validity of sections and caches.

elements (doc, ref, kind text|table|group, label, text, page, level) and edges (doc,
parent, ord, child); the body's parent is ``#/body``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V
from ..sources import shared
from . import toc as O
from .scan import running

BODY = "#/body"


def with_override(elements: DataFrame, override: DataFrame | None) -> DataFrame:
    """elements with the markdown text of their ref where there is one; a header's without
    its heading marks."""
    if override is None:
        return elements
    o = override.select("doc", "ref", F.col("text").alias("_o"))
    bare = F.when(F.col("label") == "section_header", F.regexp_replace("_o", r"^#{1,6}\s+", "")).otherwise(F.col("_o"))
    return elements.join(o, ["doc", "ref"], "left").withColumn("text", F.coalesce(bare, "text")).drop("_o")


def _group_paths(elements: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """(doc, parent, path) of the groups below root, of any depth.

    Pointer jumping: every group knows an ancestor and the path from it, and takes over
    its ancestor's ancestor, so what is known doubles each round. A round in which no
    group reaches the root is the last; what never does is not below it.
    """
    spark = elements.sparkSession
    groups = elements.where("kind = 'group'").select("doc", F.col("ref").alias("node"))
    known = edges.select("doc", F.col("child").alias("node"), F.col("parent").alias("above"), F.array("ord").alias("path")).join(groups, ["doc", "node"])
    at, step = shared.folder(spark, "groups"), 0

    def saved(df: DataFrame) -> DataFrame:
        df.write.parquet(f"{at}/{step}")
        return spark.read.schema(df.schema).parquet(f"{at}/{step}")

    known = saved(known.withColumn("new", F.lit(True)))
    most = known.count()
    below = F.col("above") == root
    while not known.where(below & F.col("new")).isEmpty():
        step += 1
        if 2 ** (step - 1) > 2 * most:
            raise ValueError("a group is inside itself")
        ahead = known.select("doc", F.col("node").alias("above"), F.col("above").alias("_above"), F.col("path").alias("_path"))
        jumped = known.where(~below).join(ahead, ["doc", "above"]).select("doc", "node", F.col("_above").alias("above"), F.concat("_path", "path").alias("path"), F.lit(True).alias("new"))
        known = saved(known.where(below).withColumn("new", F.lit(False)).unionByName(jumped))
    return known.where(below).select("doc", F.col("node").alias("parent"), "path")


def leaves(elements: DataFrame, edges: DataFrame, root: str = BODY) -> DataFrame:
    """(doc, path, ref, …) of texts and tables below root, in reading order, whatever the
    depth of their groups; references to nothing (and pictures) drop out. path is the order
    key."""
    known = elements.where("kind <> 'group'").select("doc", F.col("ref").alias("child"), "kind", "label", "text", "page", "level")
    top = edges.where(F.col("parent") == root).withColumn("path", F.array("ord"))
    deep = edges.join(_group_paths(elements, edges, root), ["doc", "parent"]).withColumn("path", F.concat("path", F.array("ord")))
    rows = top.unionByName(deep).join(known, ["doc", "child"])
    return rows.select("doc", "path", F.col("child").alias("ref"), "kind", "label", "text", "page", "level")


def _first_page(rows: Column) -> Column:
    return F.get(F.filter(F.transform(rows, lambda x: x["page"]), lambda p: p.isNotNull()), F.lit(0))


def flattened_groups(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, ref, text, page): each top-level group with what is in it as one text, parts
    divided by a space, and its first page."""
    tops = elements.where("kind = 'group'").join(edges.where(F.col("parent") == BODY).select("doc", F.col("child").alias("ref")), ["doc", "ref"], "left_semi").select("doc", "ref")
    rows = leaves(elements, edges).withColumn("top", F.col("path")[0])
    of = edges.where(F.col("parent") == BODY).select("doc", F.col("ord").alias("top"), F.col("child").alias("group_ref"))
    out = rows.join(of, ["doc", "top"]).groupBy("doc", F.col("group_ref").alias("ref")).agg(F.array_sort(F.collect_list(F.struct("path", "text", "page"))).alias("l"))
    return tops.join(out.select("doc", "ref", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"), _first_page(F.col("l")).alias("page")), ["doc", "ref"])


def body_items(elements: DataFrame, edges: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """(doc, pos, label, level, page, text) of a document's body in reading order.

    What stands in the body itself is an item. In a group, at any depth, headers are items;
    other texts and tables are joined to one paragraph up to the next header or inner
    group. A group without either that is blank as a whole is left out.
    """
    known = with_override(elements, override)
    rows = leaves(known, edges).withColumn("stops", (F.col("kind") == "text") & F.coalesce(F.col("label") == "section_header", F.lit(False)))
    inner = _group_paths(elements, edges, BODY).where(F.size("path") > 1).select("doc", "path", F.lit(True).alias("stops"))
    events = rows.unionByName(inner, allowMissingColumns=True).withColumn("group", F.slice("path", F.lit(1), F.size("path") - 1))
    events = running(events, ["doc", "group"], ["path"], {"run": ("sum", F.col("stops").cast("int"))})
    alone = (F.size("group") == 0) | F.col("stops")
    single = events.where(alone & F.col("kind").isNotNull()).select("doc", "path", "label", "level", "page", "text")
    runs = events.where(~alone).groupBy("doc", "group", "run").agg(F.array_sort(F.collect_list(F.struct("path", "text", "page"))).alias("l"))
    plain = events.where(F.size("group") > 0).groupBy("doc", "group").agg((~F.bool_or("stops")).alias("flat"))
    joined = runs.join(plain, ["doc", "group"]).select("doc", F.element_at("l", 1)["path"].alias("path"), F.lit("grouped_paragraph").alias("label"), F.lit(None).cast("int").alias("level"), _first_page(F.col("l")).alias("page"), F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"), "flat")
    every = single.unionByName(joined.where(~(F.col("flat") & X.is_blank(F.col("text")))).drop("flat"))
    numbered = running(every, ["doc"], ["path"], {"_no": ("count", F.lit(1))})
    return numbered.select("doc", (F.col("_no") - 1).cast("long").alias("pos"), "label", "level", "page", "text")


def toc_problems(tocs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_path, valid): total_chunks is positive and the number of chunks, each
    with an id, text and the section it stands in (none for orphans).

    tocs (source_path, total_chunks, meta_total); chunks (source_path, in_section,
    section_id, chunk_id, text).
    """
    good = ~X.is_blank(F.col("chunk_id")) & ~X.is_blank(F.col("text")) & F.col("section_id").eqNullSafe(F.col("in_section"))
    per = chunks.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"), F.bool_and(good).alias("good"))
    valid = (F.col("total_chunks") > 0) & (F.col("total_chunks") == F.col("meta_total")) & (F.col("n") == F.col("total_chunks")) & F.col("good")
    return tocs.join(per, "source_path", "left").select("source_path", F.coalesce(valid, F.lit(False)).alias("valid"))


def cache_problems(sources: DataFrame, rows: DataFrame, tocs: DataFrame) -> DataFrame:
    """(source_path, valid): a valid section tree and at least one chunk, each with
    text, kind ``local``, an index from 0 and a finite vector."""
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = ~X.is_blank(F.col("content")) & (F.col("source_kind") == "local") & (F.col("chunk_index") >= 0) & (F.size("embedding") > 0) & finite
    per = rows.groupBy("source_path").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good"))
    out = sources.select("source_path").join(per, "source_path", "left").join(tocs, "source_path", "left")
    return out.select("source_path", F.coalesce(F.col("good") & F.col("valid"), F.lit(False)).alias("valid"))


#: Texts that a model gets in one call.
EMBED_BATCH = 96


def embedded(rows: DataFrame, model, column: str = "content", most: int = 2048, prefix: str = "", batch: int = EMBED_BATCH, unit: bool = True) -> DataFrame:
    """rows with embedding, by a factory model() -> (list of texts -> array of vectors).

    The seam for real models: loaded once per worker, called with at most ``batch``
    texts of at most ``most`` characters. Vectors are scaled to unit length unless unit
    is false.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for texts in batches:
            cut = [(prefix + (t or ""))[:most] for t in texts]
            made = [v for at in range(0, len(cut), batch) for v in encode(cut[at : at + batch])]
            yield pd.Series([list(map(float, v)) for v in made], dtype=object)

    found = rows.withColumn("embedding", run(F.col(column)))
    return found.withColumn("embedding", V.normalised(F.col("embedding"))) if unit else found


def sentence_index(chunks: DataFrame, key: list[str]) -> DataFrame:
    """(key, sent_id, sentence) of each chunk's sentences."""
    return chunks.select(*key, F.posexplode(X.sentences(F.col("content"))).alias("sent_id", "sentence"))


def chunks_hash(chunks: DataFrame, document: str, key: str) -> DataFrame:
    """(document, chunks_hash): a digest of each document's chunks by the integer column key."""
    return O.fingerprint(chunks, document, key, F.sha2("content", 256)).withColumnRenamed("revision", "chunks_hash")


def build_sentence_index(chunks: DataFrame, document: str, key: str, model, name: str, path: str) -> None:
    """Writes each document's sentences with unit vectors, the model's name and the digest
    of its chunks; a document's partition is replaced as a whole."""
    rows = embedded(sentence_index(chunks, [document, key]), model, "sentence")
    rows = rows.join(chunks_hash(chunks, document, key), document).withColumn("model_name", F.lit(name))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(document).parquet(path)


def index_matches(chunks: DataFrame, document: str, key: str, name: str, path: str) -> DataFrame:
    """(document, matches): whether there is an index of this model and these chunks."""
    spark = chunks.sparkSession
    wanted = chunks_hash(chunks, document, key)
    try:
        held = spark.read.parquet(path).select(F.col(document).cast(wanted.schema[document].dataType).alias(document), "model_name", F.col("chunks_hash").alias("_held")).distinct()
    except AnalysisException:  # no index yet
        return wanted.select(document, F.lit(False).alias("matches"))
    same = (F.col("_held") == F.col("chunks_hash")) & (F.col("model_name") == name)
    return wanted.join(held, document, "left").groupBy(document).agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("matches"))


def parsed_with_cache(files: DataFrame, parse, path: str, schema: str = "array<string>") -> DataFrame:
    """files (file, file_hash, content) with result, by a parser that runs on contents not
    parsed before; new results are added to the cache (file_hash, result) below path."""
    spark = files.sparkSession
    try:
        held = spark.read.schema(f"file_hash string, result {schema}").parquet(path)
    except AnalysisException:  # no cache yet
        held = spark.createDataFrame([], f"file_hash string, result {schema}")
    new = files.join(held.select("file_hash"), "file_hash", "left_anti").dropDuplicates(["file_hash"])
    done, _ = isolated(new, parse, "content", schema)
    done.select("file_hash", "result").write.mode("append").parquet(path)
    cache = spark.read.schema(f"file_hash string, result {schema}").parquet(path).dropDuplicates(["file_hash"])
    return files.select("file", "file_hash").join(cache, "file_hash", "left")


def isolated(rows: DataFrame, kernel, column: str, schema: str = "array<string>") -> tuple[DataFrame, DataFrame]:
    """(results, failures): kernel on each row; an error concerns its row only."""
    @F.pandas_udf(f"struct<result: {schema}, error: string>")
    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append((kernel(v), None))
            except Exception as e:  # any error of a parser is the row's result
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["result", "error"])

    done = rows.withColumn("_r", run(F.col(column)))
    return done.where("_r.error is null").withColumn("result", F.col("_r.result")).drop("_r"), done.where("_r.error is not null").withColumn("error", F.col("_r.error")).drop("_r")
