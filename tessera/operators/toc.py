"""Sections, hierarchy and chunk numbering of parsed documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import running


def grouped_under_sections(items: DataFrame) -> DataFrame:
    """items with section: the number of the nearest header before, 0 for none."""
    return running(items, ["doc"], ["pos"], {"section": ("sum", (F.col("label") == "section_header").cast("int"))})


def headings(items: DataFrame) -> DataFrame:
    """(doc, section, title, level, n_chunks, kept) of every header, in order."""
    rows = grouped_under_sections(items).where("section > 0")
    head = F.col("label") == "section_header"
    level = F.coalesce(F.nullif("level", F.lit(0)), F.lit(1))
    out = rows.groupBy("doc", "section").agg(F.max(F.when(head, F.col("text"))).alias("title"), F.max(F.when(head, level)).alias("level"), F.count_if(~head).alias("n_chunks"))
    return out.withColumn("kept", F.col("n_chunks") > 0)


#: Headings that one fold takes at a time, and ranges of them.
FOLD = 128


def _pushed(stack: Column, one: Column) -> Column:
    """A heading ends all open ones of its level and deeper."""
    return F.concat(F.filter(stack, lambda s: s["level"] < one["level"]), F.array(one))


def _composed(stack: Column, later: Column) -> Column:
    """The stack after a range of headings, from the one before it and the range's own,
    of which the first entry has the least level."""
    return F.concat(F.filter(stack, lambda s: s["level"] < later[0]["level"]), later)


def hierarchy(heads: DataFrame) -> DataFrame:
    """Kept headings with parent_id, depth, chain and breadcrumb.

    Every heading, kept or not, ends all open ones of its level and deeper, so what is
    open is a stack of rising levels, of any number and size. A range of headings acts
    on a stack in two numbers: how much of it stays (what is above the range's least
    level) and what comes on top (the range's own stack). Headings are folded in ranges
    of FOLD, ranges in ranges again, and each range starts from the stack of those
    before it: a long document is no single task.
    """
    one = lambda x: F.struct(x["section"].alias("section"), x["level"].alias("level"), x["kept"].alias("kept"), x["title"].alias("title"))
    of = F.floor((F.col("section") - 1) / FOLD).cast("long")
    rows = heads.groupBy("doc", of.alias("_r")).agg(F.array_sort(F.collect_list(F.struct("section", "level", "kept", "title", "n_chunks"))).alias("_l"))
    none = F.filter(F.transform("_l", one), lambda x: F.lit(False))
    own = rows.select("doc", "_r", F.aggregate("_l", none, lambda acc, x: _pushed(acc, one(x))).alias("_s"))
    empty = F.filter(F.element_at("_e", 1)["_s"], lambda x: F.lit(False))

    def entered(ranges: Column, start: Column) -> Column:
        """(_r, stack before it) of sorted ranges (_r, _s)."""
        begin = F.struct(start.alias("now"), F.filter(F.transform(ranges, lambda x: F.struct(x["_r"].alias("_r"), start.alias("_s"))), lambda x: F.lit(False)).alias("out"))
        return F.aggregate(ranges, begin, lambda acc, x: F.struct(_composed(acc["now"], x["_s"]).alias("now"), F.concat(acc["out"], F.array(F.struct(x["_r"].alias("_r"), acc["now"].alias("_s")))).alias("out")))["out"]

    spans = own.groupBy("doc", F.floor(F.col("_r") / FOLD).cast("long").alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_r", "_s"))).alias("_e"))
    whole = spans.select("doc", F.struct(F.col("_g").alias("_r"), F.aggregate("_e", empty, lambda acc, x: _composed(acc, x["_s"])).alias("_s")).alias("_one"))
    docs = whole.groupBy("doc").agg(F.array_sort(F.collect_list("_one")).alias("_e"))
    starts = docs.select("doc", F.explode(entered(F.col("_e"), empty)).alias("_x")).select("doc", F.col("_x._r").alias("_g"), F.col("_x._s").alias("_start"))
    before = spans.join(starts, ["doc", "_g"]).select("doc", F.explode(entered(F.col("_e"), F.col("_start"))).alias("_x")).select("doc", F.col("_x._r").alias("_r"), F.col("_x._s").alias("_open"))

    def step(acc: Column, x: Column) -> Column:
        above = F.filter(acc["open"], lambda s: s["level"] < x["level"])
        return F.struct(F.concat(above, F.array(one(x))).alias("open"), F.concat(acc["out"], F.array(F.struct(x.alias("x"), above.alias("all")))).alias("out"))

    nothing = F.filter(F.transform("_l", lambda x: F.struct(x.alias("x"), F.col("_open").alias("all"))), lambda x: F.lit(False))
    folded = F.aggregate("_l", F.struct(F.col("_open").alias("open"), nothing.alias("out")), step)["out"]
    out = rows.join(before, ["doc", "_r"]).select("doc", F.explode(folded).alias("_y")).select("doc", "_y.x.*", F.col("_y.all").alias("_all"))
    kept, skipped = F.filter("_all", lambda x: x["kept"]), F.filter("_all", lambda x: ~x["kept"])
    name = lambda x: F.concat(F.lit("section_"), x["section"].cast("string"))
    chain = F.transform(kept, name)
    title = lambda x: x["title"]
    crumb = F.array_join(F.concat(F.transform(kept, title), F.transform(skipped, title), F.array("title")), " > ")
    out = out.withColumns({"id": F.concat(F.lit("section_"), F.col("section").cast("string")), "chain": chain, "breadcrumb": crumb})
    return out.where("kept").select("doc", "section", "id", "title", "level", "n_chunks", F.element_at(F.when(F.size("chain") > 0, F.col("chain")), -1).alias("parent_id"), F.size("chain").alias("depth"), "chain", "breadcrumb")


def numbered_chunks(rows: DataFrame) -> DataFrame:
    """rows (doc, section, pos) with chunk_id, position and chunk_index.

    Items without a section get the first chunk ids and the last indexes, and no
    position.
    """
    orphan = F.col("section") == 0
    by = Window.partitionBy("doc")
    chunk_id = F.row_number().over(by.orderBy("section", "pos"))
    index = F.row_number().over(by.orderBy(orphan, "section", "pos")) - 1
    position = F.when(~orphan, F.row_number().over(Window.partitionBy("doc", "section").orderBy("pos")))
    return rows.withColumns({"chunk_id": chunk_id, "chunk_index": index, "position": position})


def section_line() -> Column:
    """One line of a rendered table of contents; roots and first children alike."""
    depth = F.greatest(F.lit(0), F.coalesce(F.nullif("depth", F.lit(0)), F.lit(1)) - 1)
    return F.concat(F.repeat(F.lit("  "), depth), F.lit("- ["), "id", F.lit("] "), "title", F.lit("  ("), F.col("chunk_count").cast("string"), F.lit(" chunks, page "), F.coalesce(F.col("page_start").cast("string"), F.lit("?")), F.lit(")"))


def rendered(sections: DataFrame) -> DataFrame:
    """(source_path, rendered) of (source_path, ordinal, id, title, depth, chunk_count, page_start)."""
    lines = sections.withColumn("line", section_line()).groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "line"))).alias("l"), F.sum("chunk_count").alias("chunks"))
    head = F.concat(F.lit("TOC for: "), "source_path", F.lit("\nSections: "), F.size("l").cast("string"), F.lit("  |  Total chunks: "), F.col("chunks").cast("string"), F.lit("\n\n"))
    return lines.select("source_path", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("rendered"))


#: Fields of a section that a revision covers; canonical JSON has them in this order.
REVISED = ("breadcrumb", "char_count", "direct_chunk_count", "ordinal", "page_start", "section_id", "section_title")


def revision(records: DataFrame) -> DataFrame:
    """(source_path, revision, section_count): SHA-256 of the canonical JSON (sorted keys,
    no spaces, nulls written) of each file's section records in order. A file's lines pass
    through the digest one by one; they are never held together."""
    line = F.to_json(F.struct(*REVISED), {"ignoreNullFields": "false"})
    rows = records.select("source_path", "ordinal", line.alias("l")).repartition("source_path").sortWithinPartitions("source_path", "ordinal", "l")
    out = pa.schema([("source_path", pa.string()), ("revision", pa.string()), ("section_count", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, digest, n = None, None, 0

        def told() -> pa.RecordBatch:
            digest.update(b"]")
            return pa.record_batch([pa.array([v], f.type) for v, f in zip((path, digest.hexdigest(), n), out, strict=True)], schema=out)

        for batch in batches:
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or p != path:
                    if digest is not None:
                        yield told()
                    path, digest, n = p, hashlib.sha256(b"["), 0
                digest.update((b"," if n else b"") + text.encode())
                n += 1
        if digest is not None:
            yield told()

    return rows.select("source_path", "l").mapInArrow(run, "source_path string, revision string, section_count int")


#: Entries that one row of a fingerprint's level joins, and the levels.
SPAN, SPANS = 4096, 3


def fingerprint(rows: DataFrame, key: str, seq: str, line: Column) -> DataFrame:
    """(key, revision): a digest of each key's lines by the integer column seq.

    Digests of ranges of seq, then of ranges of these ranges, so that no row joins the
    lines of a large key.
    """
    found = rows.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("at"), line.alias("l"))
    for level in range(SPANS):
        to = F.floor(F.col("at") / SPAN).cast("long") if level < SPANS - 1 else F.lit(0).cast("long")
        each = found.groupBy("key", to.alias("to")).agg(F.array_sort(F.collect_list(F.struct("at", "l"))).alias("e"))
        found = each.select("key", F.col("to").alias("at"), F.sha2(F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["at"].cast("string"), x["l"])), "\n"), 256).alias("l"))
    return found.select(F.col("key").alias(key), F.col("l").alias("revision"))


def index_states(files: DataFrame, tocs: DataFrame, state: DataFrame, expected: DataFrame, records: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Status of each file's section index, whether it is to be rebuilt, and whether it
    may be searched.

    files (source_path, indexed, valid); tocs, state (source_path, revision,
    section_count); expected (source_path, ordinal, section_id) of the section trees,
    records (…, embedded) of the index: an index is current if both hold the same set
    of (ordinal, section_id) and every record has a vector. failed (source_path) are
    files of which the rebuilding failed.
    """
    t = tocs.select("source_path", F.col("revision").alias("wanted"), F.col("section_count").alias("n_wanted"))
    s = state.select("source_path", F.col("revision").alias("held"), F.col("section_count").alias("n_held"))
    keys = ["source_path", "ordinal", "section_id"]
    both = expected.select(*keys, F.lit(True).alias("_e")).join(records.select(*keys, F.lit(True).alias("_r"), "embedded"), keys, "full")
    same = F.bool_and(F.col("_e").isNotNull() & F.col("_r").isNotNull() & F.coalesce("embedded", F.lit(False)))
    sets = both.groupBy("source_path").agg(same.alias("same"), F.count("_e").alias("n_expected"))
    out = files.join(t, "source_path", "left").join(s, "source_path", "left").join(sets, "source_path", "left")
    current = F.col("wanted").eqNullSafe(F.col("held")) & F.col("n_wanted").eqNullSafe(F.col("n_held")) & F.coalesce("same", F.lit(True))
    broken = F.lit(False)
    if failed is not None:
        out = out.join(failed.select("source_path", F.lit(True).alias("_failed")), "source_path", "left")
        broken = F.col("_failed").isNotNull()
    status = F.when(F.col("wanted").isNull(), "MISSING_TOC").when(~F.col("valid"), "INVALID_TOC").when(~F.col("indexed"), "SOURCE_NOT_INDEXED").when(~current & broken, "BACKFILL_FAILED").otherwise("OK")
    ok = status == "OK"
    return out.select("source_path", status.alias("status"), (ok & ~current).alias("rebuild"), (ok & (F.coalesce("n_expected", F.lit(0)) >= 1)).alias("eligible"))
