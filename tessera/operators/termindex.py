"""A kept index of terms: BM25 without a look at the texts.

An index is a folder. Each append adds a segment of two tables:

* ``docs``: one row a document (ordinal, range, length in terms, the columns kept for
  filters and results), no text;
* ``postings``, in folders by a hash of the term: blocks of a term and range of ``RANGE``
  documents, with the documents that hold it, how often, at which positions, and the
  block's largest frequency and least length. A block is flat arrays: ordinals from the
  first one on, where each document's positions end, and the positions.

Texts are not shuffled: ordinals are dealt out as they are read, so the documents of a range
are in one task, which makes the range's blocks. A range that is read in two parts, or has
more than ``TOKENS`` terms, has several blocks of a term; each is whole by itself. Only
blocks are shuffled, once, to their folders.

Ranges are the same for all terms, so the sum of the terms' bounds is a bound of every
score in the range. A search reads the headers of its terms' blocks, takes the ranges of
the largest bounds first, and then only those whose bound reaches the k-th score found.

Sources are deleted by naming the ordinals of their documents, range by range. A log of
commits says which segments and deletions count, so readers see all of one or nothing.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import CommitLog, file_system, importable
from ..sources.tables import input_bytes
from .retrieval import IDF_FLOOR, K1, LEG, B, query_tokens

#: Documents of a range, ranges that a search starts with, and bytes of input a bucket and
#: a file of it.
RANGE, FIRST, BUCKET_BYTES, FILE_BYTES = 1024, 32, 128 << 20, 16 << 20
#: Terms of documents that a task holds at once, of one row that is handed to it, and of
#: blocks that are sent together.
TOKENS, PIECE, SENT = 1 << 20, 4096, 1 << 19
_SLACK = 1e-9
_MADE = "term string, _range long, n int, cf long, max_tf int, min_dl int, base long, ords array<int>, ends array<int>, at array<int>"
_BLOCK = f"{_MADE}, bucket int"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))


def _blocks(ranges: int, rows: list[tuple[int, int, int, pa.Array]]) -> pa.RecordBatch:
    """The blocks of a range's pieces of documents: (ordinal, length, first position, terms)."""
    coded = pa.concat_arrays([r[3] for r in rows]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    sizes = np.array([len(r[3]) for r in rows])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.array([r[0] for r in rows], np.int64), sizes)
    dl = np.repeat(np.array([r[1] for r in rows], np.int64), sizes)
    at = np.arange(len(code)) + np.repeat(np.array([r[2] for r in rows], np.int64) - begin, sizes)
    # Stable, so documents and positions stay in order within a term.
    order = np.argsort(code, kind="stable")
    code, doc, dl, at = code[order], doc[order], dl[order], at[order]
    first = np.concatenate([[True], code[1:] != code[:-1]])  # of a term
    own = first | np.concatenate([[True], doc[1:] != doc[:-1]])  # of a document in a term
    starts, heads = np.flatnonzero(first), np.flatnonzero(own)
    ends = np.append(starts[1:], len(code))
    tails = np.append(heads[1:], len(code))
    block = np.cumsum(first)[heads] - 1
    opens = np.searchsorted(block, np.arange(len(starts)))
    return pa.record_batch(
        [
            coded.dictionary.take(pa.array(code[starts])).cast(pa.string()), pa.array(np.full(len(starts), ranges), pa.int64()),
            pa.array(np.bincount(block), pa.int32()), pa.array(ends - starts, pa.int64()),
            pa.array(np.maximum.reduceat(tails - heads, opens), pa.int32()), pa.array(np.minimum.reduceat(dl[heads], opens), pa.int32()),
            pa.array(doc[starts], pa.int64()), _lists(doc[heads] - doc[starts][block], np.append(opens[1:], len(heads))),
            _lists(tails - starts[block], np.append(opens[1:], len(heads))), _lists(at, ends),
        ],
        names=[f.split()[0] for f in _MADE.split(", ")],
    )


def _made(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (_range, _ord, _dl, first, terms) in the order of ordinals."""
    held, held_range, size = [], None, 0
    for batch in batches:
        terms = batch.column("terms")
        for i, (r, o, dl, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_range", "_ord", "_dl", "first")), strict=True)):
            # A document is not divided, or its frequency would be.
            if held and (r != held_range or (size >= most and o != held[-1][0])):
                yield _blocks(held_range, held)
                held, size = [], 0
            held_range = r
            held.append((o, dl, first, terms[i].values))
            size += len(held[-1][3])
    if held:
        yield _blocks(held_range, held)


def _bucket(term: bytes, buckets: int) -> int:
    return zlib.crc32(term) % buckets


def _sent(blocks: list[pa.RecordBatch], buckets: int, files: int) -> pa.RecordBatch:
    """(file, blocks): the blocks by the file that they go to, a file's as an Arrow stream."""
    every = pa.concat_batches(blocks)
    crc = np.array([zlib.crc32(t) for t in every.column("term").cast(pa.binary()).to_pylist()], np.int64)
    bucket = crc % buckets  # as _bucket has it
    file = bucket * files + crc // buckets % files
    order = np.argsort(file, kind="stable")
    every = every.append_column("bucket", pa.array(bucket, pa.int32())).take(pa.array(order))
    starts = np.flatnonzero(np.diff(file[order], prepend=-1))
    streams = []
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, every.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(every.slice(a, b - a))
        streams.append(sink.getvalue().to_pybytes())
    return pa.record_batch([pa.array(file[order][starts], pa.int32()), pa.array(streams, pa.binary())], names=["file", "blocks"])


def _packed(blocks: Iterator[pa.RecordBatch], buckets: int, files: int, most: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in blocks:
        held.append(batch)
        size += pc.sum(batch.column("cf")).as_py()
        if size >= most:
            yield _sent(held, buckets, files)
            held, size = [], 0
    if held:
        yield _sent(held, buckets, files)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for stream in batch.column("blocks"):
            yield from pa.ipc.open_stream(stream.as_buffer())


class TermIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)

    # Writing

    def append(self, rows: DataFrame, content: str = "content", kept: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Adds a segment of rows; every column but content is kept. The entry's number.
        What kept adds to the columns that are kept is found without the texts."""
        segment = uuid.uuid4().hex
        return self.log.commit(self._written(rows, segment, content, kept), self.log.last(), lambda newer: False)

    def delete(self, predicate: Column) -> int:
        """Deletes the documents of which the kept columns satisfy the predicate."""
        base = self.log.last()
        return self.log.commit(self._deleted(predicate), base, lambda newer: any("segment" in e or "deletion" in e for _, e in newer))

    def replace(self, rows: DataFrame, source: str = "source_path", content: str = "content", kept: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Rows of some sources in the place of what is held of these, in one commit; another
        writer's commit in between is a conflict, as it may hold the same sources."""
        base = self.log.last()
        entry = self._written(rows, uuid.uuid4().hex, content, kept)
        own = self._segments([(base + 1, entry)], "docs").select(source).distinct()
        entry |= self._deleted(None, own)
        return self.log.commit(entry, base, lambda newer: True)

    def _written(self, rows: DataFrame, segment: str, content: str, kept: Callable[[DataFrame], DataFrame] | None) -> dict:
        # Tokens are written once with the ordinals, so that both tables have the same.
        aside = f"{self.path}/aside/{segment}"
        tokens = rows.withColumn("_terms", X.terms(F.coalesce(F.col(content), F.lit("")))).drop(content)
        tokens.withColumns({"_dl": F.size("_terms"), "_ord": F.monotonically_increasing_id()}).write.parquet(aside)
        held, ranges = self.spark.read.parquet(aside), F.floor(F.col("_ord") / RANGE)
        docs = held.drop("_terms")
        (kept(docs) if kept else docs).withColumn("_range", ranges).write.parquet(f"{self.path}/docs/{segment}")
        size = input_bytes(held)
        n_buckets = max(16, size // BUCKET_BYTES)
        n_files = max(1, math.ceil(size / FILE_BYTES / n_buckets))
        cuts = F.transform(F.sequence(F.lit(0), F.col("_dl") - 1, F.lit(PIECE)), lambda i: F.struct(i.alias("first"), F.slice("_terms", i + 1, F.lit(PIECE)).alias("terms")))
        pieces = held.where("_dl > 0").select(ranges.alias("_range"), "_ord", "_dl", F.inline(cuts))
        importable(self.spark)
        sent = pieces.mapInArrow(lambda batches, most=TOKENS, sent=SENT: _packed(_made(batches, most), n_buckets, n_files, sent), "file int, blocks binary")
        blocks = sent.repartitionById(n_buckets * n_files, "file").select("blocks").mapInArrow(_unpacked, _BLOCK)
        blocks.sortWithinPartitions("bucket", "term", "_range").write.partitionBy("bucket").parquet(f"{self.path}/postings/{segment}")
        fs, at = file_system(self.spark, aside)
        fs.delete(at, True)
        total = self.spark.read.parquet(f"{self.path}/docs/{segment}").agg(F.count(F.lit(1)), F.sum("_dl")).head()
        return {"segment": segment, "buckets": n_buckets, "n": total[0], "dl": total[1] or 0}

    def _deleted(self, predicate: Column | None, sources: DataFrame | None = None) -> dict:
        entries = self.log.entries()
        live = self._live(entries)
        if live is None:
            return {"deletion": None, "n_deleted": 0, "dl_deleted": 0}
        gone = live.where(predicate) if sources is None else live.join(sources, sources.columns, "left_semi")
        name = uuid.uuid4().hex
        gone.groupBy("segment", "_range").agg(F.collect_list("_ord").alias("gone"), F.count(F.lit(1)).alias("n"), F.sum("_dl").alias("dl")).write.parquet(f"{self.path}/deleted/{name}")
        total = self.spark.read.parquet(f"{self.path}/deleted/{name}").agg(F.sum("n"), F.sum("dl")).head()
        return {"deletion": name if total[0] else None, "n_deleted": total[0] or 0, "dl_deleted": total[1] or 0}

    # Reading

    def _segments(self, entries: list[tuple[int, dict]], table: str) -> DataFrame | None:
        """A table of all segments, with the segment's name."""
        out = None
        for _, e in entries:
            if "segment" in e:
                part = self.spark.read.parquet(f"{self.path}/{table}/{e['segment']}").withColumn("segment", F.lit(e["segment"]))
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _gone(self, entries: list[tuple[int, dict]]) -> DataFrame | None:
        """(segment, _range, gone): ordinals of deleted documents, a range at most RANGE."""
        names = [e["deletion"] for _, e in entries if e.get("deletion")]
        if not names:
            return None
        return self.spark.read.parquet(*[f"{self.path}/deleted/{n}" for n in names]).groupBy("segment", "_range").agg(F.flatten(F.collect_list("gone")).alias("gone"))

    def _live(self, entries: list[tuple[int, dict]]) -> DataFrame | None:
        docs, gone = self._segments(entries, "docs"), self._gone(entries)
        if docs is None or gone is None:
            return docs
        return docs.join(gone.select("segment", "_range", F.explode("gone").alias("_ord")), ["segment", "_range", "_ord"], "left_anti")

    def documents(self) -> DataFrame | None:
        """The kept columns of all documents that are not deleted."""
        live = self._live(self.log.entries())
        return None if live is None else live.drop("segment", "_range", "_ord", "_dl")

    def _postings(self, entries: list[tuple[int, dict]], words: list[str] | None, places: bool = False) -> DataFrame | None:
        """Blocks of the words (None: of all terms) without deleted documents, their
        positions if asked for. Only the folders of the words' buckets are read."""

        def document(o: Column, i: Column) -> Column:
            begin = F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
            tf = F.get("ends", i) - begin
            own = [(F.col("base") + o).alias("_ord"), tf.alias("tf")]
            return F.struct(*own, F.slice("at", begin + 1, tf).alias("at")) if places else F.struct(*own)

        out = None
        for _, e in entries:
            if "segment" not in e:
                continue
            part = self.spark.read.schema(_BLOCK).parquet(f"{self.path}/postings/{e['segment']}").withColumn("segment", F.lit(e["segment"]))
            if words is not None:
                part = part.where(F.col("bucket").isin(*{_bucket(w.encode(), e["buckets"]) for w in words}) & F.col("term").isin(*words))
            part = part.withColumn("docs", F.transform("ords", document)).drop("base", "ords", "ends", "at")
            out = part if out is None else out.unionByName(part)
        gone = self._gone(entries)
        if out is None or gone is None:
            return out
        joined = out.join(gone, ["segment", "_range"], "left")
        left = F.when(F.col("gone").isNull(), F.col("docs")).otherwise(F.filter("docs", lambda d: ~F.array_contains("gone", d["_ord"])))
        return joined.withColumn("docs", left).drop("gone").withColumn("n", F.size("docs")).where("n > 0").withColumn("cf", F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d["tf"]))

    def statistics(self) -> DataFrame:
        """(term, df, cf, max_tf) of the documents that are not deleted."""
        entries = self.log.entries()
        blocks = self._postings(entries, None)
        if blocks is None:
            return self.spark.createDataFrame([], "term string, df long, cf long, max_tf long")
        most = F.max("max_tf") if self._gone(entries) is None else F.max(F.array_max(F.transform("docs", lambda d: d["tf"])))
        return blocks.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum("cf").cast("long").alias("cf"), most.cast("long").alias("max_tf"))

    def search(self, query: str, k: int = LEG, predicate: Column | None = None, order: tuple[str, ...] = ("source_path", "chunk_index")) -> DataFrame:
        """The k best documents by BM25 with their kept columns, bm25 (less is better) and
        score, as ``retrieval.bm25_topk`` has them: statistics are of all documents
        whatever the filter, a term that the query repeats counts each time, a token with
        ``_`` is a phrase."""
        entries = self.log.entries()
        tokens = query_tokens(query)
        split = {t: tuple(w for w in t.split("_") if w) for t in dict.fromkeys(tokens)}
        words = list(dict.fromkeys(w for own in split.values() for w in own))
        docs = self._segments(entries, "docs")
        if docs is None:
            raise ValueError("nothing is in the index")
        nothing = docs.drop("segment", "_range", "_ord", "_dl").withColumns({"bm25": F.lit(0.0), "score": F.lit(0.0)}).limit(0)
        n = sum(e.get("n", 0) - e.get("n_deleted", 0) for _, e in entries)
        if not words or not n:
            return nothing
        average = sum(e.get("dl", 0) - e.get("dl_deleted", 0) for _, e in entries) / n
        blocks = self._postings(entries, words, any(len(own) > 1 for own in split.values()))
        df = self._frequencies(blocks, split)
        weight = {}
        for t, own in split.items():
            if own:
                idf = math.log((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))
                weight[t] = tokens.count(t) * (idf if idf > 0 else IDF_FLOOR)

        def part(t: str, tf: Column, dl: Column) -> Column:
            # A collection of empty texts has no average; nothing occurs in it either.
            return F.when(tf > 0, weight[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (average or 1)))).otherwise(0.0)

        of = lambda w, c: F.coalesce(F.max(F.when(F.col("term") == w, F.col(c))), F.lit(0))
        heads = blocks.groupBy("segment", "_range").agg(*[of(w, "max_tf").alias(f"m{i}") for i, w in enumerate(words)], F.min("min_dl").alias("dl"))
        number = {w: i for i, w in enumerate(words)}
        most = lambda own: F.least(*[F.col(f"m{number[w]}") for w in own]) if len(own) > 1 else F.col(f"m{number[own[0]]}")
        bound = reduce(lambda a, b: a + b, [part(t, most(own), F.col("dl")) for t, own in split.items() if own])
        bounds = heads.select("segment", "_range", bound.alias("bound"))
        first = bounds.orderBy(F.desc("bound"), "segment", "_range").limit(FIRST).collect()
        if not first:
            return nothing
        ranges = {r["segment"]: [x["_range"] for x in first if x["segment"] == r["segment"]] for r in first}
        here = reduce(lambda a, b: a | b, [(F.col("segment") == s) & F.col("_range").isin(*own) for s, own in ranges.items()])

        def scored(some: DataFrame, meta: DataFrame) -> DataFrame:
            each = some.select("segment", "_range", "term", F.explode("docs").alias("d")).select("segment", "_range", "term", "d.*")
            own = F.struct(*[c for c in each.columns if c in ("tf", "at")])
            per = each.groupBy("segment", "_range", "_ord").agg(*[F.max(F.when(F.col("term") == w, own)).alias(f"w{i}") for i, w in enumerate(words)])
            tf = {t: _phrase([F.col(f"w{number[w]}") for w in own]) for t, own in split.items() if own}
            some_tf = per.select("segment", "_range", "_ord", *[c.alias(f"_tf{i}") for i, c in enumerate(tf.values())])
            total = reduce(lambda a, b: a + b, [part(t, F.col(f"_tf{i}"), F.col("_dl")) for i, t in enumerate(tf)])
            joined = meta.join(some_tf, ["segment", "_range", "_ord"]).withColumn("_total", total)
            return joined.where("_total > 0").drop(*[f"_tf{i}" for i in range(len(tf))])

        meta = docs if predicate is None else docs.where(predicate)
        head = scored(blocks.where(here), meta.where(here))
        # At most FIRST ranges: a few thousand scores, of which the k-th is kept.
        best = head.orderBy(F.desc("_total"), *order).limit(k)
        known = self.spark.createDataFrame(best.collect(), best.schema)
        floor = known.agg(F.count(F.lit(1)), F.min("_total")).head()
        left = bounds.where(~here)
        if floor[0] == k:
            left = left.where(F.col("bound") >= floor[1] - _SLACK)
        rest = scored(blocks.where(~here).join(left.select("segment", "_range"), ["segment", "_range"], "left_semi"), meta)
        every = known.unionByName(rest.select(*known.columns))
        out = every.withColumn("bm25", -F.col("_total")).withColumn("score", 1 / (1 + F.abs("bm25")))
        return out.drop("segment", "_range", "_ord", "_dl", "_total").orderBy("bm25", *order).limit(k)

    def _frequencies(self, blocks: DataFrame, split: dict[str, tuple[str, ...]]) -> dict[str, int]:
        """Documents that hold each token; only phrases need more than the blocks' headers."""
        found = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        out = {t: found.get(own[0], 0) for t, own in split.items() if len(own) == 1}
        phrases = {t: own for t, own in split.items() if len(own) > 1}
        if phrases:
            words = list(dict.fromkeys(w for own in phrases.values() for w in own))
            each = blocks.where(F.col("term").isin(*words)).select("segment", "_range", "term", F.explode("docs").alias("d"))
            per = each.groupBy("segment", "_range", "d._ord").agg(*[F.max(F.when(F.col("term") == w, F.struct("d.tf", "d.at"))).alias(f"w{i}") for i, w in enumerate(words)])
            row = per.agg(*[F.count_if(_phrase([F.col(f"w{words.index(w)}") for w in own]) > 0).alias(f"p{i}") for i, own in enumerate(phrases.values())]).head()
            out |= {t: row[i] for i, t in enumerate(phrases)}
        return out


def _phrase(words: list[Column]) -> Column:
    """How often words (tf, at) stand one after another; a single word's frequency."""
    if len(words) == 1:
        return F.coalesce(words[0]["tf"], F.lit(0))
    follow = lambda p: reduce(lambda a, b: a & b, [F.array_contains(w["at"], p + d) for d, w in enumerate(words) if d])
    whole = reduce(lambda a, b: a & b, [w.isNotNull() for w in words])
    return F.when(whole, F.size(F.filter(words[0]["at"], follow))).otherwise(0)
