"""Operator 7: substring dedup with fixed-block anchors.

A window is ``window`` consecutive words of one document; a word goes when a
window over it also starts in a document with a smaller doc_id.

1. Index: every document's non-overlapping blocks of ``BLOCK`` words.
2. Probes: its rolling windows of ``BLOCK`` words, of which every ``STRIDE``-th
   suffices: a repeated window holds STRIDE consecutive blocks of the earlier
   document, and as BLOCK and STRIDE have no common factor, one of them lies at
   a multiple of STRIDE in the later one. This needs BLOCK * (STRIDE + 1) <=
   window + 1.
3. A block that meets a probe of another document is a hit. Hits are extended in
   both directions: windows over a hit are hashed whole, the smallest doc_id of
   each is found, and runs of repeated windows are the maximal exact repeats.

Hashes travel packed: a task sends, for each hash range, one row with the hashes of
a chunk of documents, each hash once per chunk however many documents of the chunk
hold it. A passage that a third of the corpus shares costs a chunk one entry, so no
range grows with it. There is a task for about ``SHARD_BYTES`` of input, so what one
holds does not grow with the input either.

Windows are equal when their 64-bit hashes are, and hits only decide which windows
are hashed whole.

Defined results: null texts have no words; texts shorter than the window lose
nothing; a text's own repeats are no repeats (only other, smaller doc_ids
count); rows that share a doc_id are judged each and never against one another;
rows with a null doc_id stay whole and are no reference. Whole texts are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .staging import Stage, documents, n_shards

WINDOW, BLOCK, STRIDE = 50, 11, 3
#: Hashes gathered before a chunk is sent; rows handled at once; the least number of
#: hash ranges, several a task, so that tasks get about as much.
CHUNK, ROWS, RANGES = 1_000_000, 2048, 1024

_PACKED = "part int, ids binary, counts binary, hashes binary"
_REPLY = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])


def _range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of the hash ranges, by the upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pack(ids: np.ndarray, hashes: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """One row a part; entries of a document stand together."""
    order = np.lexsort((ids, part))
    part, ids, hashes = part[order], ids[order], hashes[order]
    runs = np.flatnonzero((np.diff(part, prepend=-2) != 0) | (np.diff(ids, prepend=ids[:1]) != 0))
    counts = np.diff(runs, append=len(part)).astype("<u4")
    run_part, run_ids = part[runs], ids[runs]
    rows = []
    ends = np.append(runs, len(part))
    for p in np.unique(run_part):
        a, b = np.searchsorted(run_part, (p, p + 1))
        rows.append((int(p), run_ids[a:b].tobytes(), counts[a:b].tobytes(), hashes[ends[a] : ends[b]].tobytes()))
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_REPLY)], schema=_REPLY)


class _Gather:
    """Entries (doc_id, hash) of a chunk, resolved and packed when it is full.

    flagged: the lowest bit of a hash says whether it is an index block. Within a
    chunk a hash of several documents is settled at once: with flags all of them
    have a hit; without, all but the smallest doc_id have a repeat.
    """

    def __init__(self, flagged: bool, parts: int):
        self.flagged, self.parts, self.ids, self.hashes, self.n = flagged, parts, [], [], 0

    def add(self, doc_id: int, hashes: np.ndarray) -> None:
        self.ids.append(np.full(len(hashes), doc_id, np.int64))
        self.hashes.append(hashes)
        self.n += len(hashes)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        ids, hashes = np.concatenate(self.ids), np.concatenate(self.hashes)
        self.ids, self.hashes, self.n = [], [], 0
        flag = np.uint64(1 if self.flagged else 0)
        order = np.lexsort((ids, hashes))
        ids, hashes = ids[order], hashes[order]
        bare = hashes | flag
        # Of one document's equal hashes one is left, flagged if any is: the last.
        if self.flagged:
            order = np.lexsort((hashes, ids, bare))
            ids, hashes, bare = ids[order], hashes[order], bare[order]
        last = np.append((bare[1:] != bare[:-1]) | (ids[1:] != ids[:-1]), True)
        ids, hashes, bare = ids[last], hashes[last], bare[last]
        begin = np.append(True, bare[1:] != bare[:-1])
        first = np.flatnonzero(begin)
        size = np.diff(first, append=len(bare))
        sent = hashes[first].copy()
        if self.flagged:
            sent = bare[first] - flag + np.bitwise_or.reduceat(hashes & flag, first)
            told = np.repeat(size > 1, size)
        else:
            told = ~begin
        if told.any():
            yield _pack(ids[told], bare[told], np.full(int(told.sum()), -1))
        yield _pack(ids[first], sent, _range_of(sent, self.parts))


def _exchange(packed: DataFrame, flagged: bool, parts: int, tasks: int) -> DataFrame:
    """(doc_id, found array<binary>): each document's hits if flagged, else repeats.

    Replies are packed by document range, as entries are by hash range, so there
    are as many rows as tasks and ranges, not as documents and tasks.
    """
    spread = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))

    def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for part, i, c, h in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            yield part, np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, "<u4")), np.frombuffer(h, np.uint64)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        told = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for batch in batches:
            for part, i, h in unpacked(batch):
                (ids if part >= 0 else told[0]).append(i)
                (hashes if part >= 0 else told[1]).append(h)
        ids, hashes = np.concatenate(ids), np.concatenate(hashes)
        if len(ids):
            flag = np.uint64(1 if flagged else 0)
            bare = hashes | flag
            order = np.lexsort((ids, bare))
            ids, hashes, bare = ids[order], hashes[order], bare[order]
            first = np.flatnonzero(np.append(True, bare[1:] != bare[:-1]))
            size = np.diff(first, append=len(bare))
            if flagged:
                keep = np.repeat((size > 1) & (np.bitwise_or.reduceat(hashes & flag, first) > 0), size)
            else:
                keep = ids > np.repeat(ids[first], size)
            told[0].append(ids[keep])
            told[1].append(bare[keep])
        ids, hashes = np.concatenate(told[0]), np.concatenate(told[1])
        if len(ids):
            yield _pack(ids, hashes, _range_of(wordhash.mixed(ids.view(np.uint64)), parts))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bytes]] = {}
        for batch in batches:
            for _, i, h in unpacked(batch):
                cut = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                for a, b in zip(cut, np.append(cut[1:], len(i)), strict=True):
                    found.setdefault(int(i[a]), []).append(h[a:b].tobytes())
        every = list(found.items())
        for at in range(0, len(every), ROWS):
            rows = every[at : at + ROWS]
            yield pa.record_batch([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.binary()))], names=["doc_id", "found"])

    dealt = packed.withColumn("to", spread).repartition(tasks, "to").drop("to")
    return dealt.mapInArrow(resolve, _PACKED).repartition(tasks, "part").mapInArrow(collect, "doc_id long, found array<binary>")


def _anchors(docs: DataFrame, parts: int) -> DataFrame:
    """Packed index blocks and probes of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(True, parts)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, words in wordhash.chunks(batch.column(1)):
                runs, limit = words.runs(BLOCK)
                for i in range(len(limit) - 1):
                    own = runs[limit[i] : limit[i + 1]]
                    if len(own) > WINDOW - BLOCK:
                        gather.add(ids[at + i], np.concatenate([own[::BLOCK] | np.uint64(1), own[::STRIDE] & ~np.uint64(1)]))
                if gather.n >= CHUNK:
                    yield from gather.flush()
        yield from gather.flush()

    return docs.mapInArrow(run, _PACKED)


def _with_hits(batch: pa.RecordBatch) -> Iterator[tuple[int, wordhash.Words, int, np.ndarray, np.ndarray]]:
    """(row, words, document in words, window starts over a hit, their hashes)."""
    hits = batch.column("hits").to_pylist()
    for at, words in wordhash.chunks(batch.column("text")):
        blocks, b_at = words.runs(BLOCK)
        whole, w_at = words.runs(WINDOW)
        for i in range(len(b_at) - 1):
            known = np.frombuffer(b"".join(hits[at + i]), np.uint64)
            found = np.flatnonzero(np.isin(blocks[b_at[i] : b_at[i + 1]] | np.uint64(1), known))
            n = w_at[i + 1] - w_at[i]
            over = np.zeros(n + WINDOW + 1, np.int32)
            np.add.at(over, np.maximum(found - (WINDOW - BLOCK), 0), 1)
            np.add.at(over, np.minimum(found, n) + 1, -1)
            starts = np.flatnonzero(np.cumsum(over[:n]) > 0)
            yield at + i, words, i, starts, whole[w_at[i] : w_at[i + 1]][starts]


def _windows(found: DataFrame, parts: int) -> DataFrame:
    """Packed hashes of the windows over a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(False, parts)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids = part.column("doc_id").to_numpy()
                for row, _, _, _, hashes in _with_hits(part):
                    gather.add(ids[row], hashes)
                if gather.n >= CHUNK:
                    yield from gather.flush()
        yield from gather.flush()

    return found.select("doc_id", "text", "hits").mapInArrow(run, _PACKED)


def _removed(found: DataFrame, texts: bool) -> DataFrame:
    """doc_id, sha of all words, n_removed and sha of the words left, where any goes;
    with texts also these words, as kept_text."""
    out = pa.schema([("doc_id", pa.int64()), ("all_sha256", pa.string()), ("n_removed", pa.int64()), ("left_sha256", pa.string()), ("kept_text", pa.string())][: 5 if texts else 4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids, repeats, rows = part.column("doc_id").to_pylist(), part.column("repeats").to_pylist(), []
                for row, words, i, starts, hashes in _with_hits(part):
                    gone = starts[np.isin(hashes, np.frombuffer(b"".join(repeats[row]), np.uint64))]
                    if not len(gone):
                        continue
                    a, b = words.first[i], words.first[i + 1]
                    over = np.zeros(b - a + 1, np.int32)
                    np.add.at(over, gone, 1)
                    np.add.at(over, gone + WINDOW, -1)
                    left = np.cumsum(over[:-1]) == 0
                    data = words.data.tobytes() if len(words.first) == 2 else words.data[words.offsets[i] : words.offsets[i + 1]].tobytes()
                    every = data.split()
                    kept = b" ".join([w for w, keep in zip(every, left.tolist(), strict=True) if keep])
                    rows.append((ids[row], hashlib.sha256(b" ".join(every)).hexdigest(), int((~left).sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if texts else [])))
                yield pa.record_batch([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)], schema=out)

    return found.mapInArrow(run, "doc_id long, all_sha256 string, n_removed long, left_sha256 string" + ", kept_text string" * texts)


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the sha of all words joined by spaces."""
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("all_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                words = [(t or "").encode().split() for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([len(w) for w in words]), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])], schema=out)

    return docs.mapInArrow(run, "doc_id long, n_words long, all_sha256 string")


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(per row: doc_id, n_words, all_sha256; per changed row: see _removed). The texts
    that are left are made and stored only if asked for."""
    stage = Stage(docs.sparkSession, "substrings")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = docs.where("doc_id is not null and text is not null")
    tasks = n_shards(docs)
    parts = max(RANGES, 2 * tasks)
    hits = stage.save(_exchange(_anchors(known, parts), True, parts, tasks).withColumnRenamed("found", "hits"), "hits")
    found = stage.save(known.join(hits, "doc_id"), "found")
    repeats = stage.save(_exchange(_windows(found, parts), False, parts, tasks).withColumnRenamed("found", "repeats"), "repeats")
    removed = stage.save(_removed(found.join(repeats, "doc_id"), texts), "removed")
    stage.drop("hits", "found", "repeats")
    return _base(docs), removed


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    docs = documents(spark, sf_dir)
    base, removed = repeated_windows(docs)
    changed = removed.select("doc_id", "all_sha256", "n_removed", "left_sha256").distinct()
    joined = base.join(changed, ["doc_id", "all_sha256"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left_sha256", "all_sha256").alias("kept_sha256"))
