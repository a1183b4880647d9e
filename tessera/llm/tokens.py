"""Operator 5: token-ID output as Arrow files of fixed-size sequences.

A corpus becomes numbered shards. ``shard-N.tokens.arrow`` is an Arrow IPC file
of record batches of fixed-size lists, ``ids`` (``LENGTH`` token ids). Only the last
sequence of a shard has padding, so ``shard-N.masks.arrow`` holds the two masks there
are, as fixed-size lists of one byte an id (1 for a token; Arrow's booleans are single
bits, which numpy cannot view): that of all full sequences and that of the last. Documents, each closed by ``end_id``, follow one another
across sequences in ascending doc_id. ``shard-N.docs.arrow`` has doc_id, start
(within the shard) and n_tokens. The lists are uncompressed buffers, so sequence
and mask i of a memory-mapped file are views, found by division.

Defined results: a null text counts as empty (the end id alone); repeated rows
with one doc_id are documents of their own, ordered by text; null doc_ids come
first; an empty table gives no documents. Documents of any length are encoded
whole. Words are cut at ASCII white space, which no token of this kind of
vocabulary crosses (one of another kind raises), and each distinct word is encoded
once per worker; ids equal those of encoding the whole text, which the tests hold them
against.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .segments import SegmentCache
from .staging import Stage, importable, n_shards

LENGTH, SEQUENCES = 1024, 512
#: Rows encoded at once; distinct words in one call of the library.
ROWS, WORDS = 512, 10_000
#: Characters by which rows of one doc_id are dealt out.
HEAD = 64


class WordEncoder(SegmentCache):
    """Token ids of whole texts, by distinct words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        super().__init__("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        whole, apart = self._ids([" ab  cd\t\r\nef\x0b\x0cgh "])[0], self._ids(["ab", "cd", "ef", "gh"])
        if whole != sum(apart, []):
            raise ValueError("tokens of this vocabulary cross white space")
        # A special token between words tells their ids apart in one call.
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        good = [(t, i) for t, i in special.items() if self._ids([f"ab{t}cd"])[0] == [*apart[0], i, *apart[1]]]
        self.mark, self.mark_id = good[-1] if good else (None, -1)

    def segments(self, text: str) -> list[bytes]:
        return text.encode().split()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._part([w.decode() for w in segments[at : at + WORDS]]) for at in range(0, len(segments), WORDS)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _part(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.mark:
            ids = np.array(self._ids([self.mark.join(words)])[0], self.dtype)
            marks = np.flatnonzero(ids == self.mark_id)
            if len(marks) == len(words) - 1:
                return np.delete(ids, marks), np.diff(marks, prepend=-1, append=len(ids)) - 1
        # No mark, or a word that holds it: one by one.
        each = self._ids(words)
        return np.array([i for x in each for i in x], self.dtype), np.array([len(x) for x in each], np.int64)

    def documents(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end id after each text, and how many each text has."""
        ids, n = self.encode(texts)
        return np.insert(ids, np.cumsum(n), end_id), n + 1


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class ShardWriter:
    """Writes one shard batch by batch; only unfinished sequences are held."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, width: np.dtype, length: int):
        self.fs, self.path, self.length, self.width = fs, path, length, width
        kind = pa.from_numpy_dtype(width)
        self.schema = pa.schema([("ids", pa.list_(kind, length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [fs.open_output_stream(f"{path}.tokens.arrow"), fs.open_output_stream(f"{path}.docs.arrow")]
        self.tokens, self.docs = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], self.docs_schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0

    def _write(self, ids: np.ndarray) -> None:
        self.tokens.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length)], schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(n) - n
        self.docs.write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(n)], schema=self.docs_schema))
        self.n_tokens += len(ids)
        self.n_docs += len(n)
        self.held.append(ids)
        self.n_held += len(ids)
        unit = self.length * SEQUENCES
        if self.n_held >= unit:
            every = np.concatenate(self.held)
            for at in range(0, len(every) - unit + 1, unit):
                self._write(every[at : at + unit])
            self.held = [every[len(every) // unit * unit :].copy()]
            self.n_held = len(self.held[0])

    def close(self) -> None:
        if self.n_held:
            every = np.concatenate(self.held)
            full = np.zeros(-(-len(every) // self.length) * self.length, self.width)
            full[: len(every)] = every
            self._write(full)
        for x in (self.tokens, self.docs, *self.sinks):
            x.close()
        left = self.n_tokens % self.length or self.length
        masks = np.concatenate([np.ones(self.length, np.uint8), (np.arange(self.length) < left).astype(np.uint8)])
        schema = pa.schema([("mask", pa.list_(pa.uint8(), self.length))])
        with self.fs.open_output_stream(f"{self.path}.masks.arrow") as sink, pa.ipc.new_file(sink, schema) as out:
            out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(masks), self.length)], schema=schema))


class Shard:
    """Random access to a shard; views where the file can be mapped."""

    def __init__(self, path: str):
        fs, at = pa.fs.FileSystem.from_uri(path)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        opened = lambda end: pa.ipc.open_file(pa.memory_map(at + end) if local else fs.open_input_file(at + end))
        self.tokens, self.docs, self.masks = opened(".tokens.arrow"), opened(".docs.arrow"), opened(".masks.arrow").get_batch(0).column("mask").values
        self.length = self.tokens.schema.field("ids").type.list_size
        batches = self.tokens.num_record_batches
        self.n_sequences = (batches - 1) * SEQUENCES + self.tokens.get_batch(batches - 1).num_rows if batches else 0
        self._at, self._batch = -1, None

    def _values(self, batch: int) -> pa.Array:
        if batch != self._at:
            self._at, self._batch = batch, self.tokens.get_batch(batch)
        return self._batch.column("ids").values

    def sequence(self, i: int) -> np.ndarray:
        b, k = divmod(i, SEQUENCES)
        return self._values(b).to_numpy(zero_copy_only=True)[k * self.length : (k + 1) * self.length]

    def mask(self, i: int) -> np.ndarray:
        k = int(i == self.n_sequences - 1)
        return self.masks.to_numpy(zero_copy_only=True)[k * self.length : (k + 1) * self.length].view(bool)

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the shard."""
        unit, out = self.length * SEQUENCES, []
        while n > 0:
            b, k = divmod(start, unit)
            got = self._values(b).to_numpy(zero_copy_only=True)[k : k + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, np.uint16)])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, shards: int | None = None, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> list[dict]:
    """Writes docs in ascending doc_id; returns the shards in order.

    A shard is one range of doc_ids (rows of one doc_id are divided by how their texts
    begin) and one task; there is one for about SHARD_BYTES
    of input, and as many entries: {path, base (tokens before it), n_tokens, n_docs}.
    """
    spark = docs.sparkSession
    importable(spark)
    shards = shards or n_shards(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards, F.col("doc_id"), F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name, draft = f"{root}/shard-{task.partitionId():06d}", f"{root}/draft-{task.partitionId():06d}-{task.taskAttemptId()}"
        own, out = encoder(vocabulary), None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = out or ShardWriter(fs, draft, own.dtype, length)
                out.add(part.column(0), *own.documents(part.column(1).to_pylist(), end_id))
        if out:
            out.close()
            for end in (".tokens.arrow", ".docs.arrow", ".masks.arrow"):
                fs.move(draft + end, name + end)
            yield pa.record_batch({"shard": pa.array([task.partitionId()], pa.int32()), "n_tokens": pa.array([out.n_tokens]), "n_docs": pa.array([out.n_docs])})

    found = sorted(rows.mapInArrow(run, "shard int, n_tokens long, n_docs long").collect())
    manifest, base = [], 0
    for x in found:
        manifest.append({"path": f"{path}/shard-{x.shard:06d}", "base": base, "n_tokens": x.n_tokens, "n_docs": x.n_docs})
        base += x.n_tokens
    return manifest


def read_documents(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "path string, base long"
    table = spark.createDataFrame([(x["path"], x["base"]) for x in manifest], schema).repartition(max(1, len(manifest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(path)
                for b in range(shard.docs.num_record_batches):
                    docs = shard.docs.get_batch(b)
                    start, n = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(shard.span(s, k).astype("<u4")) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                    yield pa.record_batch({"doc_id": docs.column("doc_id"), "start": pa.array(start + base), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())})

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: encode, write, read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, Stage(spark, "tokens").path("shards"), public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_documents(spark, manifest)
