"""Operator 6: SentencePiece encoding and decoding as a finite-state transducer.

The model file is compiled into a weighted transducer: the normaliser (dummy
prefix, space to U+2581), a trie of pieces whose arcs end with a piece and its
cost (minus its score), and byte fallback for characters without a piece. An
input is composed with it and the shortest path in the tropical semiring (least
sum of costs) is its encoding.

For a unigram model the costs decide; paths of equal cost may be told apart otherwise
than in the library, which rounds the sums over a whole text. In a BPE model scores are
merge ranks, and a least sum of ranks is not what merging gives (it differs for 65 % of
the distinct segments of the test texts). There the transducer is also composed with an
acceptor of piece pairs: b may follow a only where merging the text of a and b leaves
just a and b. A sequence of which every neighbouring pair holds is the result of merging
the whole, so one path is left and it is the encoding; the tests hold it against the
library.

Paths never cross a border that no piece crosses (before a run of spaces, around
a line feed, between two characters that follow one another in no piece), so each
distinct part is solved once per worker.

Defined results: a null text counts as empty and has no ids; every other text is
encoded whole; decoding returns the text, except that U+2581 in a text becomes a
space, as in the library. A model with a character map or other white-space rules
than the dummy prefix raises. Ids of decode that are unknown or null raise; a
null list decodes to ''. Other columns pass through; a column that has the name
of a new one is replaced.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segments import LONGEST, SegmentCache
from .staging import documents, importable

SPACE, UNIGRAM, BPE = "▁", 1, 2
#: Fixed value: what the library's cost of a character without a piece is above that
#: of the dearest piece.
UNKNOWN = 10.0
#: Segments, pairs and parts of segments that a worker holds; encoding and decoding workers share an
#: executor's memory with the JVM.
SEGMENTS, PAIRS, PARTS = 400_000, 500_000, 200_000
ROWS = 256

_NORMAL, _BYTE = 1, 6
_CHANGE = re.compile(r"(?<=\w)(?=\W)|(?<=\W)(?=\w)")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = varint() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """What a model file says: pieces, scores, kinds, type and white-space rules."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.text, self.score, self.kind = [], [], []
        for number, value in fields:
            if number == 1:
                own = dict(_fields(value))
                self.text.append(own.get(1, b"").decode())
                self.score.append(struct.unpack("<f", own.get(2, bytes(4)))[0])
                self.kind.append(own.get(3, _NORMAL))
        trainer = dict(x for number, value in fields if number == 2 for x in _fields(value))
        rules = dict(x for number, value in fields if number == 3 for x in _fields(value))
        self.type = trainer.get(3, UNIGRAM)
        if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("only an identity normaliser with a dummy prefix is compiled")
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == _BYTE}
        if self.type not in (UNIGRAM, BPE) or len(self.bytes) != 256:
            raise ValueError("a unigram or BPE model with byte fallback is needed")
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == _NORMAL}


class Transducer(SegmentCache):
    """The compiled model."""

    def __init__(self, path: str):
        self.model = Pieces(path)
        super().__init__("<i4", SEGMENTS)
        if any(SPACE in t.lstrip(SPACE) or "\n" in t or " " in t for t in self.model.id):
            raise ValueError("a piece crosses the borders of segments")
        # The trie: a state is {character: (next state, piece or -1, cost)}.
        self.root: dict = {}
        for text, i in self.model.id.items():
            state = self.root
            for c in text[:-1]:
                state = state.setdefault(c, [{}, -1, 0.0])[0]
            arc = state.setdefault(text[-1], [{}, -1, 0.0])
            arc[1], arc[2] = i, -self.model.score[i]
        # Symbols beyond the pieces are characters that only byte fallback can write.
        self.n = len(self.model.text)
        self.fallback = UNKNOWN - min(self.model.score[i] for i in self.model.id.values())
        self.pairs: dict[int, bool] = {}
        # Two characters that follow one another in no piece: no path crosses them.
        self.inside = {t[i : i + 2] for t in self.model.id for i in range(len(t) - 1)}
        self.solved: dict[str, list[int]] = {}

    def segments(self, text: str) -> list[bytes]:
        return re.findall(rb" +[^ \n]*|[^ \n]+|\n", b" " + text.replace(SPACE, " ").encode()) if text else []

    def _symbol(self, c: str) -> int:
        """The symbol of a character without a piece."""
        return self.n + ord(c)

    def surface(self, symbol: int) -> str:
        return self.model.text[symbol] if symbol < self.n else chr(symbol - self.n)

    def merged(self, text: str) -> list[str]:
        """The text's symbols after merging best pairs, leftmost first among equals."""
        parts = list(text)
        rank, score = self.model.id, self.model.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = rank.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the text of a (-1: nothing) and b leaves just a and b."""
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            x, y = self.surface(a) if a >= 0 else "", self.surface(b)
            ok = self.pairs[key] = self.merged(x + y) == ([x, y] if x else [y])
        return ok

    def _only_path(self, text: str) -> list[int] | None:
        """The path that the pair acceptor leaves, or None if a position has two states."""
        n, root, known = len(text), self.root, self.pairs.get
        last: list = [None] * (n + 1)
        back = [0] * (n + 1)
        last[0] = -1
        for i in range(n):
            name = last[i]
            if name is None:
                continue
            key, arc = name << 32, root.get(text[i])
            if arc is None or arc[1] < 0:
                symbol = self._symbol(text[i])
                if self.follows(name, symbol):
                    if last[i + 1] is not None:
                        return None
                    last[i + 1], back[i + 1] = symbol, i
            j = i
            while arc is not None:
                j += 1
                trie, symbol, _ = arc
                if symbol >= 0:
                    ok = known(key | symbol)
                    if ok or (ok is None and self.follows(name, symbol)):
                        if last[j] is not None:
                            return None
                        last[j], back[j] = symbol, i
                arc = trie.get(text[j]) if j < n else None
        at, out = n, []
        while at > 0:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def path(self, text: str) -> list[int]:
        """The shortest path over a normalised text, as symbols.

        For a BPE model one path is left, so costs need not be compared; the general
        search below is for unigram models and for a position with several states.
        """
        if self.model.type == BPE and (only := self._only_path(text)) is not None:
            return only
        n, bpe = len(text), self.model.type == BPE
        # The states reached at each position: {name: (cost, position before, name
        # before, symbol)}. Composed with the pair acceptor a state is named by its
        # last symbol; without it one state a position is enough.
        states: list[dict] = [{} for _ in range(n + 1)]
        states[0][-1] = (0.0, -1, -1, -1)
        root = self.root
        for i in range(n):
            here = states[i]
            if not here:
                continue
            trie, j, arcs = root, i, []
            while j < n:
                arc = trie.get(text[j])
                if arc is None:
                    break
                j += 1
                trie, symbol, cost = arc
                if symbol >= 0:
                    arcs.append((j, symbol, cost))
            if not arcs or arcs[0][0] != i + 1:
                arcs.append((i + 1, self._symbol(text[i]), self.fallback))
            for name, (total, _, _, _) in here.items():
                for j, symbol, cost in arcs:
                    if bpe:
                        if not self.follows(name, symbol):
                            continue
                        to, own = states[j], symbol
                    else:
                        to, own = states[j], 0
                    if own not in to or total + cost < to[own][0]:
                        to[own] = (total + cost, i, name, symbol)
        at, out = n, []
        name = min(states[n], key=lambda s: states[n][s][0])
        while at > 0:
            _, at, name, symbol = states[at][name]
            out.append(symbol)
        return out[::-1]

    def _cut(self, text: str) -> list[str]:
        """The text at places between word characters and others that no piece crosses."""
        at = [i for i in map(re.Match.start, _CHANGE.finditer(text)) if text[i - 1 : i + 1] not in self.inside]
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)] if at else [text]

    def _solved(self, text: str) -> list[int]:
        """Ids of the shortest path over a normalised text."""
        ids = self.solved.get(text)
        if ids is None:
            if len(self.solved) > PARTS:
                self.solved.clear()
            ids = []
            for symbol in self.path(text):
                ids += [symbol] if symbol < self.n else [self.model.bytes[b] for b in chr(symbol - self.n).encode()]
            if len(text) <= LONGEST:
                self.solved[text] = ids
        return ids

    def ids_of(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        ends = []
        for s in segments:
            for part in self._cut(s.decode().replace(" ", SPACE)):
                ids += self._solved(part)
            ends.append(len(ids))
        return np.array(ids, self.dtype), np.diff(ends, prepend=0)


class Decoder:
    """The inverse transducer: bytes of ids."""

    def __init__(self, model: Pieces):
        parts = [bytes([int(t[3:5], 16)]) if k == _BYTE else t.replace(SPACE, " ").encode() if k == _NORMAL else b"" for t, k in zip(model.text, model.kind, strict=True)]
        self.length = np.array([len(p) for p in parts])
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """The texts of lists of n[i] ids that follow one another."""
        lengths = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.start[ids] - ends[:-1], lengths)
        at += np.arange(len(at))
        data, stop = self.flat[at].tobytes(), ends[np.cumsum(n)].tolist()
        return [data[a:b].removeprefix(b" ").decode(errors="replace") for a, b in zip([0, *stop], stop, strict=False)]


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(Pieces(path))


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with ids array<int>, n_ids and ids_crc32 (of little-endian int32) and, under
    the name decoded if one is given, what the ids decode to, in the same pass."""
    importable(df.sparkSession)
    new = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(f"n_{ids}", T.LongType()), T.StructField(f"{ids}_crc32", T.LongType())]
    new += [T.StructField(decoded, T.StringType())] if decoded else []
    held = [x for x in df.schema.fields if x.name == text or x.name not in {y.name for y in new}]
    passed = [x for x in held if x.name not in {y.name for y in new}]
    names = [x.name for x in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found, n = own.encode([t or "" for t in part.column(text).to_pylist()])
                stop = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(found[a:b]) for a, b in zip(stop[:-1], stop[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(found))
                made = [lists, pa.array(n), pa.array(crc, pa.int64())]
                made += [pa.array(decoder(model).decode(found, n), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], names=names + [x.name for x in new])

    return df.select(*[x.name for x in held]).mapInArrow(run, T.StructType(passed + new))


def decode(df: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of an array of ids."""
    importable(df.sparkSession)
    held = [x for x in df.schema.fields if x.name != decoded]
    names = [x.name for x in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column(ids)
                n = lists.value_lengths().fill_null(0).to_numpy()
                texts = own.decode(lists.flatten().to_numpy(), n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, decoded])

    return df.mapInArrow(run, T.StructType([*held, T.StructField(decoded, T.StringType())]))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _same(text: str, decoded: str) -> Column:
    """Whether a text decodes to itself; U+2581 is a space."""
    return F.col(decoded) == F.translate(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def encoded_documents(docs: DataFrame) -> DataFrame:
    """docs with ids, n_ids, ids_crc32 and whether they decode to the text (pipeline stage)."""
    name = "decoded"
    while name in docs.columns:
        name += "_"
    return encode(docs, model_path(), decoded=name).withColumn("round_trip", _same("text", name)).drop(name)


def op6_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded, decoded and compared."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = encode(docs, model_path(), decoded="decoded")
    return found.select("doc_id", F.col("n_ids").alias("n_tokens"), "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), _same("text", "decoded").alias("round_trip"))
