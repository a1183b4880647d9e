"""Vectorised word and word-sequence hashing over Arrow string columns.

The text kernels of this subpackage (shingles, repeated windows) need a 64-bit
hash of every word and of every run of ``k`` words of every document.  Doing
that with Python strings costs more than everything else together, so this
module works on the UTF-8 bytes of many documents at once: word borders come
from a 256-entry table, word hashes from differences of one prefix sum modulo
2**64, sequence hashes from the word hashes.  Nothing here knows about Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one numpy pass; the arrays take about 60 times this.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_ODD, 1 << 12)
_DOWN = _powers(_INVERSE, 1 << 12)


def _table(which: str, n: int) -> np.ndarray:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(_ODD, 2 * n), _powers(_INVERSE, 2 * n)
    return _UP if which == "up" else _DOWN


class Words:
    """The words of some consecutive documents.

    ``first[i]:first[i + 1]`` are the words of document ``i``; ``start`` and
    ``end`` are byte positions in ``data``; ``hash`` is one uint64 a word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool, apart: np.ndarray = _SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~apart[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        folded = _FOLD[data] if fold else data
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[folded] * _table("up", n)[:n], out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mixed((total[self.end] - total[self.start]) * _table("down", n)[self.start] + length * np.uint64(0xD6E8FEB86659FD93))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and the limits of each document's runs.

        Runs never cross documents; a document of fewer words has none.
        """
        n, n_words = len(self.hash), np.diff(self.first)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(len(self.first), np.int64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * _table("up", n)[:n], out=total[1:])
        at = np.arange(n - k + 1)
        every = mixed((total[k:] - total[:-k]) * _table("down", n)[at] + np.uint64(k))
        doc = np.repeat(np.arange(len(n_words)), n_words)[: len(every)]
        keep = at + k <= self.first[1:][doc]
        return every[keep], np.concatenate([[0], np.cumsum(np.maximum(n_words - k + 1, 0))])


def chunks(text: pa.Array | pa.ChunkedArray, fold: bool = False, apart: np.ndarray = _SPACE) -> Iterator[tuple[int, Words]]:
    """(index of the first document, words) for slices of about CHUNK_BYTES.

    A null text counts as empty. A document is never cut. apart: the bytes that
    stand between words, ASCII space by default.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, text.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, n)
        yield at, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], fold, apart)
        at = to
