"""Encoding whole texts by distinct segments.

Tokenizers whose tokens never cross certain borders can encode each distinct
segment once. The cache is one flat array of ids with a start and a length for
each segment, so a batch of texts becomes ids by two gathers. It is bounded: when
it is full, the segments seen more than once stay.
"""

from __future__ import annotations

import numpy as np

#: Distinct segments that a worker holds by default, and bytes of those longer than LONGEST.
CACHED, LONGEST, LONG_BYTES = 1_000_000, 64, 1 << 22


class _Codes(dict):
    """segment -> number; an unknown segment gets the next number and is listed."""

    def __init__(self, *args):
        super().__init__(*args)
        self.new: list[bytes] = []

    def __missing__(self, segment: bytes) -> int:
        self[segment] = k = len(self)
        self.new.append(segment)
        return k


class SegmentCache:
    """Subclasses give segments(text) and ids_of(segments): all ids, and each one's number."""

    def __init__(self, dtype: np.dtype, most: int = CACHED):
        self.dtype, self.most = np.dtype(dtype), most
        self.code, self.used, self.long = _Codes(), 0, 0
        self.flat = np.zeros(1 << 20, self.dtype)
        self.start, self.length, self.seen = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def segments(self, text: str) -> list[bytes]:
        raise NotImplementedError

    def ids_of(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _evict(self) -> None:
        """Leaves the short segments seen more than once, at most half, the most seen."""
        words = list(self.code)
        seen = self.seen[: len(words)]
        keep = np.flatnonzero(seen > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(np.argsort(-seen, kind="stable")[: self.most // 2])
        keep = np.array([k for k in keep.tolist() if len(words[k]) <= LONGEST], np.int64)
        ids, lengths = self._gathered(keep), self.length[keep]
        self.code, self.used, self.long = _Codes(zip((words[k] for k in keep.tolist()), range(len(keep)), strict=True)), 0, 0
        self.seen[:] = 0
        self._put(0, ids, lengths)

    def _put(self, at: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Holds the ids of segments at, at + 1, …"""
        to, used = at + len(lengths), self.used + len(ids)
        if to > len(self.start):
            self.start, self.length, self.seen = (np.concatenate([x, np.zeros(max(len(x), to), np.int64)]) for x in (self.start, self.length, self.seen))
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), self.dtype)])
        self.flat[self.used : used] = ids
        self.length[at:to] = lengths
        self.start[at:to] = self.used + np.cumsum(lengths) - lengths
        self.used = used

    def _gathered(self, codes: np.ndarray) -> np.ndarray:
        """The ids of segments, one after another."""
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[codes] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.flat[at]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        every: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = self.segments(t)
            counts[i] = len(own)
            every += own
        if len(self.code) > self.most or self.long > LONG_BYTES:
            self._evict()
        known, self.code.new = len(self.code), []
        codes = np.fromiter(map(self.code.__getitem__, every), np.int64, len(every))
        if self.code.new:
            self._put(known, *self.ids_of(self.code.new))
            self.long += sum(len(x) for x in self.code.new if len(x) > LONGEST)
        n = len(self.code)
        self.seen[:n] += np.bincount(codes, minlength=n)
        ends = np.concatenate([[0], np.cumsum(self.length[codes])])
        return self._gathered(codes), np.diff(ends[np.cumsum(counts)], prepend=0)
