"""Operator 13: benchmark decontamination with suffix arrays of the training texts.

Words are runs of letters and digits after lower-casing A-Z (``APART`` lists the ASCII
bytes that stand between them). An item's windows are its runs of ``WINDOW`` words; an
item of fewer words is one window.

1. Every task turns its documents into shards of about ``SHARD`` words: word numbers in
   the items' vocabulary, 0 for any other word and between documents.
2. A shard's suffixes are sorted (prefix doubling). A suffix with a 0 among its first
   words cannot match, so only those in runs of known words as long as the shortest
   window enter the array.
3. Every test suffix, from any word of an item that a window can start at, is looked up
   in the array by binary search, word by word: what is left after as many words as the
   window has are its occurrences.
4. Occurrences at consecutive words of document and item are one longer match; the runs
   give the longest verbatim matches and where they are.

Documents are read once, without any shuffle; their suffix arrays live in the task. The
items go to every task, ``ITEM_CHARS`` of text at most at a time: larger benchmarks are
taken in slices, each a pass of its own that carries on what was found before.

Words are equal when their 64-bit hashes are.

Defined results: a null text has no words; an item without words has no window; a null
item_id counts as ''; rows of one item_id count as one item; repeated rows of documents
are judged each; without documents or items nothing is hit. Columns of documents with
the names of results (``FOUND``) are replaced. Whole texts are used, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .staging import Stage, documents

WINDOW = 10
#: Words of a shard; characters of items held by a task; occurrences handled at once.
SHARD, ITEM_CHARS, PAIRS = 1 << 20, 32 << 20, 1 << 22

APART = np.zeros(256, bool)
APART[:0x30] = APART[0x3A:0x41] = APART[0x5B:0x61] = APART[0x7B:0x80] = True

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),
        T.StructField("longest_at", T.LongType()),
        T.StructField("longest_item", T.StringType()),
    ]
)
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Items:
    """The test suffixes of some items, as word numbers from 1."""

    def __init__(self, names: list[str], words: list[np.ndarray], window: int):
        self.names = names
        lengths = np.array([len(w) for w in words], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *words])
        self.known = np.unique(every)
        # Items stand one after another, WINDOW zeros at the end.
        self.ids = np.append(self.number(every), np.zeros(window, np.int32))
        k = np.minimum(lengths, window)
        starts = np.where(lengths > 0, lengths - k + 1, 0)
        self.item = np.repeat(np.arange(len(words)), starts)
        first = np.cumsum(lengths) - lengths
        self.at = np.arange(len(self.item)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(first, starts)
        self.k = np.repeat(k, starts)
        self.least = int(self.k.min()) if len(self.k) else window

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0).astype(np.int32)


def suffix_array(ids: np.ndarray, depth: int, least: int = 1) -> np.ndarray:
    """Starts of the suffixes of ids in the order of their first depth numbers.

    Only suffixes that begin with least numbers other than 0 are listed.
    """
    zero = np.append(np.flatnonzero(ids == 0), len(ids))
    known = np.flatnonzero(ids)
    room = zero[np.searchsorted(zero, known)] - known
    rank, h = ids.astype(np.int64), 1
    # Ranks are needed wherever a suffix of the array can look: in runs that are long enough.
    back = known - np.append(-1, zero)[np.searchsorted(zero, known)] - 1
    own = known[room + back >= least]
    order = np.argsort(rank[own], kind="stable")
    while h < depth and len(own):
        # Two numbers in one: the rank of the first h words and that of the next h.
        near = own + h
        after = np.where(near < len(ids), rank[np.minimum(near, len(ids) - 1)], 0)
        key = rank[own] * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.zeros(len(ids), np.int64)
        rank[own[order]] = np.cumsum(np.diff(key, prepend=key[:1] - 1) != 0)
        h *= 2
    own = own[order]
    starts = np.zeros(len(ids), bool)
    starts[known[room >= least]] = True
    return own[starts[own]]


def _bisect(ids: np.ndarray, array: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """For each interval of the array the first suffix whose word at depth is >= x (right: > x)."""
    lo, hi = lo.copy(), hi.copy()
    while len(left := np.flatnonzero(lo < hi)):
        mid = (lo[left] + hi[left]) >> 1
        v = ids[array[mid] + depth]
        up = v <= x[left] if right else v < x[left]
        lo[left[up]] = mid[up] + 1
        hi[left[~up]] = mid[~up]
    return lo


def occurrences(ids: np.ndarray, array: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test suffix, lo, hi): the interval of the array that starts with its window."""
    t = np.arange(len(items.at))
    lo, hi = np.zeros(len(t), np.int64), np.full(len(t), len(array))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for depth in range(int(items.k.max()) if len(t) else 0):
        x = items.ids[items.at[t] + depth]
        lo, hi = _bisect(ids, array, depth, lo, hi, x, False), _bisect(ids, array, depth, lo, hi, x, True)
        left = lo < hi
        t, lo, hi = t[left], lo[left], hi[left]
        whole = items.k[t] == depth + 1
        done.append((t[whole], lo[whole], hi[whole]))
        t, lo, hi = t[~whole], lo[~whole], hi[~whole]
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate([d[i] for d in done] or none) for i in range(3))


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the intervals, and all of their members."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class _Shard:
    """What the items have in some consecutive documents."""

    def __init__(self, numbers: list[np.ndarray], items: Items, window: int):
        lengths = np.array([len(x) for x in numbers], np.int64)
        gap = np.zeros(1, np.int32)
        ids = np.concatenate([x for own in numbers for x in (own, gap)] + [np.zeros(window, np.int32)])
        self.lengths, self.first = lengths, np.cumsum(lengths + 1) - lengths - 1
        array = suffix_array(ids, window, items.least)
        t, lo, hi = occurrences(ids, array, items)
        covered = np.zeros(len(ids) + 1, bool)
        n = len(lengths)
        self.longest, self.at, self.item = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        pairs = [np.zeros(0, np.int64)]
        order = np.argsort(t, kind="stable")  # an item's suffixes stand together
        t, lo, hi = t[order], lo[order], hi[order]
        item = items.item[t]
        ends = np.cumsum(hi - lo)
        begins = np.flatnonzero(np.diff(item, prepend=-1))
        a = 0
        while a < len(t):
            # Whole items of about PAIRS occurrences.
            far = np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")
            b = int(begins[np.searchsorted(begins, far, "right") - 1]) if far < len(t) else len(t)
            if b <= a:
                after = begins[begins > a]
                b = int(after[0]) if len(after) else len(t)
            which, member = _spread(lo[a:b], hi[a:b])
            pos, own = array[member], t[a:b][which]
            for k in np.unique(items.k[own]):
                over = np.zeros(len(ids) + 1, np.int32)
                starts = np.unique(pos[items.k[own] == k])
                over[starts] += 1
                over[starts + k] -= 1
                covered |= np.cumsum(over) > 0
            doc = np.searchsorted(self.first, pos, "right") - 1
            pairs.append(np.unique(doc * len(items.names) + items.item[own]))
            self._runs(pos, items.at[own], items.item[own], items.k[own], doc)
            a = b
        self.pairs = np.unique(np.concatenate(pairs))
        self.covered = covered

    def _runs(self, pos: np.ndarray, at: np.ndarray, item: np.ndarray, k: np.ndarray, doc: np.ndarray) -> None:
        """Occurrences at consecutive words of one document and one item are one match."""
        order = np.lexsort((pos, pos - at))
        pos, at, item, k, doc = pos[order], at[order], item[order], k[order], doc[order]
        new = (np.diff(pos, prepend=-2) != 1) | (np.diff(at, prepend=-2) != 1) | (np.diff(item, prepend=-1) != 0)
        first = np.flatnonzero(new)
        length = np.diff(first, append=len(pos)) - 1 + k[first]
        # Of a document's matches the longest; of equal ones that which comes first.
        best = np.lexsort((item[first], pos[first], -length, doc[first]))
        mine = doc[first][best]
        best = best[np.flatnonzero(np.diff(mine, prepend=-1))]
        d, begin, n = doc[first][best], pos[first][best] - self.first[doc[first][best]], length[best]
        better = (n > self.longest[d]) | (n == self.longest[d]) & (n > 0) & (begin < self.at[d])
        d, begin, n = d[better], begin[better], n[better]
        self.longest[d], self.at[d], self.item[d] = n, begin, item[first][best][better]

    def rows(self, items: Items) -> Iterator[tuple[list[tuple[int, int]], list[str], int, int, str | None]]:
        """Of each document: hit ranges of words, items, the longest match."""
        cut = np.searchsorted(self.pairs, np.arange(len(self.lengths) + 1) * max(1, len(items.names)))
        for i, (a, n) in enumerate(zip(self.first, self.lengths, strict=True)):
            if cut[i] == cut[i + 1]:
                yield [], [], 0, -1, None
                continue
            edge = np.diff(self.covered[a : a + n].astype(np.int8), prepend=0, append=0)
            ranges = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
            names = sorted({items.names[x] for x in (self.pairs[cut[i] : cut[i + 1]] % len(items.names)).tolist()})
            yield ranges, names, int(self.longest[i]), int(self.at[i]), items.names[self.item[i]]


def _joined(a: list[dict], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted([(x["start"], x["end"]) for x in a] + b):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _found(batch: pa.RecordBatch, text: str, items: Items, window: int) -> list[list]:
    """The columns of FOUND for a batch, joined with those that it already has."""
    n_words: list[int] = []
    found: list[tuple] = []
    waiting: list[np.ndarray] = []
    n = 0

    def solve() -> None:
        nonlocal n
        found.extend(_Shard(waiting, items, window).rows(items))
        waiting.clear()
        n = 0

    for _, words in wordhash.chunks(batch.column(text), True, APART):
        numbers = items.number(words.hash)
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            waiting.append(numbers[a:b])
            n_words.append(int(b - a))
            n += int(b - a)
        if n >= SHARD:
            solve()
    if waiting:
        solve()
    before = batch.select(["hits", "items", "longest", "longest_at", "longest_item"]).to_pylist() if "longest_item" in batch.schema.names else [None] * len(found)
    out: list[list] = [[] for _ in FOUND]
    for k, was, (ranges, names, longest, at, item) in zip(n_words, before, found, strict=True):
        if was:
            ranges, names = _joined(was["hits"], ranges), sorted({*was["items"], *names})
            if (-was["longest"], was["longest_at"]) <= (-longest, at) and was["longest"]:
                longest, at, item = was["longest"], was["longest_at"], was["longest_item"]
        for col, value in zip(out, (k, [{"start": s, "end": e} for s, e in ranges], names, longest, at, item), strict=True):
            col.append(value)
    return out


def _slices(bench: DataFrame, item: str, text: str, most: int) -> list[DataFrame]:
    """bench in parts of at most about most characters, dealt by item."""
    total = bench.agg(F.sum(F.length(text))).head()[0] or 0
    parts = -(-total // most)
    if parts < 2:
        return [bench]
    key = F.pmod(F.xxhash64(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text)), F.lit(parts))
    return [bench.where(key == i) for i in range(parts)]


def _items(part: DataFrame, item: str, text: str, window: int) -> Items:
    """Hashed words of one slice; ITEM_CHARS bounds what comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [own.hash[a:b].tobytes() for _, own in wordhash.chunks(batch.column(1), True, APART) for a, b in zip(own.first[:-1], own.first[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(words, pa.binary())], names=["item", "words"])

    names = part.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    rows = names.mapInArrow(run, "item string, words binary").distinct().orderBy("item", "words").collect()
    return Items([r["item"] for r in rows], [np.frombuffer(r["words"], np.uint64) for r in rows], window)


def find_matches(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, most: int = ITEM_CHARS) -> DataFrame:
    """docs without the text, with the columns of FOUND: hits are ranges of words (end
    exclusive), items the sorted ids of items with an occurring window, longest the words
    of the longest verbatim match (0: none) of longest_item, from word longest_at on."""
    stage = Stage(docs.sparkSession, "decontam")
    own = docs.drop(*[f.name for f in FOUND if f.name != text])
    slices = _slices(bench, item, item_text, most)
    for i, part in enumerate(slices):
        items = docs.sparkSession.sparkContext.broadcast(_items(part, item, item_text, window))
        last = i == len(slices) - 1
        fields = [f for f in docs.schema if f.name not in FOUND.names and not (last and f.name == text)]
        names = [f.name for f in fields]
        kind = [_HITS if f.name == "hits" else pa.list_(pa.string()) if f.name == "items" else pa.string() if f.name == "longest_item" else pa.int64() for f in FOUND]

        def run(batches: Iterator[pa.RecordBatch], items=items, names=names, kind=kind) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _found(batch, text, items.value, window)
                arrays = [batch.column(n) for n in names] + [pa.array(v, k) for v, k in zip(found, kind, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *FOUND.names])

        own = own.mapInArrow(run, T.StructType([*fields, *FOUND]))
        if not last:
            own = stage.save(own, f"slice-{i}")
    return own


def decontaminated(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, most: int = ITEM_CHARS) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with all of their columns."""
    own = docs
    for part in _slices(bench, item, item_text, most):
        items = docs.sparkSession.sparkContext.broadcast(_items(part, item, item_text, window))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bare = batch.select([text])
                yield batch.filter(pa.array([not x for x in _found(bare, text, items.value, window)[2]], pa.bool_()))

        own = own.mapInArrow(run, docs.schema)
    return own


def op13_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents and items."""
    found = find_matches(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "longest")


_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: The longest match is the longest run of hit windows of one item at one distance.
SQL = rf"""
with d as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i
    from (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) as w from documents)),
b as (select item, row_number() over () as row, w, least(len(w), {WINDOW}) as k
    from (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) as w from benchmark) where len(w) > 0),
s as (select item, row, k, p, array_to_string(w[p + 1 : p + k], ' ') as win from (select *, unnest(range(len(w) - k + 1)) as p from b)),
ks as (select distinct k from s),
x as (select doc_id, i, k, string_agg(word, ' ') over (partition by doc_id, k order by i rows between current row and {WINDOW - 1} following) as ten, word, count(*) over (partition by doc_id, k) as n from d, ks),
y as (select doc_id, i, k, case when k = {WINDOW} then ten else array_to_string(string_split(ten, ' ')[1:k], ' ') end as win from x where i + k <= n),
m as (select distinct doc_id, i, y.k, item, row, p from y join s on y.k = s.k and y.win = s.win),
h as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from m) group by 1),
r as (select doc_id, item, max(length) as length from (
    select doc_id, item, count(*) - 1 + any_value(k) as length
    from (select *, i - row_number() over (partition by doc_id, row, i - p order by i) as run from m) group by doc_id, item, row, i - p, run) group by 1, 2),
g as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items, max(length) as longest from r group by 1),
c as (select doc_id, count(*) as n_words from d group by 1)
select o.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated, coalesce(longest, 0)::bigint as longest
from documents o left join c using (doc_id) left join h using (doc_id) left join g using (doc_id)
"""
