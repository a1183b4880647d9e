"""Operator 11: spelling variants by two-dimensional range reporting.

Two words are near when one edit (a code point inserted, deleted or replaced) turns one
into the other. For an edit at position i of a word w the other word begins with w[:i]
and ends with w[i+1:] (replaced) or w[i:] (inserted; a deletion is an insertion seen from
the other side). Words are points: rank in forward order, rank in reverse order. Those
that begin with a prefix are an interval of the first, those that end with a suffix an
interval of the second, so each edit position of each word is one rectangle, and a wavelet
tree over the reverse ranks reports the points in it.

1. The vocabulary is counted over all texts.
2. Words are dealt out by what an edit leaves: positions 0 to L of a word of length L are
   cut into two ranges, and words that agree outside a range share a key; a word stands
   under four keys, with words of its own length and of one more or less. A key of more
   than ``HOT`` words is cut into two ranges again, until its range is one position, where
   the alphabet bounds it. No pair is lost and each is found once.
3. Each task builds its trees, one for each length, and reports its words' rectangles.
4. Pairs are counted by word; forms are followed to their roots by pointer jumping (n
   grows fivefold a step, so chains are short).

Defined results: a null text has no words; a null doc_id counts as ''; repeated rows count
each; words of equal n are taken in code-point order; no documents, no words. Columns
other than doc_id and text are not looked at. Whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Stage, documents, n_partitions

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Code points and occurrences of a word; a form has so many times the occurrences.
LENGTH, OFTEN, FACTOR = 6, 5, 5
#: One run in so many loses a code point.
MISSPELT = 199
#: Words under one key, and rectangles looked up at once.
HOT, AT_ONCE = 200_000, 1 << 19

_KEY = ["size", "lo", "hi", "rest"]


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run without one code point where its hash says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % MISSPELT == 0, F.concat(F.substring(run, 1, at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """(word, n) of all texts; longer runs only, as an edit never lengthens one."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = docs.select(F.col(doc_id).alias("_id"), F.explode(F.regexp_extract_all(F.translate(F.col(text), upper, lower), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("_run"))
    words = runs.select(misspelt(F.col("_id"), F.col("_run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def _rest(longer: int) -> Column:
    """What an edit in [lo, hi) leaves of a word; longer: 1 for the longer one of a pair."""
    return F.expr(f"concat(substring(word, 1, lo), '|', substring(word, hi + {longer} + 1))")


def dealt(words: DataFrame, stage: Stage, hot: int) -> DataFrame:
    """(word, n, longer, size, lo, hi, rest): words under the keys they share with near ones."""
    rows = None
    for longer in (0, 1):
        own = words.where(F.length("word") - longer >= F.lit(LENGTH)).withColumn("size", F.length("word") - longer).withColumn("longer", F.lit(longer))
        half = F.floor((F.col("size") + 1) / 2).cast("int")
        for lo, hi in ((F.lit(0), half), (half, F.col("size") + 1)):
            each = own.withColumn("lo", lo).withColumn("hi", hi).withColumn("rest", _rest(longer))
            rows = each if rows is None else rows.unionByName(each)
    step, done = 0, []
    while True:
        step += 1
        rows = stage.save(rows, f"dealt-{step}")
        many = stage.save(rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > hot) & (F.col("hi") - F.col("lo") > 1)).select(*_KEY), f"hot-{step}")
        if many.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(many, _KEY, "left_anti"))
        again = rows.join(many, _KEY, "left_semi").withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"))
        first, second = again.withColumn("hi", F.col("mid")), again.withColumn("lo", F.col("mid"))
        rows = first.unionByName(second).drop("mid").withColumn("rest", F.when(F.col("longer") == 1, _rest(1)).otherwise(_rest(0)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


class Wavelet:
    """A permutation of 0 to n - 1 that reports what lies in rectangles."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, (len(values) - 1).bit_length()) if len(values) else 1
        self.levels: list[tuple[np.ndarray, int]] = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1 == 1
            zeros = np.append(0, np.cumsum(~one))
            self.levels.append((zeros, int(zeros[-1])))
            values = np.concatenate([values[~one], values[one]])

    def report(self, x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) for every value in [y1, y2) at a place in [x1, x2)."""
        q, left, right, low = np.arange(len(x1)), x1, x2, np.zeros(len(x1), np.int64)
        for level, (zeros, n_zeros) in enumerate(self.levels):
            width = 1 << (self.bits - 1 - level)
            l0, r0 = zeros[left], zeros[right]
            l1, r1 = left - l0 + n_zeros, right - r0 + n_zeros
            a = (l0 < r0) & (low < y2[q]) & (low + width > y1[q])
            b = (l1 < r1) & (low + width < y2[q]) & (low + 2 * width > y1[q])
            q, left, right, low = (np.concatenate([x[a], y[b]]) for x, y in ((q, q), (l0, l1), (r0, r1), (low, low + width)))
        return q, low


def _points(words: list[str], width: int) -> np.ndarray:
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


class _Order:
    """Intervals of a sorted list of words that share their first code points."""

    def __init__(self, words: list[str], width: int):
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        points = _points([words[i] for i in order.tolist()], width)
        self.order, self.common = order, (points[1:] != points[:-1]).argmax(1)

    def classes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts before each rank of the first n words and of the others."""
        first = np.append(0, np.cumsum(self.order < n))
        return first, np.arange(len(self.order) + 1) - first

    def interval(self, depth: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.append(True, self.common < depth)
        which = np.cumsum(begin) - 1
        edges = np.append(np.flatnonzero(begin), len(self.order))
        mine = which[self.rank[of]]
        return edges[mine], edges[mine + 1]


def near_pairs(same: list[str], longer: list[str], asked: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(longer, words, near words): numbers in same, and in same or longer.

    same are distinct words of one length, longer distinct words of one more; each of
    asked, a number in same, is edited at the positions lo to hi.
    """
    n, size = len(same), len(same[0])
    every = same + longer
    forward, back = _Order(every, size + 1), _Order([w[::-1] for w in every], size + 1)
    trees, names = [], []
    for of in (np.arange(n), np.arange(n, len(every))):
        by_back = of[np.argsort(back.rank[of])]
        place = np.empty(len(every), np.int64)
        place[by_back] = np.arange(len(of))
        trees.append(Wavelet(place[of[np.argsort(forward.rank[of])]]))
        names.append(by_back)
    f_class, b_class = forward.classes(n), back.classes(n)
    points = _points(every, size + 1)
    waiting: list[list[tuple]] = [[], []]

    def looked_up(kind: int) -> tuple[bool, np.ndarray, np.ndarray]:
        w, i, x1, x2, y1, y2 = (np.concatenate(c) for c in zip(*waiting[kind], strict=True))
        waiting[kind].clear()
        q, found = trees[kind].report(x1, x2, y1, y2)
        w, i, other = w[q], i[q], names[kind][found]
        # A word is not near itself; a code point inserted after its like counts once, before it.
        keep = (points[other, i] != points[w, i - 1]) | (i == 0) if kind else other != w
        return bool(kind), w[keep], other[keep] - n * kind

    for i in range(int(lo.min()), min(int(hi.max()), size + 1)):
        now = asked[(lo <= i) & (i < hi)]
        if not len(now):
            continue
        x1, x2 = forward.interval(i, now)
        for kind in (0, 1):
            if size - i - 1 + kind < 0 or (kind and not longer):
                continue
            y1, y2 = back.interval(size - i - 1 + kind, now)
            f, b = f_class[kind], b_class[kind]
            box = (f[x1], f[x2], b[y1], b[y2])
            some = np.minimum(box[1] - box[0], box[3] - box[2]) > 1 - kind
            if some.any():
                waiting[kind].append((now[some], np.full(int(some.sum()), i), *(x[some] for x in box)))
                if sum(len(c[0]) for c in waiting[kind]) >= AT_ONCE:
                    yield looked_up(kind)
    for kind in (0, 1):
        if waiting[kind]:
            yield looked_up(kind)


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (word, near, near_n) of all words of one partition."""
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    sizes = table.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        own = table.filter(pa.array(sizes == size))
        words, ns = own.column("word").to_pylist(), own.column("n").to_numpy()
        longer, lo, hi = (own.column(c).to_numpy() for c in ("longer", "lo", "hi"))
        names: list[dict[str, int]] = [{}, {}]
        count: list[list[int]] = [[], []]
        at = np.empty(len(words), np.int64)
        for i, (w, k) in enumerate(zip(words, longer.tolist(), strict=True)):
            at[i] = j = names[k].setdefault(w, len(names[k]))
            if j == len(count[k]):
                count[k].append(int(ns[i]))
        if not names[0]:
            continue
        mine = longer == 0
        same, more = list(names[0]), list(names[1])
        text = [np.array(same, object), np.array(more, object)]
        n = [np.array(c, np.int64) for c in count]
        for kind, w, other in near_pairs(same, more, at[mine], lo[mine].astype(np.int64), hi[mine].astype(np.int64)):
            for a in range(0, len(w), AT_ONCE):
                x, y = w[a : a + AT_ONCE], other[a : a + AT_ONCE]
                yield pa.record_batch([pa.array(text[0][x], pa.string()), pa.array(text[kind][y], pa.string()), pa.array(n[kind][y])], names=["word", "near", "near_n"])
                if kind:
                    yield pa.record_batch([pa.array(text[1][y], pa.string()), pa.array(text[0][x], pa.string()), pa.array(n[0][x])], names=["word", "near", "near_n"])


def variants(words: DataFrame, factor: int = FACTOR, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of (word, n), words distinct."""
    spark = words.sparkSession
    stage = Stage(spark, "spelling")
    words = stage.save(words.select("word", F.col("n").cast("long").alias("n")), "words")
    rows = dealt(words, stage, hot)
    parts = max(n_partitions(spark), 4 * words.count() // hot + 1)
    pairs = rows.repartition(parts, *_KEY).select("word", "n", "longer", "size", "lo", "hi").mapInArrow(_reported, "word string, near string, near_n long")
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    good = -F.col("best.minus") >= factor * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n"))
    out = stage.save(out, "forms")
    roots = stage.save(out.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots-0")
    step = 0
    while not roots.where("moved").isEmpty():
        step += 1
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stage.save(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{step}")
    out = out.join(roots.drop("moved"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return variants(vocabulary(documents(spark, sf_dir, "doc_id", "text")))
