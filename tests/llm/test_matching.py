"""Operators 11 to 13 on small tables with the awkward cases, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, negatives, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Operator 11


def _near(words):
    """Near words by deletion neighbourhoods."""
    near, shared = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            shared[w[:i], w[i + 1 :]].append(w)
            if (v := w[:i] + w[i + 1 :]) in words:
                near[w].add(v)
                near[v].add(w)
    for group in shared.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    return near


def _variants(count):
    near, out = _near(count), {}
    for w, n in count.items():
        best = min(((-count[v], v) for v in near[w]), default=None)
        form = best[1] if best and -best[0] >= 5 * n else None
        out[w] = (form, n, len(near[w]), count[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (form, root(w), n, k, m) for w, (form, n, k, m) in out.items()}


def _counted(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= 5}


def _got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_of_documents(spark):
    rng = np.random.default_rng(1)
    words = ["kitten", "sitten", "kittens", "Kittén", "aabbcc", "aaabbcc", "aabbc", "zürich", "zurich", "x" * 3000, "x" * 2999 + "y", "x" * 3001]
    rows = [(i, " ".join(rng.choice(words, 40, p=[0.3] + [0.7 / 11] * 11))) for i in range(40)]
    rows += [(None, "kitten sitten"), (None, "kitten sitten"), (1, None), (2, ""), (3, "\t\n "), rows[0]]
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string").repartition(3)
    assert _got(spelling.variants(spelling.vocabulary(docs))) == _variants(_counted(rows))
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0


@pytest.mark.parametrize("hot", [200_000, 8])
def test_near_words_whatever_the_key(spark, hot):
    """Words that share halves, repeated letters, ties; with 8, keys are cut to the end."""
    rng = np.random.default_rng(2)
    count = {"".join(rng.choice(list("abc"), rng.integers(6, 10))): int(rng.integers(1, 200)) for _ in range(1500)}
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    assert _got(spelling.variants(words, hot=hot)) == _variants(count)


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 1000):
        p = rng.permutation(n)
        x1, y1 = rng.integers(0, n, 50), rng.integers(0, n, 50)
        x2, y2 = rng.integers(x1, n + 1), rng.integers(y1, n + 1)
        q, v = spelling.Wavelet(p).report(x1, x2, y1, y2)
        want = [(i, y) for i in range(50) for y in p[x1[i] : x2[i]].tolist() if y1[i] <= y < y2[i]]
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == sorted(want)


# Operator 12


def _hard(rows):
    """rows: {id: (label, vector)}"""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = set()
    for a in (i for i in rows if i % 100 == 0):
        score = {i: dot(rows[a][1], v) for i, (_, v) in rows.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][:5]:
            fit = [i for i in order if rows[i][0] != rows[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:10])}
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, a vector that a third of the rows share, ties, repeats and odd rows."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 3
    rows = []
    for i in range(1200):
        v = centres[0] if i % 3 == 0 else centres[i % 6] + rng.normal(size=8) * (0.1 if i % 5 else 0.0)
        rows.append((i, int(rng.integers(0, 4)), [float(np.float32(x)) for x in v]))
    rows += [rows[3], (5, 0, rows[9][2]), (None, 1, rows[0][2]), (1301, None, rows[0][2]), (1302, 1, None), (1303, 1, [float("nan")] * 8), (1304, 1, [1.0, None, 2.0]), (1400, 2, [1.0, 2.0]), (1500, 2, []), (1305, 1, [float("inf")] * 8), (-100, 3, rows[1][2])]
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, score string").repartition(4)


@pytest.mark.parametrize("block, group, cell", [(1024, 256, 4096), (16, 3, 40)])
def test_hard_negatives(spark, vectors, monkeypatch, block, group, cell):
    for name, value in (("BLOCK", block), ("GROUP", group), ("CELL", cell)):
        monkeypatch.setattr(negatives, name, value)
    rows = {}
    for r in vectors.collect():
        v = r["embedding"]
        if r["vec_id"] is None or r["label"] is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        one = (r["label"], [int(np.floor(256 * float(x))) for x in v])
        rows[r["vec_id"]] = min(rows.get(r["vec_id"], one), one)
    out = negatives.hard_negatives(negatives.quantised(vectors)).collect()
    assert {tuple(r) for r in out} == _hard(rows) and len(out) == len(_hard(rows)) > 300
    assert negatives.hard_negatives(negatives.quantised(vectors.limit(0))).count() == 0


def test_distant_blocks_are_not_sent(spark, vectors, monkeypatch):
    """Of two far clusters, one's blocks don't serve the other's anchors."""
    for name, value in (("BLOCK", 16), ("GROUP", 8), ("CELL", 64)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(5)
    data = [(i, 0, [int(x) for x in rng.normal(size=4) * 5 + (300 if i % 2 else -300) * np.array([1, 0, 0, 0])]) for i in range(1000)]
    join = negatives._Join(spark.createDataFrame(data, "vec_id long, label long, v array<long>"), lambda ids: ids % 10 == 0)
    saved = []
    save = join.stage.save
    monkeypatch.setattr(join.stage, "save", lambda df, name: saved.append((name, save(df, name).count())) or join.spark_read(name))
    join.spark_read = lambda name: spark.read.parquet(join.stage.path(name))
    none = F.lit(None).cast("long")
    join.search(join.members.select("anchor_id", F.lit(0).cast("long").alias("key"), none.alias("low"), none.alias("high")), "p", 5, True)
    pairs = dict(saved)["p-pairs"]
    assert 0 < pairs < 0.6 * join.groups.count() * join.blocks.count()


# Operator 13


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _hits(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w = _words(text)
        hit, names, longest = set(), set(), 0
        for name, item in items:
            own = _words(item)
            k = min(len(own), window)
            table = {tuple(own[p : p + k]) for p in range(len(own) - k + 1)} if own else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in table:
                    hit.update(range(i, i + k))
                    names.add("" if name is None else str(name))
            if k == window:
                for i in range(len(w)):
                    for p in range(len(own)):
                        n = 0
                        while n < min(len(w) - i, len(own) - p) and w[i + n] == own[p + n]:
                            n += 1
                        longest = max(longest, n if n >= window else 0)
            elif names and hit:
                longest = max(longest, k if any(tuple(w[i : i + k]) in table for i in range(len(w) - k + 1)) else 0)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), longest))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaked(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ß9"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(1, say(25)), (2, say(10)), (3, "Three short-words"), (10, say(40)), (None, say(12)), (4, None), (5, " .,; "), (10, say(15)), (6, "a b a b a b a b a b a b a b")]
    items += [(7, items[0][1] + " end")]
    docs = [(i, say(30) + " " + items[i % 4][1].upper().replace(" ", ", ") + " " + say(5)) for i in range(12)]
    docs += [(20, items[0][1][:60]), (21, items[3][1]), (22, "x THREE (short) words y"), (23, None), (24, ""), (25, "a b " * 9), (26, items[4][1]), (None, items[1][1]), docs[0], docs[0], (27, items[2][1] + " " + say(20_000))]
    return docs, items


@pytest.mark.parametrize("shard, most, pairs", [(1 << 20, 1 << 25, 1 << 22), (50, 60, 3)])
def test_decontamination(spark, leaked, monkeypatch, shard, most, pairs):
    monkeypatch.setattr(decontam, "SHARD", shard)
    monkeypatch.setattr(decontam, "PAIRS", pairs)
    docs, items = leaked
    d = spark.createDataFrame([(*r, 1, "y") for r in docs], "doc_id long, text string, hits int, longest_item string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.find_matches(d, b, most=most)
    assert out.columns == ["doc_id", *decontam.FOUND.names]
    rows = out.collect()
    got = [(r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["hits"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["longest"]) for r in rows]
    want = _hits(docs, items)
    assert sorted(got, key=repr) == want
    for r in rows:
        if r["longest"]:
            words = " ".join(_words(dict(docs)[r["doc_id"]])[r["longest_at"] : r["longest_at"] + r["longest"]])
            assert any(words in " ".join(_words(t)) for n, t in items if ("" if n is None else str(n)) == r["longest_item"])
    clean = decontam.decontaminated(d, b, most=most)
    assert clean.columns == d.columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((w[0] for w in want if not w[2]), key=repr)


def test_decontamination_without_rows(spark, leaked):
    docs, items = leaked
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.find_matches(d.limit(0), b).count() == 0
    assert {r["longest"] for r in decontam.find_matches(d, b.limit(0)).collect()} == {0}
    assert decontam.decontaminated(d, b.limit(0)).count() == len(docs)


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(7)
    ids = np.append(rng.integers(0, 4, 300).astype(np.int32), np.zeros(10, np.int32))
    for least in (1, 3):
        array = decontam.suffix_array(ids, 10, least)
        want = [i for i in range(300) if all(ids[i : i + least])]
        assert sorted(array.tolist()) == want
        heads = [tuple(ids[i : i + 10]) for i in array.tolist()]
        # What stands behind a 0 is no part of a match.
        cut = [h[: h.index(0)] if 0 in h else h for h in heads]
        assert cut == sorted(cut)
