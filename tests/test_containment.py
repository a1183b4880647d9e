"""Fuzzy resolution by q-grams against the scan of a small request, and plain Python."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import containment, retrieval


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab_ c.É") for _ in range(rng.randint(0, 7))) for _ in range(n)]


def test_pairs(spark):
    patterns, texts = _texts(60, 1) + ["", "zzz", "zz"], _texts(80, 2) + ["", "aXb"]
    p, t = spark.createDataFrame([(x,) for x in patterns], "pattern string"), spark.createDataFrame([(x,) for x in texts], "text string")
    got = [tuple(r) for r in containment.containing(p, t).collect()]
    want = {(a, b) for a in patterns for b in texts if a and a in b}
    assert set(got) == want and len(got) == len(want)
    assert containment.containing(p.limit(0), t).count() == 0 and containment.containing(p, t.limit(0)).count() == 0


def test_files_and_titles_as_by_a_scan(spark):
    """Empty texts, ties and repeated rows included."""
    wanted = spark.createDataFrame([(x,) for x in _texts(70, 3) + ["", " ", None]], "file_id string")
    files = spark.createDataFrame([(f"{d}/{x}",) for x in _texts(50, 4) for d in "xy"] + [("plain",)], "source_path string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(retrieval.resolve_file(wanted, files, 0)) == key(retrieval.resolve_file(wanted, files, 1000))
    sections = spark.createDataFrame([(x, i // 2) for i, x in enumerate(_texts(90, 5))], "title string, ordinal int")
    needles = wanted.toDF("needle")
    assert key(retrieval.resolve_title(needles, sections, 0)) == key(retrieval.resolve_title(needles, sections, 1000))
    plan = retrieval.resolve_title(needles, sections, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_keys_of_ascii_and_other_texts(spark):
    rows = spark.createDataFrame([("  A_b-.C\t",), ("Ĳssel ﬁle_É",), (None,), ("\x1cx\x1f",), ("",)], "t string")
    assert [r[0] for r in rows.select(X.match_key(F.col("t"))).collect()] == ["a b c", "ijssel file e", None, "x", ""]


def test_many_needles_are_not_broadcast(spark, tmp_path):
    """Spark takes exploded rows for as many as they come from; only shuffles hold for any
    number of them. Patterns are of all lengths around that of a run."""
    texts = [f"customer{i:09d}" for i in range(300)]
    patterns = [t[-n:] for t in texts[::7] for n in (1, 5, 7, 8, 9, 12, 17)]
    for name, rows in (("pattern", patterns), ("text", texts)):  # of files Spark knows the size
        spark.createDataFrame([(x,) for x in rows], f"{name} string").write.parquet(str(tmp_path / name))
    p, t = (spark.read.parquet(str(tmp_path / name)) for name in ("pattern", "text"))
    found = containment.containing(p, t)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(a, b) for a in patterns for b in texts if a in b}
    title = retrieval.resolve_title(p.toDF("needle").distinct(), t.select(F.col("text").alias("title"), F.length("text").alias("ordinal")), 0)
    assert "Broadcast" not in title._jdf.queryExecution().executedPlan().toString()
    assert {(r["needle"], r["title"]) for r in title.collect()} == {(a, min(b for b in texts if a in b)) for a in patterns}
