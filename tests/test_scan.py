"""Running totals of large groups in segments against one window."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import ranks
from tessera.operators import scan
from tessera.operators import scoring as S


@pytest.fixture(scope="module")
def rows(spark):
    """One run with half of all rows, ties of the first order column, null values and runs."""
    rng = random.Random(9)
    data = [(rng.choice(["hot"] * 3 + ["a", "b", None]), rng.randint(0, 20), i, rng.choice([None, *range(30)]), rng.randint(0, 5000)) for i in range(900)]
    return spark.createDataFrame(data, "run string, ts int, event_id int, key int, tokens long").repartition(3)


def _key(df):
    return sorted(map(str, df.collect()))


def test_segments_change_nothing(spark, rows, monkeypatch):
    totals = {"n": ("count", F.lit(1)), "s": ("sum", F.col("key")), "m": ("max", F.when(F.col("key") % 3 == 0, F.col("key")))}
    whole = scan.running(rows, ["run"], ["ts", "event_id"], totals, 10_000)
    cut = scan.running(rows, ["run"], ["ts", "event_id"], totals, 50)
    assert cut.columns == whole.columns and _key(cut) == _key(whole)
    budgets, streaks = S.budgets(rows, "run", ["ts", "event_id"]), S.stale_streaks(rows, "run", ["ts", "event_id"], "key")
    want = _key(budgets), _key(streaks)
    monkeypatch.setattr(scan, "MOST", 50)
    assert (_key(S.budgets(rows, "run", ["ts", "event_id"])), _key(S.stale_streaks(rows, "run", ["ts", "event_id"], "key"))) == want
    assert scan.running(rows.limit(0), ["run"], ["ts"], totals).count() == 0


def test_a_large_group_is_divided(spark, rows, monkeypatch):
    paths = []
    real = scan.folder
    monkeypatch.setattr(scan, "folder", lambda s, name: paths.append(real(s, name)) or paths[-1])
    scan.running(rows, ["run"], ["ts", "event_id"], {"n": ("count", F.lit(1))}, 200)
    sizes = spark.read.parquet(f"{paths[0]}/rows").groupBy("_segment", "run").count().collect()
    hot = [r["count"] for r in sizes if r["run"] == "hot"]
    assert len(hot) > 2 and max(hot) < 0.6 * sum(hot) and {r["run"] for r in sizes} == {"hot"}


def test_streaks_by_hand(spark):
    data = [("r", i, i, k, 0) for i, k in enumerate([None, 1, 1, 2, 2, 1, None, 3])]
    out = S.stale_streaks(spark.createDataFrame(data, "run string, ts int, event_id int, key int, tokens long"), "run", ["ts", "event_id"], "key").orderBy("ts").collect()
    assert [(r["step"], r["grew"], r["streak"]) for r in out] == [(1, False, 1), (2, True, 0), (3, False, 1), (4, True, 0), (5, False, 1), (6, False, 2), (7, False, 3), (8, True, 0)]


def test_sparse_ids_share_ranges(spark):
    rows = spark.createDataFrame([("g" if i % 3 else "h", i * 1_000_003) for i in range(3000)], "g string, k long").repartition(3)
    out = ranks.numbered(rows, "g", "k", "no")
    want = {}
    for g, k in sorted((r["g"], r["k"]) for r in rows.collect()):
        want[k] = sum(1 for x in want.values() if x[0] == g), g
        want[k] = (g, want[k][0])
    assert {r["k"]: (r["g"], r["no"]) for r in out.collect()} == want
