"""The index of cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, vectorindex
from tessera.operators.vectorindex import VectorIndex


@pytest.fixture(scope="module")
def rows(spark):
    """Four clusters, equal vectors, other lengths, and what has no direction."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 8)) * 4
    data = [(i, [float(x) for x in centres[i % 4] + rng.normal(size=8) * 0.2]) for i in range(800)]
    data += [(1000 + i, data[3][1]) for i in range(40)] + [(2000, [0.0] * 8), (2001, []), (2002, None), (2003, [1.0, 2.0]), (2004, [2.0, 4.0]), (2005, [float("nan")] * 8)]
    return spark.createDataFrame(data, "id long, embedding array<double>").repartition(3)


def _want(rows, asked, k):
    own = {r["id"]: np.array(r["embedding"]) for r in rows.collect() if r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])}
    out = {}
    for q in asked:
        score = {i: float((v / np.sqrt((v * v).sum()) * (own[q] / np.sqrt((own[q] ** 2).sum()))).sum()) for i, v in own.items() if len(v) == len(own[q])}
        out[q] = sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


@pytest.mark.parametrize("block, group, cell", [(1024, 256, 4096), (16, 4, 50)])
def test_batch_equals_all_pairs(spark, rows, tmp_path, monkeypatch, block, group, cell):
    for name, value in (("BLOCK", block), ("GROUP", group), ("CELL", cell)):
        monkeypatch.setattr(vectorindex, name, value)
    asked = rows.where("id % 20 = 3 or id > 2000").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    index = VectorIndex(spark, str(tmp_path / "v")).build(rows)
    found, report = index.search(asked, 6)
    want = _want(rows, [r["query_id"] for r in asked.collect() if r["q"] and r["query_id"] not in (2000, 2005)], 6)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(int(r["query_id"]), []).append((int(r["id"]), r["score"]))
    assert set(got) == set(want)
    for q, own in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in own]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in own], abs=1e-9)
    share = report.head()
    assert 0 < share["pairs_scored"] <= share["pairs"]
    if block == 16:
        assert share["pairs_scored"] < 0.6 * share["pairs"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_small_and_empty_tables(spark, rows):
    asked = rows.limit(3).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    assert retrieval.vector_topk_batch(rows.limit(0), asked, 2).count() == 0
    one = rows.where("id = 5")
    out = retrieval.vector_topk_batch(one, rows.where("id < 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), 2)
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in out.collect()) == [(0, 5, 1), (1, 5, 1), (2, 5, 1)]
