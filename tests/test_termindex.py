"""The kept term index against the search over texts, and the log of commits."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import termindex
from tessera.operators.termindex import TermIndex
from tessera.sources.shared import CommitLog, ConflictError


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["red", "blue", "green", "deep sea", "sea", "Éclair", "x9", "deep"], rng.integers(0, 30))) for _ in range(60)]
    texts[7] = None
    data = [(f"d{i}", f"src{i % 4}", i // 4, "even" if i % 2 == 0 else None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "id string, source_path string, chunk_index int, section_id string, content string").repartition(3)


def _same(a, b):
    key = lambda r: (r["source_path"], r["chunk_index"], round(r["bm25"], 9), round(r["score"], 9))
    got, want = [key(r) for r in a.collect()], [key(r) for r in b.collect()]
    assert got == want
    return len(got)


QUERIES = ["deep_sea blue", "sea sea eclair __", "nothing"]


@pytest.mark.parametrize("span, first", [(1024, 32), (4, 1)])
def test_search_equals_a_scan(spark, rows, tmp_path, monkeypatch, span, first):
    monkeypatch.setattr(termindex, "RANGE", span)
    monkeypatch.setattr(termindex, "FIRST", first)
    index = TermIndex(spark, str(tmp_path / "i"))
    index.append(rows.where("chunk_index < 9"))
    index.append(rows.where("chunk_index >= 9"))
    for q in QUERIES:
        assert _same(index.search(q, 7), R.bm25_topk(rows, q, 7)) or q == "nothing"
        p = F.col("section_id") == "even"
        _same(index.search(q, 5, p), R.bm25_topk(rows, q, 5, p))
    assert index.search("", 5).count() == 0
    stats = {r["term"]: (r["df"], r["cf"]) for r in index.statistics().collect()}
    own = [r["content"].lower().replace("é", "e").split() for r in rows.collect() if r["content"]]
    assert stats == {w: (sum(w in t for t in own), sum(t.count(w) for t in own)) for w in {x for t in own for x in t}}


def test_deleted_and_replaced_sources(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(termindex, "RANGE", 4)
    monkeypatch.setattr(termindex, "FIRST", 1)
    index = TermIndex(spark, str(tmp_path / "i"))
    index.append(rows)
    index.delete(F.col("source_path") == "src1")
    new = rows.where("source_path in ('src1', 'src2')").withColumn("content", F.lit("deep sea red red"))
    index.replace(new)
    live = rows.where("source_path in ('src0', 'src3')").union(new)
    assert index.documents().count() == live.count()
    for q in QUERIES:
        _same(index.search(q, 9), R.bm25_topk(live, q, 9))
    want = {r["term"]: (r["df"], r["max_tf"]) for r in _fresh(spark, tmp_path, live).statistics().collect()}
    assert {r["term"]: (r["df"], r["max_tf"]) for r in index.statistics().collect()} == want


def _fresh(spark, tmp_path, rows):
    index = TermIndex(spark, str(tmp_path / "fresh"))
    index.append(rows)
    return index


def test_a_search_reads_the_buckets_of_its_terms_only(spark, rows, tmp_path):
    index = TermIndex(spark, str(tmp_path / "i"))
    index.append(rows)
    plan = index.search("red sea")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") and "content" not in plan


def test_an_empty_index(spark, rows, tmp_path):
    index = TermIndex(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        index.search("red")
    index.append(rows.limit(0))
    assert index.search("red").count() == 0 and index.statistics().count() == 0


def test_one_of_two_writers_gets_a_number(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(log.put(1, {"writer": i}))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False, False, False, True] and len(log.entries()) == 1
    assert log.commit({"writer": 9}, 0, lambda newer: False) == 2
    with pytest.raises(ConflictError):
        log.commit({"writer": 9}, 1, lambda newer: True)
    assert log.last() == 2 and [n for n, _ in log.entries(1)] == [2]


def test_the_build_shuffles_no_texts(spark, rows, tmp_path, monkeypatch):
    """Kept columns are added without the texts; blocks are made where texts are read, cut
    as often as need be, and each is whole."""
    made = []
    monkeypatch.setattr(termindex, "TOKENS", 50)
    monkeypatch.setattr(termindex, "PIECE", 7)
    index = TermIndex(spark, str(tmp_path / "i"))
    wide = rows.repartition(2).withColumn("content", F.repeat(F.concat("content", F.lit(" ")), 40))
    numbers = lambda df: made.append(df.columns) or df.withColumn("chunk", F.col("chunk_index") + 1)
    index.append(wide, kept=numbers)
    assert made == [["id", "source_path", "chunk_index", "section_id", "_dl", "_ord"]]
    assert index.documents().where("chunk = chunk_index + 1").count() == 60
    for q in QUERIES[:2]:
        assert _same(index.search(q), R.bm25_topk(wide, q)) == 30
    blocks = index._postings(index.log.entries(), None, True)
    seen = blocks.groupBy("term").agg(F.sum("n").alias("n"), F.sum("cf").alias("cf")).collect()
    each = wide.select("id", F.explode(F.split(F.regexp_replace(F.lower("content"), "é", "e"), " ")).alias("term")).where("term <> ''").groupBy("term").agg(F.countDistinct("id").alias("n"), F.count("id").alias("cf")).collect()
    assert sorted(map(tuple, seen)) == sorted(map(tuple, each))
    # Many blocks of a term and range, each of whole documents.
    assert blocks.where("term = 'sea'").count() > 4
    assert blocks.select("term", F.explode("docs").alias("d")).groupBy("term", "d._ord").count().where("count > 1").count() == 0


def test_vectors_are_scored_before_they_are_shuffled(spark, rows):
    e = spark.createDataFrame([(f"d{i}", [float(i % 7), 1.0]) for i in range(60)], "id string, embedding array<float>")
    q = spark.createDataFrame([([1.0, 2.0],)], "q array<float>")
    apart = R.scored_topk(rows.drop("content"), R.vector_scores(e, q), "id")
    plan = apart._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(id"):]
    assert "SortMergeJoin" in plan and "embedding" not in plan[: plan.index("Exchange hashpartitioning(id")] and "score" in below
    joined = R.vector_topk(rows.drop("content").join(e, "id"), q)
    assert [r["id"] for r in apart.collect()] == [r["id"] for r in joined.collect()]


def test_blocks_are_sent_packed(spark, rows, tmp_path, monkeypatch):
    """Blocks of some ranges that go to one file are one row; a bucket may have more files,
    each with terms of its own, and a search finds them."""
    terms = pa.array(["sea", "blue", "sea", "x9"] * 50)
    blocks = [termindex._blocks(r, [(r * 1024 + i, 200, 0, terms) for i in range(3)]) for r in range(20)]
    sent = list(termindex._packed(iter(blocks), 2, 3, 1 << 14))
    assert sum(b.num_rows for b in blocks) == 60 and sum(b.num_rows for b in sent) <= 3
    back = pa.Table.from_batches(termindex._unpacked(iter(sent)))
    key = lambda r: (r["_range"], r["term"])
    got = sorted(back.drop_columns("bucket").to_pylist(), key=key)
    assert got == sorted(pa.Table.from_batches(blocks).to_pylist(), key=key)
    assert all(r["bucket"] == termindex._bucket(r["term"].encode(), 2) for r in back.to_pylist())
    monkeypatch.setattr(termindex, "FILE_BYTES", 200)
    monkeypatch.setattr(termindex, "RANGE", 4)
    index = TermIndex(spark, str(tmp_path / "i"))
    more = rows.withColumn("content", F.concat_ws(" ", "content", "id"))
    index.append(more)
    files = list(tmp_path.glob("i/postings/*/bucket=*/*.parquet"))
    assert len(files) > len({p.parent for p in files})
    assert sum(_same(index.search(q, 9), R.bm25_topk(more, q, 9)) for q in QUERIES) > 0
