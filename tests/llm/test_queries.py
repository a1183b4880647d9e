"""The contract queries on the smallest tables: oracle SQL, brute force, the pipeline."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import queries

SF = "/root/testdata/sf0.001"


def _cells(rows, columns):
    show = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    want = con.sql(queries.ORACLE_SQL[name])
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _cells([r.asDict() for r in got.collect()], columns) == _cells(rows, columns)


def test_windows_against_brute_force(spark):
    from .test_operators import _removed

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = _removed(docs)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.QUERIES["op7_substring_dedup"](spark, SF).collect()}
    assert got == {i: (n, gone, hashlib.sha256(left.encode()).hexdigest()) for i, (n, gone, left) in want.items()}


def test_media_query(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op1_media_wav"](spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(docs)
    for r in out:
        data = docs[r["doc_id"]]
        want = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r["media_bytes"] > len(want) and len(r["fp_time"]) == len(r["fp_hash"]) == r["n_pairs"]


def test_token_query(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.QUERIES["op5_token_files"](spark, SF).collect()) == want


def test_piece_query(spark):
    import sentencepiece

    from tessera.llm import pieces

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op6_piece_transducer"](spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(texts) and all(r["round_trip"] for r in out)
    for r in out:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<i4")))


def test_near_duplicates_against_brute_force(spark):
    from .test_operators import _shingles

    sets = {r["doc_id"]: _shingles(r["text"], 3) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if i < j and comp[i] != comp[j] and a and b and 100 * len(a & b) >= 85 * len(a | b):
                    low, high = sorted((comp[i], comp[j]))
                    comp = {k: low if v == high else v for k, v in comp.items()}
                    changed = True
    got = {r["doc_id"]: r["component_id"] for r in queries.QUERIES["op4_hyperminhash"](spark, SF).collect()}
    assert got == comp


def test_pipeline_against_brute_force(spark):
    """Every stage again in Python, the mixture by its SQL, the ids by the library."""
    import sentencepiece

    from tessera.llm import mixing, pieces, quality

    from .test_operators import _shingles, _statistics

    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(table, labels)
    docs = {r["doc_id"]: r for r in table.collect()}
    x = np.array([_statistics(r["text"]) for r in docs.values()], float)
    score = 1 / (1 + np.exp(-(model.intercept + sum(w * rule.holds(x) for rule, w in model.rules))))
    good = [i for i, s in zip(docs, score, strict=True) if s >= quality.PASS]
    owner = {}
    for i in sorted(good):
        owner[docs[i]["text"] or ""] = i
    left = sorted(owner.values())
    sets, comp = {i: _shingles(docs[i]["text"], 5) for i in left}, {i: i for i in left}
    changed = True
    while changed:
        changed = False
        for i in left:
            for j in left:
                if comp[i] < comp[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[j], changed = comp[i], True
    left = [i for i in left if comp[i] == i]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet' where doc_id in ({', '.join(map(str, left))})")
    kept = {r[0] for r in con.sql(f"select doc_id from ({mixing.SQL}) where kept").fetchall()}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "tokens"]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: library.encode(docs[i]["text"] or "") for i in kept}
    assert len(rows) == len(kept) > 0 and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in rows)
