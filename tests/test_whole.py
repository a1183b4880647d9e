"""Queries over whole tables, against results computed in Python."""

import hashlib
import json
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.operators import retrieval
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def _table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def _chunks(spark):
    """The documents of each source in order."""
    out = defaultdict(list)
    for r in sorted(_table(spark, "documents"), key=lambda r: r["doc_id"]):
        out[r["source"]].append(r)
    return out


def test_synthesis_context_takes_whole_contents(spark):
    want = set()
    for source, docs in _chunks(spark).items():
        used = 0
        for i, r in enumerate(docs[:20]):
            used += len(r["text"])
            if used > 45_000:
                break
            want.add((source, i, used))
    assert {tuple(r) for r in catalogue.QUERIES["synthesis_context"](spark, SF).collect()} == want


def test_section_chunks_are_whole(spark):
    want = {(r["doc_id"], f"[CHUNK_ID: src4::{i}] [SECTION_ID: fr] [SECTION: FR]\n{r['text']}") for i, r in enumerate(_chunks(spark)["src4"]) if r["lang"] == "fr"}
    got = catalogue.QUERIES["section_chunks"](spark, SF).collect()
    assert {(int(r["id"]), r["rendered"]) for r in got} == want and max(len(t) for _, t in want) > 80


def test_toc_render_lists_every_customer(spark):
    regions = {r["r_regionkey"]: r["r_name"] for r in _table(spark, "region")}
    nations = {n["n_nationkey"]: n for n in _table(spark, "nation")}
    orders = Counter(o["o_custkey"] for o in _table(spark, "orders"))
    lines = defaultdict(list)
    for k, name in regions.items():
        lines[name].append((0, 1, f"- [r{k}] {name}  (1 chunks, page 1)"))
    for k, n in nations.items():
        lines[regions[n["n_regionkey"]]].append((k + 1, 1, f"- [n{k}] {n['n_name']}  (1 chunks, page 1)"))
    for c in _table(spark, "customer"):
        n = orders[c["c_custkey"]]
        lines[regions[nations[c["c_nationkey"]]["n_regionkey"]]].append((c["c_custkey"] + 1000, n, f"  - [c{c['c_custkey']}] {c['c_name']}  ({n} chunks, page {n or '?'})"))
    want = {s: f"TOC for: {s}\nSections: {len(x)}  |  Total chunks: {sum(n for _, n, _ in x)}\n\n" + "\n".join(t for *_, t in sorted(x)) for s, x in lines.items()}
    assert {r["source_path"]: r["rendered"] for r in catalogue.QUERIES["toc_render"](spark, SF).collect()} == want


def test_stop_reasons_see_every_event(spark):
    runs = defaultdict(list)
    for e in sorted(_table(spark, "events"), key=lambda e: (e["ts"], e["event_id"])):
        runs[e["user_id"]].append(e)
    want = {}
    for run, events in runs.items():
        calls = tokens = streak = 0
        exceeded, stale, seen = False, False, set()
        for step, e in enumerate(events, 1):
            calls, tokens = calls + 1, tokens + math.floor(abs(e["value"]) * 100)
            key = json.loads(e["props"]).get("k")
            streak = 0 if key is not None and key not in seen else streak + 1
            seen.add(key)
            exceeded |= calls >= 30 or tokens >= 500_000
            stale |= streak >= 2 and step >= 2
        want[run] = "submitted" if run % 9 == 0 else "budget_exceeded" if exceeded else "stale" if stale else "max_iterations" if len(events) >= 8 else "none"
    assert {r["run"]: r["reason"] for r in catalogue.QUERIES["stop_reasons"](spark, SF).collect()} == want


def test_source_key_migration_over_all_pages(spark):
    paths = defaultdict(lambda: defaultdict(list))
    for p in _table(spark, "pages"):
        n = p["page_id"] // 3
        m, key, content = n % 8, f"datasets/web/{n}.html", hashlib.md5(p["html"].encode()).hexdigest()
        if m != 1:
            paths[key]["/old/checkout/" if m % 2 == 0 else "C:\\work\\"].append("other" if m == 3 else content)
        if m in (2, 3, 4) or m == 5 and p["page_id"] % 3:
            paths[key]["/srv/copy/"].append(content)
        if m in (1, 2, 3, 4):
            paths[key][""].append(content)
    want = Counter()
    for key, found in paths.items():
        sets = [Counter(x) for x in found.values()]
        if all(x == sets[0] for x in sets):
            want.update((key, c, "kept") for c in sets[0].elements())
        else:
            want[key, str(len(found)), "conflict"] += 1
    got = Counter((r["source_path"], r["value"], r["kind"]) for r in catalogue.QUERIES["source_key_migration"](spark, SF).collect())
    assert got == want and max(len(x) for x in paths.values()) == 3
    assert {v for _, v, kind in want if kind == "conflict"} == {"2", "3"}


def test_vector_topk_batch_of_every_twentieth(spark):
    rows = sorted(_table(spark, "embeddings"), key=lambda r: r["vec_id"])
    ids = np.array([r["vec_id"] for r in rows])
    v = np.array([r["embedding"] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = v @ v[i]
        want[ids[i]] = sorted(np.round(score, 5), reverse=True)[:5]
    got = defaultdict(list)
    place = {j: i for i, j in enumerate(ids)}
    for r in catalogue.QUERIES["vector_topk_batch"](spark, SF).collect():
        assert r["score"] == pytest.approx(v[place[r["id"]]] @ v[place[r["query_id"]]], abs=2e-6)
        got[r["query_id"]].append((r["rank"], r["score"]))
    assert set(got) == set(want) and len(want) > 1
    for q, found in got.items():
        assert [n for n, _ in sorted(found)] == [1, 2, 3, 4, 5] and [s for _, s in sorted(found)] == pytest.approx(want[q], abs=2e-5)


def test_chunk_window_around_every_cited_chunk(spark):
    chunks = _chunks(spark)
    keys = {(f"src{(b['item_id'] + i) % 22}", b["item_id"] * 3 + i) for b in _table(spark, "benchmark") for i in range(3)}
    near = {(s, j) for s, i in keys for j in range(max(0, i - 1), i + 3)}
    want = {str(r["doc_id"]) for s, docs in chunks.items() for j, r in enumerate(docs) if (s, j) in near}
    assert {r["id"] for r in catalogue.QUERIES["chunk_window"](spark, SF).collect()} == want and want


def test_last_line_of_an_order_whatever_the_size_of_keys(spark, tmp_path):
    """Part keys of a million and more don't reach into the line number's place."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("orders", [(1, 5), (2, 5), (3, 6)], "o_orderkey long, o_custkey long")
    lines = [(1, 1_500_000, 1, 1), (1, 100_000, 2, 2), (2, 7, 3_000_000, 1), (2, 8, 4, 1)]
    put("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    put("customer", [(5, 0, 1.0), (6, 0, -1.0)], "c_custkey long, c_nationkey int, c_acctbal double")
    put("nation", [(0,)], "n_nationkey int")
    got = catalogue.QUERIES["questions_with_info"](spark, str(tmp_path)).collect()
    assert {(r["o_orderkey"], r["l_partkey"], r["l_suppkey"]) for r in got} == {(1, 100_000, 2), (2, 8, 4)}
