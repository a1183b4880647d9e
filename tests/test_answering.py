"""Answering with resume, judging on the executors, stitching of fragments."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import fragments
from tessera.operators.answering import Answers, judged, verdict
from tessera.operators.slices import Downloads
from tessera.sources import files

WHO = {"answer_model": "m", "data_fingerprint": "f"}


def _asked(spark, n=20):
    return spark.createDataFrame([(f"q{i:02d}", f"what is {i}") for i in range(n)], "qid string, question string")


def _teller(folder, broken=()):
    """Answers and leaves a file for each call; the questions in broken raise."""

    def make():
        def ask(row):
            open(f"{folder}/{row['qid']}", "a").write("x")
            if row["qid"] in broken:
                raise ValueError("not now")
            return {"answer": row["question"].upper(), "trajectory": ["a", "b"], "total_cost": 0.5}

        return ask

    return make


def _calls(folder):
    return {p.name: len(p.read_text()) for p in folder.iterdir()}


def test_a_stopped_run_continues(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()
    answers, q = Answers(spark, str(tmp_path / "a")), _asked(spark)
    commit = Answers._committed

    def stops(self, part, base, key, good):
        if len(self.log.entries()) == 2:
            raise KeyboardInterrupt
        return commit(self, part, base, key, good)

    with monkeypatch.context() as m:
        m.setattr(Answers, "_committed", stops)
        with pytest.raises(KeyboardInterrupt):
            answers.run(q, _teller(calls, {"q03"}), WHO, size=6)
    assert answers.rows().count() == 12
    told = answers.run(q, _teller(calls, {"q05"}), WHO, size=6)
    # q03 failed and is tried again; q12 to q17 were asked but not committed.
    assert told == {"answered": 9, "failed": 0, "total": 20}
    rows = answers.rows().collect()
    assert sum(r["error"] is None for r in rows) == 20 and len(rows) == 21
    seen = _calls(calls)
    assert seen == {f"q{i:02d}": 2 if i == 3 or 12 <= i < 18 else 1 for i in range(20)}
    latest = {r["qid"]: r for r in answers.latest().collect()}
    assert len(latest) == 20 and latest["q03"]["pred_answer"] == "WHAT IS 3" and latest["q03"]["trajectory"] == ["a", "b"]
    assert answers.run(q, _teller(calls), WHO) == {"answered": 0, "failed": 0, "total": 20}
    # Other data: everything is asked again, up to a limit.
    assert answers.run(q, _teller(calls), WHO | {"data_fingerprint": "g"}, limit=7, size=4)["answered"] == 7


def test_errors_are_rows(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    answers, q = Answers(spark, str(tmp_path / "a")), _asked(spark, 3)
    assert answers.run(q, _teller(calls, {"q01"}), WHO) == {"answered": 3, "failed": 1, "total": 3}
    assert _calls(calls) == {"q00": 1, "q01": 1, "q02": 1}
    bad = answers.latest().where("qid = 'q01'").head()
    assert (bad["pred_answer"], bad["error"], bad["total_cost"]) == ("Error: not now", "not now", 0.0)
    assert answers.run(q.limit(0), _teller(calls), WHO) == {"answered": 0, "failed": 0, "total": 0}


def test_two_runs_at_once_leave_one_answer(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()
    answers, q = Answers(spark, str(tmp_path / "a")), _asked(spark, 6)
    commit, first = Answers._committed, []

    def raced(self, part, base, key, good):
        if not first:
            first.append(1)
            Answers(spark, self.path).run(q.where("qid < 'q04'"), _teller(calls), WHO)
        return commit(self, part, base, key, good)

    monkeypatch.setattr(Answers, "_committed", raced)
    assert answers.run(q, _teller(calls), WHO)["answered"] == 2
    assert sorted(r["qid"] for r in answers.rows().collect()) == [f"q{i:02d}" for i in range(6)]


def test_downloads_go_on_where_a_worker_died(spark, tmp_path):
    """The worker dies at one file; only its slice is fetched again."""
    calls = tmp_path / "calls"
    calls.mkdir()
    wanted = spark.createDataFrame([(f"d{i:02d}", f"http://h/{i:02d}") for i in range(24)], "document_id string, url string")

    def fetch(url, folder=str(calls)):
        import os

        name = url[-2:]
        with open(f"{folder}/{name}", "a") as f:
            f.write("x")
        if name == "13" and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)
        if name == "20":
            raise LookupError("404")
        return b"%PDF-1.4 %%EOF"

    store = Downloads(spark, str(tmp_path / "d"))
    get = lambda rows: files.downloaded(rows, fetch, files.pdf_problem)
    with pytest.raises(Exception):
        store.run(wanted, get, size=8)
    assert store.files().count() == 8
    assert store.run(wanted, get, size=8) == {"downloaded": 15, "failed": 1}
    count = {k: v for k, v in _calls(calls).items() if k != "died"}
    assert len(count) == 24 and all(count[f"{i:02d}"] == 1 for i in (*range(8), *range(16, 24))) and max(count.values()) == 2
    assert store.files().count() == 23 and store.run(wanted, get) == {"downloaded": 0, "failed": 1}


def test_judges(spark):
    cases = spark.createDataFrame([("x", "x", "q"), ("y", "z", "q"), ("z", "z", "away")], "generated string, reference string, question string")

    def make():
        def judge(prompt):
            if "away" in prompt:
                raise ValueError("away")
            same = prompt.split("Reference answer: ")[1][0] == prompt.split("\nAnswer: ")[1][0]
            return json.dumps({"correct": same, "reasoning": "r"})

        return judge

    assert sorted(tuple(r) for r in judged(cases, make).select("generated", "score", "reasoning").collect()) == [("x", 1.0, "r"), ("y", 0.0, "r"), ("z", 0.0, "Error: away")]
    assert verdict("it is FALSE")["score"] == 0.0 and verdict("True!")["score"] == 1.0
    assert verdict("?") == {"score": 0.0, "reasoning": "the reply can't be read"}
    assert verdict('```json\n{"correct": true, "reasoning": "a", "b": "c')["score"] == 1.0


WHOLE = json.dumps({"table_of_contents": [{"structure": f"{i}.1", "title": f'Sec "{i}" [x] {{y}}, é', "page": i if i % 3 else None} for i in range(6)]}, ensure_ascii=False)


def test_fragments_cut_anywhere():
    for i in range(1, len(WHOLE)):
        for parts in ([WHOLE[:i], WHOLE[i:]], [WHOLE[:i], WHOLE[max(0, i - 20) :]], [WHOLE[:i], WHOLE[i : i + 40], WHOLE[i + 40 :]]):
            assert json.loads(fragments.stitch(parts)) == json.loads(WHOLE), (i, parts)


def test_what_is_open_is_closed():
    for i in range(1, len(WHOLE) + 1):
        value = json.loads(fragments.closed(WHOLE[:i]))
        whole = json.loads(WHOLE)["table_of_contents"]
        listed = value.get("table_of_contents", [])
        assert all(x == whole[j] or x.items() <= whole[j].items() for j, x in enumerate(listed))
    assert fragments.closed("[1, 2") == "[1]" and fragments.closed("[tru") == "[]" and fragments.closed('{"a": {"b') == '{"a": {}}'
    assert fragments.overlap("abcab", "abx") == 2 and fragments.overlap("", "a") == 0 and fragments.overlap("aaa", "aa") == 2


def test_stitched_columns(spark):
    rows = [([WHOLE],), ([f"```json\n{WHOLE[:70]}\n```", f"```json\n{WHOLE[70:]}```"],), (["nothing"],), (None,), (["[1, "],), ([],), ([None, WHOLE],)]
    df = spark.createDataFrame(rows, "f array<string>")
    got = [r[0] for r in df.select(F.size(fragments.contents(fragments.stitched(F.col("f"))))).collect()]
    assert got[:2] == [6, 6] and got[2:4] == [None, None] and got[6] == 6
