"""Readers, writers, store, documents, cases, streaming and the tool loop."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import payloads, ranks
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import agent, answering, cases, documents, indexing, store
from tessera.operators import retrieval as R
from tessera.operators import scoring as S
from tessera.operators import toc as O
from tessera.sources import files, shared, sinks
from tessera.sources import tables as T
from tessera.streaming import ingest


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_jsonl_strict(spark, tmp_path):
    good = files.jsonl_strict(spark, _write(tmp_path / "a.jsonl", '{"a": 1}\n\n {"a": 2}\n')).collect()
    assert [r["line"] for r in good] == [1, 3]
    for bad, why in (('{"a": 1}\nnot json', "2"), ("[1]", "no object")):
        with pytest.raises(Exception, match=why):
            files.jsonl_strict(spark, _write(tmp_path / "b.jsonl", bad)).collect()
    assert files.jsonl(spark, _write(tmp_path / "c.jsonl", '{"a": 1}\n\n{"a": 2}\n'), "a int").count() == 2


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("p.jsonl", '{"question_id": " q1 ", "prediction": "a"}\n{"id": "q2", "answer": {"value": 3}, "status": "x"}\n{"id": "q1", "response": "b"}', {"q1": ("b", "success"), "q2": ("3", "x")}),
        ("p.json", '[{"id": "q", "prediction": null, "answer": "x"}]', {"q": ("", "success")}),
        ("p.json", '{"items": {"q": {"output": "o"}, "r": "plain"}}', {"q": ("o", "success"), "r": ("plain", "success")}),
        ("p.json", '{"q": {"model_answer": "m"}}', {"q": ("m", "success")}),
    ],
)
def test_predictions(spark, tmp_path, name, text, want):
    rows = files.predictions(spark, _write(tmp_path / name, text)).collect()
    assert {r["question_id"]: (r["prediction"], r["status"]) for r in rows} == want


def test_prediction_without_id_raises(spark, tmp_path):
    with pytest.raises(Exception, match="no id"):
        files.predictions(spark, _write(tmp_path / "p.jsonl", '{"prediction": "a"}')).collect()


@pytest.mark.parametrize(
    ("text", "problems"),
    [
        ('{"question_id": "a", "prediction": "x"}', []),
        ("", ["no rows"]),
        ("nope", ["not JSON"]),
        ("[1]", ["no object"]),
        ('{"question_id": "a"}', ["keys"]),
        ('{"question_id": "a", "prediction": "x", "z": 1}', ["keys"]),
        ('{"question_id": " ", "prediction": "x"}', ["id is blank"]),
        ('{"question_id": 1, "prediction": "x"}', ["id is no text"]),
        ('{"question_id": "a", "prediction": 1}', ["prediction is no text"]),
        ('{"question_id": "a", "prediction": "x"}\n{"question_id": "a ", "prediction": "y"}', ["id is there twice"]),
    ],
)
def test_submission_problems(spark, tmp_path, text, problems):
    assert [r["problem"] for r in files.submission_problems(spark, _write(tmp_path / "s.jsonl", text)).collect()] == problems
    assert files.submission_problems(spark, "s.json").first()["problem"] == "not a .jsonl file"


def test_pdfs_markdown_and_lists(spark, tmp_path):
    for name, data in (("a", b"%PDF-1.4\nx%%EOF"), ("b", b"%PDF-1.4\ntruncated"), ("c", b"not a PDF"), ("d", b"")):
        (tmp_path / f"{name}.pdf").write_bytes(data)
    wanted = spark.createDataFrame([(f"{x}.pdf",) for x in "abcd"], "file string")
    found = {r["file"]: r["problem"] for r in files.pdf_problems(spark, str(tmp_path), wanted).collect()}
    assert found == {"a.pdf": None, "b.pdf": "PDF EOF marker is missing", "c.pdf": "PDF signature is missing", "d.pdf": "PDF is missing or empty"}
    (tmp_path / "sub").mkdir()
    _write(tmp_path / "sub" / "x.md", "# T\n\ntext")
    assert files.markdown(spark, str(tmp_path)).first()["text"] == "# T\n\ntext"
    _write(tmp_path / "sub" / "final_results.json", '[{"a": 1}, {"a": 2}]')
    assert files.result_files(spark, str(tmp_path)).count() == 2
    assert [r["name"] for r in files.subset(spark, _write(tmp_path / "s.txt", "# c\n\nq:one\n two \n")).collect()] == ["one", "two"]
    assert files.results(spark, _write(tmp_path / "r.json", '{"meta": 1, "results": [{"a": 1}]}')).count() == 1
    rows = spark.createDataFrame([("a", "https://x/y"), ("b", "ftp://x"), ("c", "http:///p"), (" ", "http://x"), ("d", "http://x"), ("d", "http://x")], "document_id string, url string")
    assert sorted(str(r["problem"]) for r in files.catalog(rows).collect()) == ["None", "bad url", "bad url", "blank id", "id is there twice", "id is there twice"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "a", 1), ("q2", None, 2)], "question_id string, prediction string, no int")
    assert sinks.submission(rows, str(tmp_path / "s")) == 1 and sinks.submission(rows.where("no = 2"), str(tmp_path / "none")) == 0
    assert json.loads(spark.read.text(str(tmp_path / "s")).first()[0]) == {"question_id": "q1", "prediction": "a"} and not (tmp_path / "none").exists()
    sinks.frozen(rows, "no", str(tmp_path / "f"))
    sinks.append(rows, str(tmp_path / "app"))
    sinks.append(rows, str(tmp_path / "app"))
    assert sinks.tolerant(spark, str(tmp_path / "app"), rows.schema).count() == 4
    plain, logs = sinks.split_logs(spark.createDataFrame([("t", "log", None), ("u", None, "")], "test_id string, agentic_log string, agentic_debug string"))
    assert plain.columns == ["test_id"] and [r["test_id"] for r in logs.collect()] == ["t"]
    rows.write.parquet(str(tmp_path / "table"))
    assert sinks.emptied(spark, {"t": str(tmp_path / "table"), "u": str(tmp_path / "absent")}) == ["t"] and spark.read.parquet(str(tmp_path / "table")).count() == 0
    assert sinks.output_dir("a/", "r") == "a/r" and sinks.output_dir("a", "r", False) == "a"
    scored = S.scored(spark.createDataFrame([("q", "a", "a", "Str", "", "ok")], "question_id string, gold string, prediction string, raw_format string, verification_rule string, status string"))
    sinks.per_question(scored, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(sinks.PER_QUESTION)
    sinks.results(scored, S.bucket(scored), str(tmp_path / "res"), run="r1")
    assert spark.read.json(str(tmp_path / "res/metrics")).first()["run"] == "r1"


def test_store(spark, tmp_path):
    path = str(tmp_path / "c")
    store.replace_sources(path, spark.createDataFrame([("a", 1), ("b", 1)], "source_path string, v int"))
    store.replace_sources(path, spark.createDataFrame([("b", 2), ("b", 3)], "source_path string, v int"))
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("source_path", "v").collect()) == [("a", 1), ("b", 2), ("b", 3)]
    rows = spark.createDataFrame([("/old/datasets/x.pdf", "one"), ("datasets/x.pdf", "one"), ("/old/datasets/y.pdf", "first"), ("datasets/y.pdf", "different")], "source_path string, content string")
    kept, conflicts = store.migrated(rows, ["content"])
    assert [tuple(r) for r in kept.collect()] == [("datasets/x.pdf", "one")] and [r["target"] for r in conflicts.collect()] == ["datasets/y.pdf"]
    again, _ = store.migrated(kept, ["content"])
    assert again.collect() == kept.collect()


def test_documents(spark):
    e = [("d", "#/texts/0", "text", "section_header", "# Head", 1, 1), ("d", "#/texts/1", "text", "paragraph", "one", 1, None), ("d", "#/texts/2", "text", "list_item", "two", 2, None), ("d", "#/groups/0", "group", "list", None, None, None), ("d", "#/groups/1", "group", "list", None, None, None), ("d", "#/tables/0", "table", "table", "| t |", 3, None)]
    elements = spark.createDataFrame(e, "doc string, ref string, kind string, label string, text string, page int, level int")
    edges = spark.createDataFrame([("d", "#/body", 0, "#/texts/0"), ("d", "#/body", 1, "#/groups/0"), ("d", "#/body", 2, "#/pictures/0"), ("d", "#/body", 3, "#/tables/0"), ("d", "#/groups/0", 0, "#/texts/1"), ("d", "#/groups/0", 1, "#/groups/1"), ("d", "#/groups/1", 0, "#/texts/2")], "doc string, parent string, ord int, child string")
    override = spark.createDataFrame([("d", "#/texts/0", "## Better")], "doc string, ref string, text string")
    items = documents.body_items(elements, edges, override).orderBy("pos").collect()
    assert [(r["label"], r["text"], r["page"]) for r in items] == [("section_header", "Better", 1), ("grouped_paragraph", "one", 1), ("grouped_paragraph", "two", 2), ("table", "| t |", 3)]
    assert [tuple(r) for r in documents.flattened_groups(elements, edges).collect()] == [("d", "#/groups/0", "one two", 1)]
    tocs = spark.createDataFrame([("p", 1, 1), ("q", 1, 1), ("r", 2, 1)], "source_path string, total_chunks int, meta_total int")
    chunks = spark.createDataFrame([("p", None, None, "c1", "text"), ("q", None, None, "c1", " ")], "source_path string, in_section string, section_id string, chunk_id string, text string")
    valid = documents.toc_problems(tocs, chunks)
    assert {r["source_path"]: r["valid"] for r in valid.collect()} == {"p": True, "q": False, "r": False}
    cached = spark.createDataFrame([("p", "t", "local", 0, [0.1]), ("q", "t", "local", 0, [float("nan")])], "source_path string, content string, source_kind string, chunk_index int, embedding array<double>")
    assert {r["source_path"]: r["valid"] for r in documents.cache_problems(tocs, cached, valid).collect()} == {"p": True, "q": False, "r": False}
    done, failed = documents.isolated(spark.createDataFrame([("1",), ("x",)], "t string"), lambda t: [str(int(t))], "t")
    assert done.count() == 1 and failed.first()["error"].startswith("ValueError")
    made = documents.embedded(cached, lambda: lambda texts: [[float(len(t))] for t in texts], prefix="q: ", unit=False).first()["embedding"]
    many = documents.embedded(spark.range(250).select(F.lit("abcd").alias("content")), lambda: lambda texts: [[3.0, 4.0] if len(texts) <= 96 else [0.0, 1.0] for _ in texts]).distinct().collect()
    assert [r["embedding"] for r in many] == [[0.6, 0.8]]
    assert made == [4.0] and documents.sentence_index(spark.createDataFrame([(1, "A long sentence. Short. Another long one!")], "k int, content string"), ["k"]).count() == 2


def _parsed(spark):
    items = [("d", 0, "paragraph", None, 1, "before"), ("d", 1, "section_header", 1, 2, "Empty"), ("d", 2, "section_header", 2, 2, "Top"), ("d", 3, "paragraph", None, 3, "abcdefghijk. " * 110), ("d", 4, "table", None, 4, "| a |"), ("d", 5, "section_header", 3, None, "Low"), ("d", 6, "paragraph", None, 7, "two")]
    rows = spark.createDataFrame([(1, *x[1:]) for x in items], "doc long, pos long, label string, level int, page int, text string")
    return indexing.parsed(rows)


def test_items_become_an_index(spark):
    sections, chunks = _parsed(spark)
    assert [(r["id"], r["parent_id"], r["depth"], r["page_start"], r["chunk_count"], r["breadcrumb"]) for r in sections.orderBy("section").collect()] == [("section_2", None, 0, 2, 3, "Empty > Top"), ("section_3", "section_2", 1, 7, 1, "Top > Empty > Low")]
    found = chunks.orderBy("chunk_no").collect()
    assert [(r["id"], r["section_id"], r["position"], r["label"], r["page"]) for r in found] == [("chunk_1", None, None, "paragraph", 1), ("chunk_2", "section_2", 1, "paragraph", 3), ("chunk_3", "section_2", 2, "paragraph", 3), ("chunk_4", "section_2", 3, "table", 4), ("chunk_5", "section_3", 1, "paragraph", 7)]
    assert found[0]["text"] == "before" and found[1]["text"].startswith("Empty > Top\n\nabcdefghijk. a") and found[1]["char_count"] == len(found[1]["text"]) - 13
    rows = indexing.chunk_rows(sections, chunks).orderBy("chunk_index").collect()
    assert [r["section_id"] for r in rows] == ["section_2", "section_2", "section_2", "section_3", None] and rows[3]["section_chain"] == ["section_2"]
    toc = indexing.tocs(sections, chunks).first()
    whole = json.loads(toc["toc_json"])
    assert (toc["total_sections"], toc["total_chunks"]) == (2, 5) and whole["meta"]["orphan_chunks"] == 1 and "depth" not in whole["toc"][0] and whole["toc"][1]["section_chain"] == ["section_2"]
    assert [len(x["chunks"]) for x in whole["sections"]] == [3, 1] and whole["orphan_chunks"][0]["text"] == "before"


def test_publishing_is_all_or_nothing(spark, tmp_path):
    sections, chunks = _parsed(spark)
    path, toc, records = str(tmp_path / "index"), indexing.tocs(sections, chunks), indexing.section_records(sections)
    assert indexing.load_tocs(spark, path, ["1"]).count() == 0
    indexing.publish(path, toc, records)
    held = indexing.current(spark, path, "sections")
    assert [(r["ordinal"], r["content"], r["section_count"]) for r in held.orderBy("ordinal").collect()] == [(0, "Top\nEmpty > Top", 2), (1, "Low\nTop > Empty > Low", 2)]
    with pytest.raises(Exception, match="broken"):
        indexing.publish(path, toc, records.withColumn("content", F.raise_error(F.lit("broken")).cast("string")))
    assert indexing.current(spark, path, "toc").count() == 1 and indexing.current(spark, path, "sections").count() == 2
    indexing.publish(path, toc.withColumn("toc_json", F.lit("[1]")), records.where("ordinal = 0"))
    assert indexing.current(spark, path, "sections").count() == 1 and indexing.load_tocs(spark, path, ["1", "2"]).count() == 1
    with pytest.raises(Exception, match="not an object"):
        indexing.load_toc_strict(spark, path, "1").collect()
    assert indexing.load_toc_strict(spark, path, "2").count() == 0


def test_two_writers_of_an_index(spark, tmp_path):
    """Of two that began together one is first; the other goes on only with other sources."""
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(p, i, f"s{i}") for p in "abc" for i in range(3)], "source_path string, ordinal long, section_id string").withColumns({"section_title": F.col("section_id"), "breadcrumb": F.col("section_id"), "page_start": F.lit(1), "direct_chunk_count": F.lit(1), "char_count": F.lit(1)})
    toc = rows.select("source_path").distinct().withColumn("toc_json", F.lit("{}"))
    indexing.publish(path, toc, rows)
    before = indexing.current(spark, path, "sections")
    real, calls = shared.CommitLog.put, []

    def raced(self, number, entry):
        if not calls:  # another writer is faster, for the sources that calls names
            calls.append(1)
            indexing.publish(path, toc.where("source_path = 'a'"), rows.where("source_path = 'a' and ordinal < 2"))
        return real(self, number, entry)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(shared.CommitLog, "put", raced)
        indexing.publish(path, toc.where("source_path = 'b'"), rows.where("source_path = 'b' and ordinal < 1"))
        count = lambda df: {r["source_path"]: r["count"] for r in df.groupBy("source_path").count().collect()}
        assert count(indexing.current(spark, path, "sections")) == {"a": 2, "b": 1, "c": 3}
        calls.clear()
        with pytest.raises(shared.ConflictError):
            indexing.publish(path, toc.where("source_path = 'a'"), rows.where("source_path = 'a' and ordinal < 1"))
        calls.clear()
        made = lambda: (toc.where("source_path = 'a'"), rows.where("source_path = 'a' and ordinal < 1"))
        indexing.published(path, made)
    assert count(indexing.current(spark, path, "sections")) == {"a": 1, "b": 1, "c": 3}
    assert count(before) == {"a": 3, "b": 3, "c": 3}
    assert len(indexing.expire(spark, path, keep=1)) == 3 and indexing.expire(spark, path, keep=1) == []
    assert count(indexing.current(spark, path, "sections")) == {"a": 1, "b": 1, "c": 3}


def test_sentence_index_and_parse_cache(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "A long sentence here. Another long one!"), ("b", 0, "Something else entirely.")], "doc string, no long, content string")
    path, model = str(tmp_path / "sentences"), lambda: lambda texts: [[3.0, 4.0] for _ in texts]
    told = lambda c, name: {r["doc"]: r["matches"] for r in documents.index_matches(c, "doc", "no", name, path).collect()}
    assert told(chunks, "m") == {"a": False, "b": False}
    documents.build_sentence_index(chunks, "doc", "no", model, "m", path)
    assert spark.read.parquet(path).count() == 3 and told(chunks, "m") == {"a": True, "b": True} and not any(told(chunks, "other").values())
    changed = chunks.withColumn("content", F.when(F.col("doc") == "a", "New text stands here.").otherwise(F.col("content")))
    assert told(changed, "m") == {"a": False, "b": True}
    documents.build_sentence_index(changed.where("doc = 'a'"), "doc", "no", model, "m", path)
    assert told(changed, "m") == {"a": True, "b": True} and spark.read.parquet(path).count() == 2
    files_ = spark.createDataFrame([("x", "h1", "1"), ("y", "h1", "1"), ("z", "h2", "bad")], "file string, file_hash string, content string")
    cache = str(tmp_path / "cache")
    for parse in (lambda t: [str(int(t))], lambda t: ["again"]):
        found = {r["file"]: r["result"] for r in documents.parsed_with_cache(files_, parse, cache).collect()}
    assert found == {"x": ["1"], "y": ["1"], "z": ["again"]}


def test_downloads(spark):
    wanted = spark.createDataFrame([(x, f"http://h/{x}") for x in ("good", "cut", "gone", "lost", "down")], "document_id string, url string")

    def fetch(url):
        name = url.rpartition("/")[2]
        if name in ("gone", "lost"):
            raise LookupError("404")
        if name == "down":
            raise OSError("503")
        return b"%PDF-1.4" if name == "cut" else b"%PDF-1.4 %%EOF"

    rows = files.downloaded(wanted, fetch, files.pdf_problem, lambda url: "http://a/archived" if "gone" in url else None).collect()
    assert {r["document_id"]: (r["content"] is not None, r["problem"], r["attempts"]) for r in rows} == {"good": (True, None, 1), "cut": (False, "PDF EOF marker is missing", 3), "gone": (True, None, 2), "lost": (False, "not found: 404", 1), "down": (False, "OSError: 503", 3)}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("top/in/a.txt", "top/in/b/c.txt", "top/out.txt"):
            z.writestr(name, name)
    found = files.unzipped(spark.createDataFrame([(data.getvalue(),)], "content binary"), "top/in").collect()
    assert {r["file"]: bytes(r["content"]) for r in found} == {"a.txt": b"top/in/a.txt", "b/c.txt": b"top/in/b/c.txt"}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("top/../../evil", "x")
    with pytest.raises(Exception, match="unsafe"):
        files.unzipped(spark.createDataFrame([(data.getvalue(),)], "content binary"), "top").collect()


def test_reports_and_debug(spark, tmp_path):
    rows = S.scored(spark.createDataFrame([("q1", "a", "a", "Str", "", "ok", None), ("q2", "b", "x", "Str", "", "ok", "law")], "question_id string, gold string, prediction string, raw_format string, verification_rule string, status string, domain string"))
    report = S.report(rows, rows, rows.where("question_id = 'q1'").unionByName(rows.limit(1).withColumn("question_id", F.lit("extra"))), {"domain": F.array("domain")})
    sinks.report(report, str(tmp_path / "report"))
    told = json.loads(spark.read.text(str(tmp_path / "report")).first()[0])
    assert told["counts"] == {"evaluated": 2, "extra_prediction": 1, "gold": 2, "missing_prediction": 1, "prediction": 2}
    assert told["overall"]["accuracy"] == 0.5 and list(told["breakdowns"]["domain"]) == ["law", "unknown"] and told["breakdowns"]["domain"]["unknown"]["accuracy"] == 1.0
    cases_ = spark.createDataFrame([("direct", "p", True, 5), ("failed", None, False, 7)], "outcome string, prediction string, carried_forward boolean, input_tokens long").withColumns({c: F.lit(0) for c in S.TOKENS[1:]})
    sinks.debug(S.submission_counts(cases_), str(tmp_path / "debug"), commit="c")
    told = json.loads(spark.read.text(str(tmp_path / "debug")).first()[0])
    assert (told["selected"], told["emitted"], told["runtime_error_omitted"], told["carried_forward"], told["rerun"], told["total_input_tokens"], told["commit"]) == (2, 1, 1, 1, 1, 12, "c")
    assert sinks.summary(S.run_status(spark.createDataFrame([("completed",), ("skipped",)], "status string"))) == "Completed: 1\nFailed: 0\nSkipped: 1\nTotal: 2"
    done = S.normalised_results(spark.createDataFrame([("q", None, "b", "ans")], "question string, gold_answer string, reference string, answer string")).first()
    assert (done["reference"], done["generated"], done["status"]) == ("b", "ans", "completed")
    failed = S.error_results(spark.createDataFrame([("t", "x" * 300)], "test_id string, question string"), F.lit("why")).first()
    assert len(failed["question"]) == 100 and failed["status"] == "failed"


def test_case_joins(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "n int, doc string")
    info = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "doc string, seq int, kind string")
    assert {r["doc"]: r["info"] and r["info"]["kind"] for r in cases.with_info(q, info, "doc", "seq").collect()} == {"a": "new", "b": None}
    assert [r["doc"] for r in cases.with_files(q, info, "doc").collect()] == ["a"]
    assert cases.selected(q.where("n = 1"), q, "doc").count() == 1
    with pytest.raises(ValueError, match="unknown doc: zz"):
        cases.selected(spark.createDataFrame([("zz",)], "doc string"), q, "doc")
    order = spark.createDataFrame([("b", 3), ("a", 5), ("b", 9), ("c", 1)], "doc string, at int")
    assert [r["doc"] for r in cases.first_order(order, "doc", "at").collect()] == ["c", "b", "a"]
    assert spark.createDataFrame([("STRASSE",), ("Straße",)], "t string").where(cases.matches("straße", text=F.col("t"), ids=F.lit(""))).count() == 2


def test_cases(spark):
    ids = cases.question_ids("set_s_", [(1, 2)], spark)
    assert [r[0] for r in ids.collect()] == ["set_s_000001", "set_s_000002"]
    rows = spark.range(20).withColumnRenamed("id", "n")
    assert [r["n"] for r in cases.systematic(rows, "n", 7).orderBy("n").collect()] == [0, 7, 14]
    assert cases.limited(rows, "n", None).count() == 20 and cases.limited(rows, "n", 0).count() == 0 and cases.limited(rows, "n", -5).count() == 15
    routes = cases.availability(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "zz")], "case_id int, document_id string"), spark.createDataFrame([("a",), ("b",)], "document_id string"), spark.createDataFrame([("b", "no PDF")], "document_id string, reason string"))
    assert {r["case_id"]: (r["route"], r["reasons"]) for r in routes.collect()} == {1: ("skipped", "b: no PDF"), 2: ("runnable", ""), 3: ("fatal", "")}
    many = ranks.numbered(spark.range(10_000).select((F.col("id") % 3).alias("g"), "id"), "g", "id", "no")
    assert many.where("no <> id div 3").count() == 0


def test_streaming_upsert_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in" / "1.json", '{"id": "a", "content": "x"}\n{"id": "a", "content": "y"}\n{"id": "b", "content": "z"}')
    args = (spark, str(tmp_path / "in"), "id string, content string", str(tmp_path / "out"), str(tmp_path / "ck"))
    assert ingest.upsert_stream(*args).awaitTermination(120)
    _write(tmp_path / "in" / "2.json", '{"id": "b", "content": "again"}\n{"id": "c", "content": "w"}')
    assert ingest.upsert_stream(*args).awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "x"), ("b", "z"), ("c", "w")]


def test_windowed_costs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in" / "1.json", "\n".join(json.dumps({"ts": f"2024-01-01T0{h}:{m}:00Z", "tool": t, "cost": c}) for h, m, t, c in ((1, 10, "a", 1.0), (1, 50, "a", 2.0), (2, 10, "a", 4.0), (1, 20, "b", 8.0))))
    stream = spark.readStream.schema("ts timestamp, tool string, cost double").json(str(tmp_path / "in"))
    query = ingest.windowed_costs(stream).writeStream.format("memory").queryName("windowed_costs").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    found = spark.sql("select hour(start) as h, tool, calls, cost from windowed_costs order by all").collect()
    assert [tuple(r) for r in found] == [(1, "a", 2, 3.0), (1, "b", 1, 8.0), (2, "a", 1, 4.0)]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    _write(tmp_path / "many.jsonl", "\n".join(f'{{"n": {i}}}' if i % 3 else "" for i in range(1, 5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(tmp_path / "many.jsonl")).rdd.getNumPartitions() > 1
        found = files.numbered_lines(spark, str(tmp_path / "many.jsonl"))
        assert sorted(r["line"] for r in found.collect()) == list(range(1, 5000))
        rows = files.jsonl_strict(spark, str(tmp_path / "many.jsonl"))
        assert rows.where(F.col("line") != F.variant_get("value", "$.n", "long")).count() == 0 and rows.count() == 3333
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.fixture
def context(spark):
    texts = ["alpha needle text", "beta text", "gamma needle needle", "delta"]
    chunks = spark.createDataFrame([(str(i), "docs/spec.pdf", i, f"s{i // 2}", f"Section {i // 2}", t, "local") for i, t in enumerate(texts)], "id string, source_path string, chunk_index int, section_id string, section_title string, content string, source_kind string")
    sections = spark.createDataFrame([("docs/spec.pdf", f"s{i}", f"Section {i}", i, f"Section {i}", f"Section {i}") for i in range(2)], "source_path string, section_id string, title string, ordinal int, content string, breadcrumb string")
    embed = lambda df: df.withColumn("embedding", V.hash_embedding(F.col("content")))
    return agent.Context(embed(chunks), embed(sections), lambda q: spark.range(1).select(V.hash_embedding(F.lit(q)).alias("q")), ("docs/spec.pdf",))


def test_tool_loop(context):
    script = [[("hybrid_search", {"query": "needle"})], [("get_chunk_window", {"chunk_ids": ["docs/spec.pdf::0", "bad"], "after": 9})], [("nope", {}), ("get_section", {"file_id": "spec", "section_title": "section-1"})], [("submit_answer", {"answer": " "}), ("submit_answer", {"answer": "done"}), ("get_toc", {"file_id": "spec"})]]
    out = agent.run(context, "q", lambda q, s: script[s.iterations - 1])
    assert (out["answer"], out["stop_reason"], out["iterations"], out["calls"]) == ("done", "submit_answer_called", 4, 6)
    results = [x["result"] for x in out["log"]]
    assert results[0].startswith("4 chunks, 4 new") and "[CHUNK_ID: docs/spec.pdf::2] [SECTION_ID: s1] [SECTION: Section 1]\ngamma" in results[0]
    assert results[1].startswith("4 chunks, 0 new") and "[ALREADY RETURNED: docs/spec.pdf::3]" in results[1]
    assert results[2] == "Error: unknown tool nope" and results[3].startswith("2 chunks") and results[4] == "Error: the answer is empty"


def test_tool_loop_limits(context, spark):
    toc = [("get_toc", {"file_id": "spec.pdf"})]
    out = agent.run(context, "q", lambda q, s: toc, lambda q, text: "made up")
    assert (out["stop_reason"], out["answer"], out["iterations"], out["fallback_used"]) == ("stale_early_stop", agent.FALLBACKS[1], 5, True)
    assert out["log"][0]["result"] == "TOC for: docs/spec.pdf\nSections: 2  |  Total chunks: 0\n\n- [s0] Section 0  (0 chunks, page ?)\n- [s1] Section 1  (0 chunks, page ?)"
    seen = [("get_section", {"file_id": "spec", "section_id": "s1"})]
    out = agent.run(context, "q", lambda q, s: seen if s.iterations < 2 else [], lambda q, text: text.upper())
    assert out["stop_reason"] == "forced_final_synthesis" and "GAMMA NEEDLE" in out["answer"] and not out["fallback_used"]
    assert agent.run(context, "q", lambda q, s: [])["stop_reason"] == "no_tool_requests_empty"
    said = agent.run(context, "q", lambda q, s: agent.Turn(text=" plain ", input_tokens=7, cache_read_tokens=2))
    assert (said["stop_reason"], said["answer"], said["input_tokens"], said["cache_read_tokens"]) == ("no_tool_requests_with_text", "plain", 7, 2)
    out = agent.run(context, "q", lambda q, s: agent.Turn(toc, input_tokens=300_000))
    assert (out["stop_reason"], out["iterations"], out["input_tokens"], out["answer"]) == ("budget_exceeded_after_loop", 2, 600_000, agent.FALLBACKS[0])
    out = agent.run(context, "q", lambda q, s: toc * 40)
    assert (out["calls"], out["stop_reason"]) == (30, "budget_exceeded_after_loop") and out["log"][35]["result"] == "Error: the budget is exceeded"
    with pytest.raises(ValueError):
        agent.Context(context.chunks, context.sections, context.query_vector, enabled=("get_toc",))
    tools = agent.Tools(context, agent.State())
    assert tools.call("search_toc", {"query": "section"}).count("[s") == 2 and not tools.s.seen
    context.validate = lambda a: [] if "value" in a else ["value is missing"]
    assert tools.call("submit_answer", {"answer": "{}"}) == "Error: value is missing" and tools.call("submit_answer", {"answer": '```json\n{"value": 1\n```'}) == "accepted"
    assert tools.s.answer == '{"value": 1}'


def test_answers_with_a_schema(context):
    schema = payloads.closed_schema({"type": "object", "properties": {"answer": {"type": "string"}, "found": {"type": "boolean"}, "part": {"$ref": "#/$defs/P"}, "n": {"anyOf": [{"type": "integer"}, {"type": "null"}]}}, "required": ["answer"], "$defs": {"P": {"type": "object", "properties": {"x": {"type": "array", "items": {"type": "number"}}}}}})
    assert schema["additionalProperties"] is False and schema["properties"]["part"]["additionalProperties"] is False and "$defs" not in schema
    with pytest.raises(ValueError, match="recursive"):
        payloads.closed_schema({"$ref": "#/$defs/A", "$defs": {"A": {"type": "object", "properties": {"a": {"$ref": "#/$defs/A"}}}}})
    assert payloads.problems(schema, {"answer": "a", "n": None, "part": {"x": [1, 2.5]}}) == []
    assert payloads.problems(schema, {"found": 1, "other": 2, "part": {"x": ["a"]}, "n": True}) == ["answer.answer is missing", "answer.other is unknown", "answer.found is not of type boolean", "answer.part.x[0] is not of type number", "answer.n is not of type integer or null"]
    context = agent.Context(context.chunks, context.sections, context.query_vector, context.sources, schema=schema)
    seen = [("get_section", {"file_id": "spec", "section_id": "s1"})]
    script = lambda q, s: seen if s.iterations < 2 else agent.Turn(text="just text")
    out = agent.run(context, "q", script, lambda q, text: '{"answer": 5}')
    assert out["stop_reason"] == "no_final_answer" and json.loads(out["answer"]) == {"answer": agent.FALLBACKS[1], "found": False, "part": {"x": []}, "n": 0}
    out = agent.run(context, "q", script, lambda q, text: '{"answer": "a"')
    assert (out["stop_reason"], out["answer"]) == ("forced_final_synthesis", '{"answer": "a"}')
    assert payloads.coerced("x", {"title": 1, "interpretation": 2, "confidence": 3})["title"] == 1 and payloads.coerced("x", {"message": "m"})["found"] is False
    assert payloads.coerced("x", {"a": 1}) is None and payloads.coerced(" ", None) is None and payloads.coerced("plain", None)["sources"] == []
    key = lambda text: payloads.cache_key("m", "s", [], [{"role": "user", "content": [{"text": text}, {"text": "later"}]}])
    assert key("a") == key("a") != key("b")


def test_search_toc_tells_what_it_leaves_out(context, spark):
    states = spark.createDataFrame([("docs/spec.pdf", "OK", True), ("docs/missing.pdf", "MISSING_TOC", False)], "source_path string, status string, eligible boolean")
    both = agent.Context(context.chunks, context.sections, context.query_vector, ("docs/spec.pdf", "docs/missing.pdf"), index_states=states)
    found = agent.Tools(both, agent.State()).call("search_toc", {"query": "section"}).split("\n")
    assert found[:2] == ["[SEARCH_TOC_WARNING: MISSING_TOC file_id=docs/missing.pdf]", "2 TOC section(s) returned:"]
    none = agent.Context(context.chunks, context.sections, context.query_vector, ("docs/missing.pdf",), index_states=states)
    assert agent.Tools(none, agent.State()).call("search_toc", {"query": "section"}).endswith("No searchable TOC sections in the effective scope.")
    broken = agent.Context(context.chunks, context.sections.withColumn("embedding", F.raise_error(F.lit("no vectors")).cast("array<double>")), context.query_vector, ("docs/spec.pdf",))
    found = agent.Tools(broken, agent.State()).call("search_toc", {"query": "section"}).split("\n")
    assert found[0] == "[SEARCH_TOC_WARNING: SEMANTIC_RETRIEVAL_FAILED]" and len(found) == 4
    legs = []
    bad = context.chunks.withColumn("embedding", F.raise_error(F.lit("no vectors")).cast("array<double>"))
    top = R.hybrid(bad, "needle", context.query_vector("needle"), warn=lambda name, e: legs.append(name))
    assert top.count() == 2 and legs == ["semantic"]


def test_runs_in_parallel_keep_their_order(context):
    def policy(question, state):
        if question == "bad":
            raise RuntimeError("no model")
        return [("submit_answer", {"answer": question})]

    out = agent.run_all(context, ["a", "bad", "c"], policy, workers=3)
    assert [(r["status"], r.get("answer")) for r in out] == [("completed", "a"), ("failed", None), ("completed", "c")] and out[1]["error"] == "RuntimeError: no model"
    cases = [{"question": q, "reference": "r", "generated": q} for q in ("x", "y", "z")]
    judge = lambda prompt: {"x": '{"correct": true, "reasoning": "same"}', "y": "that is false", "z": "?"}[prompt.split("\nAnswer: ")[1][0]]
    scored = answering.judged(context.chunks.sparkSession.createDataFrame(cases), lambda: judge).orderBy("question").collect()
    assert [(r["score"], r["reasoning"]) for r in scored] == [(1.0, "same"), (0.0, ""), (0.0, "the reply can't be read")]
    with pytest.raises(ValueError):
        agent.run_all(context, [], policy, workers=0)


def test_resolution_and_rendering(spark):
    found = R.resolve_file(spark.createDataFrame([("SPEC",), ("zzz",)], "file_id string"), spark.createDataFrame([("docs/spec.pdf",), ("docs/a spec.pdf",)], "source_path string"))
    assert {r["file_id"]: r["source_path"] for r in found.collect()} == {"SPEC": "docs/a spec.pdf", "zzz": None}
    line = spark.createDataFrame([("p", 1, "section_1", "Payment schedule", None, 1, 3)], "source_path string, ordinal long, id string, title string, depth int, chunk_count int, page_start int")
    assert O.rendered(line).first()["rendered"] == "TOC for: p\nSections: 1  |  Total chunks: 1\n\n- [section_1] Payment schedule  (1 chunks, page 3)"
    assert spark.range(1).select(X.status_label(F.lit(0.7)).alias("s")).first()["s"] == "PASS"


def test_groups_of_any_depth(spark):
    """A chain of 40 groups with a text at each, groups that nothing leads to, a loop."""
    n = 40
    chain = [(1, "#/body" if i == 0 else f"g{i - 1}", i % 3, f"g{i}") for i in range(n)]
    texts = [(1, f"g{i}", 5, f"t{i}") for i in range(n)] + [(1, "#/body", 9, "last"), (1, "lost", 0, "t0"), (1, "g0", 7, "missing")]
    lost = [(1, "far", 0, "lost")]
    elements = [(1, f"g{i}", "group") for i in range(n)] + [(1, "lost", "group")] + [(1, f"t{i}", "text") for i in range(n)] + [(1, "last", "text")]
    e = spark.createDataFrame([(d, r, k, "paragraph", r, 1, None) for d, r, k in elements], "doc int, ref string, kind string, label string, text string, page int, level int")
    g = spark.createDataFrame(chain + texts + lost, "doc int, parent string, ord int, child string")
    got = {r["ref"]: r["path"] for r in documents.leaves(e, g).collect()}
    assert got == {**{f"t{i}": [j % 3 for j in range(i + 1)] + [5] for i in range(n)}, "last": [9]}
    loop = g.union(spark.createDataFrame([(1, "g3", 8, "g1")], g.schema))
    with pytest.raises(ValueError, match="inside itself"):
        documents.leaves(e, loop)
    flat = documents.leaves(e.where("kind = 'text'"), g.where("parent = '#/body'"))
    assert [r["ref"] for r in flat.collect()] == ["last"]


def test_case_folding(spark):
    rows = spark.createDataFrame([("ein ﬁle", ["Straße"]), ("plain FILE", ["x"]), (None, None)], "t string, s array<string>")
    told = lambda c: [r[0] for r in rows.select(c).collect()]
    ids = F.lit("id")
    assert told(cases.matches(question="FILE", text=F.col("t"), ids=ids)) == [True, True, None]
    assert told(cases.matches(source="STRASSE", sources=F.col("s"))) == [True, False, None]


def test_a_table_of_enough_parts_is_not_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "LOOK_BYTES", 0)
    rows = spark.range(1000).withColumn("text", F.repeat(F.col("id").cast("string"), 50))
    for n in (1, 4):
        rows.repartition(n).write.parquet(str(tmp_path / str(n)))
    dealt = {n: "Exchange" in T.spread(spark.read.parquet(str(tmp_path / str(n))))._jdf.queryExecution().executedPlan().toString() for n in (1, 4)}
    assert dealt == {1: True, 4: False}
