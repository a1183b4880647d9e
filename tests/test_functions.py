"""Predicates, text functions and vectors on literals."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import retrieval as R


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_predicates(spark):
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, "s")], "source_path string, chunk_index int, section_id string")
    n = lambda f: rows.where(P.compiled(f)).count()
    assert n(None) == n({}) == n({"operator": "AND", "conditions": []}) == 2
    assert n(P.equal("section_id", None)) == 0 and n(P.equal("meta.source_path", "a")) == 1
    assert n({"field": "chunk_index", "operator": "in", "value": []}) == 0
    both = [P.equal("source_path", "a"), P.equal("chunk_index", 2)]
    assert n({"operator": "and", "conditions": both}) == 0 and n({"operator": "NOT", "conditions": both}) == 2
    for bad in (P.equal("other", 1), {"field": "chunk_index", "operator": ">", "value": 1}, {"field": "chunk_index", "operator": "in", "value": 1}):
        with pytest.raises(ValueError):
            P.compiled(bad)
    assert n(P.scope(None, "a", None, "t")[0] | {}) == n(P.both(P.equal("source_path", "a"), P.equal("section_title", "t"))) if "section_title" in rows.columns else True


@pytest.mark.parametrize(
    ("text", "want"),
    [("  The answer is Answer: The cat! ", "cat"), ("an 17.40% - a b", "17.40% - b"), ("", ""), ("answer is the answer is x", "answer is x"), ("É, the É", "é é")],
)
def test_normalised_answer(spark, text, want):
    assert _one(spark, X.normalised_answer(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("$1,234.50", 1234.5), ("-.5 x", -0.5), ("none", None), ("a 1 2", 12.0)])
def test_number(spark, text, want):
    assert _one(spark, X.number(F.lit(text))) == want


@pytest.mark.parametrize(
    ("prediction", "gold", "kind", "want"),
    [
        ("It is not answerable.", "", "unanswerable", 1.0),
        ("CONTEXT_OVERFLOW", "", "unanswerable", 1.0),
        ("incorrect", "yes", "boolean", 1.0),
        ("unknown", "false", "boolean", 1.0),
        ("maybe", "false", "boolean", 0.0),
        ("104", "100", "numeric", 1.0),
        ("106", "100", "numeric", 0.0),
        ("0.0000001", "0", "numeric", 1.0),
        ("nothing", "nothing", "numeric", 1.0),
        ("Option B", "b", "single_choice", 1.0),
        ("C", "B", "single_choice", 0.0),
        ("x alpha y", "alpha", "entity", 1.0),
        ("alphq", "alpha", "entity", 1.0),
        ("beta", "alpha", "entity", 0.0),
    ],
)
def test_relaxed_accuracy(spark, prediction, gold, kind, want):
    assert _one(spark, X.relaxed_accuracy(F.lit(prediction), F.lit(gold), F.lit(kind))) == want


def test_similarity_and_f1(spark):
    assert _one(spark, X.similarity(F.lit(" é"), F.lit("e"))) == 0.0 and _one(spark, X.similarity(F.lit(""), F.lit(" "))) == 1.0
    assert _one(spark, X.anls(F.lit("abcd"), F.lit("abxy"))) == 0.5 and _one(spark, X.anls(F.lit("abcd"), F.lit("axyz"))) == 0.0
    assert _one(spark, X.token_f1(F.lit("a cat cat sat"), F.lit("the cat"))) == pytest.approx(2 / 3) and _one(spark, X.token_f1(F.lit(""), F.lit(""))) == 1.0


def test_keys_and_names(spark):
    assert _one(spark, X.match_key(F.lit(" Rapport_Été-2020..pdf "))) == "rapport ete 2020 pdf"
    assert _one(spark, X.portable_key(F.lit("C:\\old-checkout\\datasets\\reports\\pdfs\\example.pdf"))) == "datasets/reports/pdfs/example.pdf"
    assert _one(spark, X.portable_key(F.lit("docs/a.pdf"))) == "docs/a.pdf" and _one(spark, X.portable_key(F.lit("/x/a.pdf"))) == "/x/a.pdf"
    assert _one(spark, X.relative_key(F.lit("/r/a/b.pdf"), "/r")) == "a/b.pdf"
    with pytest.raises(Exception, match="outside"):
        _one(spark, X.relative_key(F.lit("/q/b.pdf"), "/r"))
    name = "report_2018"
    assert _one(spark, X.name_uuid(str(uuid.NAMESPACE_URL), F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert _one(spark, X.safe_name(F.lit("a b/ç.pdf"))) == "a_b_ç.pdf" and _one(spark, X.preview(F.lit("a\nb" * 9), 5)) == "a\\nba... (27 chars)"


def test_json_cleaning(spark):
    parsed = lambda s: _one(spark, F.to_json(X.parsed_json(F.lit(s))))
    assert parsed('```json\n{"a": [1, 2,],}\n```') == '{"a":[1,2]}'
    assert parsed('// c\n{"a": "http://x"}') == '{"a":"http://x"}' and parsed('{"a": {"b": 1}') == '{"a":{"b":1}}' and parsed('{"a" 1}') is None
    assert tuple(_one(spark, X.verdict(F.lit('{"correct": true, "reasoning": "r"}')))) == (True, "r") and _one(spark, X.verdict(F.lit("That is FALSE")))["correct"] is False


def test_vectors(spark):
    assert _one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert _one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None and _one(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0)))) is None
    v = _one(spark, V.hash_embedding(F.lit("text")))
    assert len(v) == 64 and sum(x * x for x in v) == pytest.approx(1) and v[:32] == v[32:]


def test_bm25_equals_sqlite(spark):
    import sqlite3

    texts = ["Foo bar éducation", "foo foo baz", "ñandú bar bar", "nothing", "the foo_bar of bar foo", "bar foo"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, content, tokenize='unicode61')")
    con.executemany("insert into f values (?, ?)", list(enumerate(texts)))
    rows = spark.createDataFrame([(str(i), "p", i, t) for i, t in enumerate(texts)], "id string, source_path string, chunk_index int, content string")
    for query, match in (("foo", '"foo"'), ("foo bar foo", '"foo" OR "bar" OR "foo"'), ("foo_bar", '"foo_bar"'), ("education nandu", '"education" OR "nandu"')):
        want = {int(i): s for i, s in con.execute("select id, bm25(f) from f where f match ?", (match,))}
        got = {r["chunk_index"]: r["bm25"] for r in R.bm25_topk(rows, query).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want), query
    assert R.bm25_topk(rows, "!!").count() == 0
    best = R.bm25_topk(rows, "foo").first()
    assert best["score"] == pytest.approx(1 / (1 + abs(best["bm25"])))


def test_string_values(spark):
    said = lambda raw: _one(spark, X.string_value(F.parse_json(F.lit(raw))))
    for raw, want in {"1.0": "1.0", "-2.50": "-2.5", "0": "0", "1e7": "10000000.0", "1.5e300": "1.5e+300", "-1e-7": "-1e-07", "123456789012345678901": "123456789012345678901", "false": "False", '"a, b: c"': "a, b: c", '{"b": [1, "x,y"], "a": {"k": null}}': '{"a": {"k": null}, "b": [1, "x,y"]}', "[]": "[]"}.items():
        assert said(raw) == want, raw
    assert _one(spark, X.string_value(F.lit(None).cast("variant"))) == ""


def test_match_key_decomposes(spark):
    key = lambda s: _one(spark, X.match_key(F.lit(s)))
    assert key("  ﬁle_ＡＢ－Ά.Ё ") == "file ab α е" and key("Été--2020") == "ete 2020"
    assert _one(spark, X.match_key(F.lit(None).cast("string"))) is None


def test_folding_of_ascii_and_others(spark):
    rows = spark.createDataFrame([("Plain TEXT",), ("Été ÑANDÚ",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.folded(F.col("t"))).collect()] == ["plain text", "ete nandu", None]


def test_canonical_json_and_vectors(spark):
    assert _one(spark, X.canonical_json(F.lit('{"b": 1, "a": [1, 2]}'))) == '{"a":[1,2],"b":1}'
    with pytest.raises(Exception, match="invalid JSON"):
        _one(spark, X.canonical_json(F.lit("{")))
    assert _one(spark, V.serialised(F.array(F.lit(0.5), F.lit(-1.0)))) == "[0.5,-1.0]" and _one(spark, V.deserialised(F.lit("[0.5,1]"))) == [0.5, 1.0]
    assert _one(spark, V.deserialised(F.lit(""))) is None and _one(spark, V.normalised(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    identity = lambda path, own, content: _one(spark, X.chunk_identity(F.lit("k"), path, F.lit(1), F.lit("s"), F.lit("t"), own, content))
    none = F.lit(None).cast("string")
    assert identity(none, F.lit("own"), F.lit("c")) == "own" and len(identity(none, F.lit(""), F.lit("c"))) == 40 and identity(F.lit("p"), F.lit("own"), F.lit("c")) != "own"
