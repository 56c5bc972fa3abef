"""what claim_grounding reads of texts, and how often."""

import pytest
from pyspark.sql import functions as F

from matchspark.operators import grounding as G
from matchspark.operators import sections as X

FORMS = [("the of", 1), ("the", 2), (".net", 3), ("net", 4), ("node.js", 5), ("c++", 6), ("the, of", 7), (".", 8), (",.", 9), ("#", 10)]
TEXTS = ["the of, a.net .net ,.net ..net", "The\nof the, of. The-of node.js node.jsx", "c++ c+ the.of the . of\tthe,.the", "", None, "# a# the_the/ofé theé of"]


def test_texts_are_read_once(spark, tmp_path):
    """Texts are read once, each kind of claim is told from what was kept of them."""
    for name, text in (("said", "Worked at Acme in March for $2M."), ("known", "acme, march 2019")):
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/{name}")
    said, known = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("said", "known"))
    forms, openers = spark.createDataFrame(FORMS, "form string, skill_id int"), spark.createDataFrame([("worked",)], "word string")
    out = G.claim_grounding(said, known, "doc_id", "text", forms, openers=openers)
    assert "text:string" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.n_claims, r.n_fabricated, r.kinds) for r in out.collect()] == [(5, 2, "number,skill")]


def test_a_number_ends_with_its_line(spark):
    """As in SQL: a name hangs off a number that stands right before it, not off one that ends the line above."""
    docs = spark.createDataFrame([(1, "we had 9\nAcme and 9Bcme")], "doc_id long, text string")
    assert {r.value for r in G.claims(docs, "doc_id", "text").collect() if r.kind == "organization"} == {"Acme"}


@pytest.mark.parametrize("most", [200, 1])
def test_runs_tell_what_lines_do(spark, monkeypatch, most):
    """Runs of forms' pieces hold the mentions that whole lines hold; with more pieces than that lines are read."""
    monkeypatch.setattr(X, "SENT_PIECES", most)
    forms = spark.createDataFrame(FORMS, "form string, skill_id int")
    assert (X.form_runs(forms) is None) == (most == 1)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    lines = X.skill_spans(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")), forms)
    got = {(r.doc_id, r.value) for r in G.claims(docs, "doc_id", "text", forms).collect() if r.kind == "skill"}
    assert got == {(r.doc_id, str(r.skill_id)) for r in lines.collect()}
    assert len(got) > 10


def test_a_scale_ends_with_its_word(spark):
    """A letter of any alphabet goes on with the word, so that it is no scale."""
    docs = spark.createDataFrame([(1, "had 9 bé and 8 b")], "doc_id long, text string")
    assert {r.value for r in G.claims(docs, "doc_id", "text").collect()} == {"9.000000 ", "8000000000.000000 "}
