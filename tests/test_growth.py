"""What a query moves grows with its input: each of these failed before its finding was settled."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from matchspark import registry
from matchspark.operators import evaluation as V
from matchspark.operators import grounding as G
from matchspark.operators import matching as N
from matchspark.operators import merges as M
from matchspark.operators import planning as P
from matchspark.operators import sections as X
from matchspark.session import parts_for, written


def test_a_source_travels_as_one_row(spark):
    """a source's words are one value, not a row each, and repeats of a text's words are not in it."""
    docs = spark.createDataFrame([(1, "ten words of ten words in March 1999"), (2, None), (3, "")], "doc_id long, text string")
    known = {r.doc_id: r._known for r in G.grounds(docs, "doc_id", "text").collect()}
    assert len(known) == 3
    assert sorted(known[1].split("\n")) == ["d1999", "dmarch", "n10.000000 ", "n1999.000000 ", "w1999", "win", "wmarch", "wof", "wten", "wwords"]


def test_claims_meet_sources_of_any_kind(spark):
    """a number grounds no name, a source that is told twice grounds by either row, and no source grounds nothing."""
    said = spark.createDataFrame([(1, "x Acme 12"), (2, "x Acme 12"), (3, "x Acme")], "doc_id long, text string")
    sources = spark.createDataFrame([(1, "acme"), (1, "12"), (2, "in acme12")], "doc_id long, text string")
    rows = {(r.doc_id, r.value): r.fabricated for r in G.fabricated(said, sources, "doc_id", "text").collect()}
    assert rows == {(1, "Acme"): False, (1, "12.000000 "): False, (2, "Acme"): True, (2, "12.000000 "): False, (3, "Acme"): True}


def test_few_forms_are_sent_to_the_runs(spark):
    """with few forms no run of pieces is shuffled to meet them."""
    lines = spark.createDataFrame([(1, 0, "of the work")], "doc_id long, line_no int, line string")
    found = X.skill_spans(lines, spark.createDataFrame([("the work", 7)], "form string, skill_id int"))
    assert [(r.first, r.last, r.skill_id) for r in found.collect()] == [(2, 3, 7)]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().sparkPlan().toString()


def test_contacts_are_worked_out_once(spark):
    """each pattern is looked for once in a text, whatever number of fields reads what it found."""
    text = "MARY O'NEIL\nOslo, Norway | +47 912 34 567 | mary@x.org\nLinkedIn.com/in/mary-o\ngithub.com/mary jan.dev/work\n"
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(G.contact_fields(F.col("text")).alias("c"))
    assert tuple(df.collect()[0].c) == ("Mary O'neil", "mary@x.org", "+47 912 34 567", "Oslo, Norway", "https://www.linkedin.com/in/mary-o", "https://github.com/mary", "https://jan.dev/work")
    assert not any(any(r.c or ()) for r in df.collect()[1:])
    assert df._jdf.queryExecution().analyzed().toString().count(G.GITHUB) == 2


def test_runs_carry_no_text(spark):
    """what meets the rules are runs that begin like one, with a sentence's first 240 characters and no more."""
    long = "z" * 500 + " of the work"
    rules = spark.createDataFrame([("of the", "c", 0.9), ("nothing like it", "d", 0.5)], "word string, skill string, confidence double")
    found = spark.createDataFrame([], "doc_id long, skill string")
    out = G.infer_skills(spark.createDataFrame([(1, long), (1, "a " + long)], "doc_id long, sentence string"), rules, found, "doc_id")
    assert [tuple(r) for r in out.collect()] == [(1, "c", 0.55, "a " + "z" * 238)]
    assert "BroadcastHashJoin [word" in out._jdf.queryExecution().sparkPlan().toString()


def test_replacing_a_set_needs_no_join(spark):
    """old and new are dealt and sorted together; repeats of new go, those of old and rows without a job stay."""
    schema = "job_id long, skill_id long, version int"
    old = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (None, 1, 0)], schema)
    new = spark.createDataFrame([(1, 2, 1), (1, 2, 1), (3, None, 1), (3, None, 1), (None, 2, 1)], schema)
    out = M.replace_job_skills(old, new)
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows == sorted([(1, 2, 1), (2, 1, 0), (2, 1, 0), (3, None, 1), (None, 1, 0), (None, 2, 1)], key=str)
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()


def test_sets_are_compared_without_a_join(spark):
    """F16: one sum by item; null is like no other item."""
    schema = "job_id long, skill_id long"
    predicted = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, None), (4, 1)], schema)
    gold = spark.createDataFrame([(1, 1), (1, 3), (2, None), (3, 1)], schema)
    out = V.set_prf(predicted, gold, "job_id", "skill_id")
    assert sorted((r.job_id, r.hits, r.precision, r.recall, r.f1) for r in out.collect()) == [(1, 1, 0.5, 0.5, 0.5), (2, 0, 0.0, 0.0, 0.0), (3, 0, 0.0, 0.0, 0.0), (4, 0, 0.0, 1.0, 0.0)]
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()


def test_near_pairs_leave_their_tile_once(spark):
    """F8, F18, F22: a pair of one company and of similar titles is one row, and what is said of a pair comes with it."""
    rows = [(1, 1, "data engineer", [1.0, 0.0]), (2, 1, "data engineer", [1.0, 0.01]), (3, 1, "cook", [1.0, 0.0]), (4, 2, "data engineer", [1.0, 0.0]), (5, 2, "data engineer", [1.0, 0.0]), (6, 2, "data engineer", [0.0, 1.0])]
    pairs = N.near_duplicate_pairs(spark.createDataFrame(rows, "job_id long, company_id long, title string, embedding array<double>"))
    said = [(r.a, r.b, r.shares_company, r.similar_title, r.n_a, r.n_b) for r in pairs.collect()]
    assert sorted(said) == [(1, 2, True, True, 1, 1), (1, 3, True, False, 1, 1), (1, 4, False, True, 1, 2), (2, 3, True, False, 1, 1), (2, 4, False, True, 1, 2)]
    assert pairs._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_pairs_are_made_once_for_both_sides(spark):
    """F8, F18: classes and hits read the tiles' output once, not once for each side of a pair."""
    df = spark.createDataFrame([(1, 1, "a", [1.0, 0.0]), (2, 1, "b", [1.0, 0.0])], "job_id long, company_id long, title string, embedding array<double>")
    pairs = N.near_duplicate_pairs(df)
    for out in (N.near_duplicate_classes(df, pairs), N.near_duplicates_of(df, pairs)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("CoGroup") == pairs._jdf.queryExecution().optimizedPlan().toString().count("CoGroup")


def test_depths_are_found_without_broadcasts(spark, monkeypatch):
    """no round sends what it found through the driver; repeats, nulls and cycles as ever."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return written(df)

    monkeypatch.setattr(P, "written", seen)
    edges = [(2, 1), (2, 1), (3, 2), (3, 1), (4, 5), (5, 4), (6, 5), (6, 1), (None, 1), (7, None), (8, 8)]
    out = P.prerequisite_depth(spark.createDataFrame(edges, "skill_id long, needs long"))
    assert {r.skill_id: r.depth for r in out.collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None, 8: None}
    assert plans and not any("Broadcast" in p for p in plans)


def shuffled(df):
    """What each shuffle of a plan deals by, and into how many parts."""
    return re.findall(r"Exchange hashpartitioning\((.*), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())


def test_topics_are_dealt_into_parts_that_grow(spark, sf, monkeypatch):
    """with ten times the parts of the session every shuffle is into so many, and the rows are the same."""
    from matchspark.plans import market

    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(market.weighted_topics(spark, sf))
    monkeypatch.setattr(market, "parts_for", lambda df, each: 40)
    df = market.weighted_topics(spark, sf)
    assert {n for _, n in shuffled(df)} == {"40"}
    assert rows(df) == want


def test_entries_stay_with_their_doc(spark, sf, monkeypatch):
    """lines are dealt by doc once, into parts that grow, and nothing is shuffled after."""
    from matchspark.plans import resumes

    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(resumes.career_entities(spark, sf))
    monkeypatch.setattr(resumes, "parts_for", lambda df, each: 40)
    df = resumes.career_entities(spark, sf)
    dealt = shuffled(df)
    assert dealt and all(n == "40" and by.startswith("user_id") and "," not in by for by, n in dealt)
    assert rows(df) == want


def test_parts_follow_the_rows(spark):
    """a part holds about so many rows at most, and there are never fewer parts than the session has."""
    had = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_for(spark.range(1000), 10) == 100 and parts_for(spark.range(1001), 10) == 101 and parts_for(spark.range(5), 10) == had


@pytest.mark.parametrize("small", [False, True])
def test_tfidf_of_odd_ids_equals_sql(spark, sf, tmp_path, monkeypatch, small):
    """texts without an id, ids that are repeated, ties and texts without tokens, in one block and in many, with
    all tokens sent to the docs and with few."""
    if small:
        from matchspark.operators import lexical as L

        for name, n in (("SENT_TOKENS", 3), ("BLOCK_QUERIES", 2), ("BLOCK_TERMS", 4), ("_PRODUCTS", 5), ("_DOCS", 2), ("PART_TEXTS", 3), ("_BATCH_TOKENS", 2)):
            monkeypatch.setattr(L, name, n)
    docs = [(i, "spark sql spark data" if i % 2 else f"Data of w{i} w{i} c++") for i in range(30)]
    docs += [(3, "sql more"), (3, None), (None, "spark rust"), (None, "rust only"), (40, None), (41, "the of"), (42, ""), (43, "K\u00e9 \u212aey \u0130x"), (44, "data " * 500)]
    asked = [(1, "Spark data"), (2, "rust c++"), (2, "c++ w4"), (None, "spark sql"), (4, "nowhere"), (5, None), (6, "the"), (7, "key x ix k"), (8, "data w6 w8 the data")]
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", asked, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        mine = tmp_path / p.name
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{f'{mine}/*.parquet' if mine.exists() else p}'")
    want = con.execute(registry.oracle_sql()["tfidf_rank"]).fetchall()
    got = registry.queries()["tfidf_rank"](spark, str(tmp_path)).select("item_id", "doc_id", "score", "rank").collect()
    assert {r[0] for r in want} == {1, 2, 7, 8}
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_tfidf_of_empty_tables(spark):
    """no queries, no docs or neither: no answers."""
    from matchspark.operators import lexical as L

    df = spark.createDataFrame([(1, "a few words")], "id long, text string")
    for docs, asked in ((df, df.limit(0)), (df.limit(0), df), (df.limit(0), df.limit(0))):
        assert L.tfidf_rank(asked.withColumnRenamed("id", "item_id"), docs.withColumnRenamed("id", "doc_id"), "item_id", "doc_id").collect() == []


def test_tfidf_reads_docs_once_and_moves_no_pairs(spark, sf, monkeypatch):
    """texts are counted in one scan, and where pairs are scored nothing is shuffled but the best of each query."""
    from matchspark.operators import lexical as L

    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(L, "written", seen)
    registry.queries()["tfidf_rank"](spark, sf).collect()
    assert sum(p.count("documents.parquet") for p in plans) == 1
    assert [what for what, _ in re.findall(r"Exchange hashpartitioning\((\w+)#.*, (\d+)\)", plans[-1])] == ["item_id"]
    assert "Generate" not in plans[-1] and "WindowGroupLimit" in plans[-1]
