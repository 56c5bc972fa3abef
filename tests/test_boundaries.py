"""Boundary rows, longhand values and properties."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchspark.functions import posting as O
from matchspark.functions import scoring as S
from matchspark.functions import text as T
from matchspark.operators import demand as D
from matchspark.operators import evaluation as V
from matchspark.operators import grounding as G
from matchspark.operators import matching as M
from matchspark.operators import merges
from matchspark.operators import planning as N
from matchspark.operators import postings as P
from matchspark.operators import ranking as R
from matchspark.operators import sections as X
from matchspark.streaming.jobs import application_state_batch, fold_status


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("cosine", "score"), [(None, 0.5), (0.35, 0.0), (0.78, 1.0), (0.2, 0.0), (0.9, 1.0), (0.565, 0.5)])
def test_semantic(spark, cosine, score):
    value, status = S.semantic(F.lit(cosine).cast("double"))
    assert one(spark, value) == score
    assert one(spark, status) == ("NEEDS_DATA" if cosine is None else "SCORED")


@pytest.mark.parametrize(("years", "low", "high", "want"), [
    (3, None, None, (1.0, "NOT_STATED")), (None, 2, 4, (0.5, "NEEDS_PROFILE")), (1, 4, None, (0.25, "SCORED")), (0, 2, None, (0.0, "SCORED")),
    (20, 1, 5, (0.7, "SCORED")), (7, 1, 5, (0.9, "SCORED")), (3, 1, 5, (1.0, "SCORED")), (0, 0, 5, (1.0, "SCORED")),
])
def test_experience(spark, years, low, high, want):
    lit = lambda v: F.lit(v).cast("double")
    value, status = S.experience(lit(years), lit(low), lit(high))
    assert (one(spark, value), one(spark, status)) == want


@pytest.mark.parametrize(("have", "need", "want"), [(3, None, 1.0), (None, 3, 0.5), (3, 3, 1.0), (2, 3, 0.6), (1, 3, 0.2)])
def test_education(spark, have, need, want):
    assert one(spark, S.education(F.lit(have).cast("int"), F.lit(need).cast("int"))[0]) == want


def test_salary(spark):
    lit = lambda v, t="double": F.lit(v).cast(t)
    of = lambda low, high, cur, per, floor, fcur: tuple(one(spark, c) for c in S.salary(lit(low), lit(high), lit(cur, "string"), lit(per, "string"), lit(floor), lit(fcur, "string")))
    assert of(None, None, "USD", "YEARLY", 10, "USD") == (0.5, "NOT_STATED")
    assert of(10, 20, "USD", "YEARLY", None, "USD") == (0.5, "NEEDS_PROFILE")
    assert of(10, 20, "USD", "YEARLY", 10, "EUR") == (0.5, "NEEDS_DATA")
    assert of(10, 20, "USD", None, 10, "USD") == (0.5, "NEEDS_DATA")
    assert of(10, 20, "USD", "MONTHLY", 240, "USD") == (1.0, "SCORED")
    assert of(None, 30, "USD", "YEARLY", 120, "USD") == (0.25, "SCORED")


def test_location(spark):
    def of(places, remote, country, relocate, job_places, job_country, mode):
        arr = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
        return one(spark, S.location(arr(places), F.lit(remote), F.lit(country).cast("string"), F.lit(relocate), arr(job_places), F.lit(job_country).cast("string"), F.lit(mode).cast("string"))[0])

    assert of([], False, None, False, ["oslo"], "NO", None) == 0.5
    assert of([], True, None, False, [], None, "REMOTE") == 1.0
    assert of(["oslo"], False, "NO", False, [], None, None) == 0.5
    assert of(["oslo"], False, "NO", False, ["oslo"], "NO", None) == 1.0
    assert of(["oslo"], False, "NO", True, ["bergen"], "NO", None) == 0.7
    assert of(["oslo"], False, "NO", False, ["bergen"], "NO", None) == 0.3
    assert of(["oslo"], False, "NO", False, ["paris"], "FR", None) == 0.1


def _wide(spark, scores):
    row = {}
    for (n, _), s in zip(S.WEIGHTS.items(), scores, strict=True):
        row |= {n: s, f"{n}_status": "SCORED"}
    return spark.createDataFrame([row])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.25, 0.5, 0.75, 1.0]), min_size=6, max_size=6))
def test_contributions_sum_to_the_total(spark, scores):
    wide = _wide(spark, scores).select(S.breakdown().alias("b"), S.overall().alias("o"), S.scored_weight().alias("w")).first()
    assert math.isclose(sum(r.contribution for r in wide.b), wide.o, abs_tol=1e-9)
    assert wide.w == 1.0
    assert 0 <= wide.o <= 100


def test_all_ones_are_a_hundred(spark):
    assert _wide(spark, [1.0] * 6).select(S.overall()).first()[0] == 100.0


def test_text(spark):
    f = lambda col, v: one(spark, col(F.lit(v)))
    assert f(T.fold_text, "Ñandú S.A. / C++") == "nandu sa c++"
    assert f(T.fold_text, "Škoda Dvořák, Việt Ṩ ǖ") == "skoda dvorak viet s u"
    assert f(T.normalize_company, "Zeta Labs Private Limited") == "zeta labs"
    assert f(T.normalize_company, "Group") == "group"
    assert f(T.normalize_company, "Acme Technologies Pvt Ltd") == "acme technologies"
    assert f(T.normalize_title, "Sr. Software Engineer II (Remote)") == "software engineer"
    assert f(T.normalize_title, "Senior") == "senior"
    assert f(T.clean_text, "a​ b\r\n\r\n\r\n\r\n  c ") == "a b\n\nc"
    assert round(one(spark, T.trigram_similarity(F.lit("word"), F.lit("two words"))), 6) == 0.363636
    assert f(T.redact_contacts, "mail a.b@c.org or +49 12345 67890") == "mail [email] or [phone]"
    assert f(T.html_to_text, "<p>a&amp;b</p><script>x</script><div>c</div>") == "a&b\nc"
    assert f(T.tokenize, "The C++ and node.js") == ["c++", "node.js"]


def test_posting_fields(spark):
    f = lambda col, v: one(spark, col(F.lit(v)))
    assert f(O.work_mode, "hybrid, 3 days remote") == "HYBRID"
    assert f(O.employment_type, "full-time internship") == "INTERNSHIP"
    assert one(spark, O.experience_level(F.lit("Senior engineer"), F.lit("mentor junior people"))) == "SENIOR"
    assert tuple(f(O.experience_range, "3-5 years")) == (3, 5)
    assert tuple(f(O.experience_range, "at least 4 yrs")) == (4, None)
    assert f(O.experience_range, "5 years of growth") is None
    assert f(O.min_education, "Bachelor's required, Master's preferred") == "BACHELORS"
    assert tuple(f(O.salary_range, "pays $80-100k a year")) == (80000.0, 100000.0, "USD", "YEARLY")
    assert f(O.salary_range, "no pay named") is None
    assert tuple(f(O.salary_range, "80,000 - 90,000 EUR per year")) == (80000.0, 90000.0, "EUR", "YEARLY")
    assert tuple(f(O.salary_range, "60k-70k USD")) == (60000.0, 70000.0, "USD", None)
    assert tuple(f(O.salary_range, "$5 gift card. Salary $80,000 - $90,000"))[:3] == (80000.0, 90000.0, "USD")
    assert tuple(f(O.salary_range, "12 - 18 LPA")) == (1200000.0, 1800000.0, "INR", "YEARLY")
    assert f(O.salary_range, "$ for 10 to 20 members") is None
    assert one(spark, O.and_list(F.array(*map(F.lit, "abcdef")))) == "a, b, c, d and 2 more"
    assert one(spark, O.years_label(F.lit(None).cast("int"), F.lit(6))) == "up to 6 years"
    assert one(spark, O.labelled(F.lit("x\nCompany: Acme\n"), "Company", "Employer")) == "Acme"


def test_demand(spark):
    live = spark.createDataFrame([(1,), (2,)], "job_id long")
    wanted = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, 9)], "job_id long, skill_id long")
    skills = spark.createDataFrame([(7,), (8,), (9,)], "skill_id long")
    assert dict(D.skill_demand(live, wanted, skills).collect()) == {7: 1.0, 8: 0.5, 9: 0.0}
    assert dict(D.skill_demand(live.limit(0), wanted, skills).collect()) == {7: None, 8: None, 9: None}


def test_live_and_rates(spark):
    at = dt.datetime(2020, 1, 1)
    jobs = spark.createDataFrame([(1, "ACTIVE", None), (2, "ACTIVE", at), (3, "DUPLICATE", None)], "job_id long, status string, expires_at timestamp")
    assert [r.job_id for r in P.live_postings(jobs, F.lit("2020-01-01").cast("timestamp")).collect()] == [1]
    facts = spark.createDataFrame([(1, i, "A", None, "70+", 1, 0) for i in range(4)] + [(2, i, "a ", "X", "70+", int(i < 2), 0) for i in range(5)], "user_id long, job_id long, title string, location string, band string, interviewed int, offered int")
    overall = {r.user_id: r.interview_rate for r in D.funnel_report(facts).where("segment = 'overall'").collect()}
    assert overall == {1: None, 2: 0.4}
    assert D.funnel_report(facts).where("label = 'Not stated'").count() == 1


def test_pages_partition_the_ranking(spark):
    scored = spark.createDataFrame([(1, i, float(i // 3)) for i in range(20)], "u long, i long, s double")
    pages = [[r.i for r in R.rank_page(scored, "u", "s", "i", a, 7).orderBy("rank").collect()] for a in (1, 8, 15)]
    assert sorted(sum(pages, [])) == list(range(20))
    assert pages[0][:2] == [18, 19]


def test_nearest(spark):
    items = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(30)], "item long, embedding array<float>")
    anchors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "a long, embedding array<float>")
    got = M.top_k_similar(anchors, items, 3, "a", "item").where("a = 1").orderBy("place").collect()
    want = sorted(range(30), key=lambda i: (-round(math.cos(i), 6), i))[:3]
    assert [r.item for r in got] == want


def test_near_duplicates_plan_and_rows(spark):
    rows = [(1, 1, "data engineer", [1.0, 0.0]), (2, 1, "cook", [1.0, 0.01]), (3, 2, "data engineer ii", [1.0, 0.02]), (4, 3, "nurse", [1.0, 0.0]), (5, None, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "job_id long, company_id long, title string, embedding array<double>")
    pairs = M.near_duplicate_pairs(df, 0.97)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(1, 2), (1, 3)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("tile", [8192, 7])
def test_tiles_change_nothing(spark, monkeypatch, tile):
    """Nearest neighbours and near duplicates against brute force, with tiles smaller than a company; copies counted."""
    import random

    monkeypatch.setattr(M, "TILE", tile)
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    vectors[50:55] = [vectors[0]] * 5
    unit = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in vectors]
    cos = lambda a, b: sum(x * y for x, y in zip(unit[a], unit[b], strict=True))
    rows = [(i, 1 if i < 30 or 50 <= i < 53 else i % 3, None if i % 7 == 3 else ["data engineer", "data engineer ii", "cook"][i % 3 if i < 50 else 0], v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "job_id long, company_id long, title string, embedding array<double>")
    near = M.top_k_similar(df.where("job_id % 5 = 0").select(F.col("job_id").alias("a"), "embedding"), df, 4, "a", "job_id", floor=0.2, not_self=True)
    want = {(a, b): p for a in range(0, 60, 5) for p, b in enumerate(sorted((b for b in range(60) if b != a and cos(a, b) >= 0.2), key=lambda b, a=a: (-round(cos(a, b), 9), b))[:4], 1)}
    assert {(r.a, r.job_id): r.place for r in near.collect()} == want
    classes = {}
    for i, company, title, v in rows:
        classes.setdefault((company, title, tuple(v)), []).append(i)
    reps = {min(m): m for m in classes.values()}
    alike = one(spark, T.trigram_similarity(F.lit("data engineer"), F.lit("data engineer ii"))) >= 0.3
    similar = lambda s, t: s is not None and t is not None and (s == t or (alike and "cook" not in (s, t)))
    pairs = {(a, b) for a in reps for b in reps if a < b and cos(a, b) >= 0.6 and (rows[a][1] == rows[b][1] or similar(rows[a][2], rows[b][2]))}
    found = M.near_duplicate_pairs(df, 0.6)
    assert {(r.a, r.b) for r in found.collect()} == pairs
    links = {m: len(ms) - 1 + sum(len(reps[b if a == rep else a]) for a, b in pairs if rep in (a, b)) for rep, ms in reps.items() for m in ms}
    assert {r.job_id: r.n_links for r in M.near_duplicate_classes(df, found).collect()} == links


@pytest.mark.parametrize("tile", [8192, 3])
def test_near_duplicates_of_a_posting_with_copies(spark, monkeypatch, tile):
    """Against brute force over postings: copies are hits, those without company and title are not each other's."""
    monkeypatch.setattr(M, "TILE", tile)
    titles = ["data engineer", "data engineer ii", "cook", None, "--"]
    base = [(c, titles[t], v) for c in (1, 2, None) for t in range(5) for v in ([1.0, 0.0], [1.0, 0.1], [0.0, 0.0], None)]
    rows = [(i, *base[(i * i) % len(base)]) for i in range(150)]
    df = spark.createDataFrame(rows, "job_id long, company_id long, title string, embedding array<double>")

    def grams(t):
        words = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}

    def near(x, y):
        if not (x[3] and y[3] and any(x[3]) and any(y[3])):
            return None
        g, h = grams(x[2] or ""), grams(y[2] or "")
        if not ((x[1] is not None and x[1] == y[1]) or (g | h and len(g & h) / len(g | h) >= 0.3)):
            return None
        return sum(a * b for a, b in zip(x[3], y[3], strict=True)) / math.hypot(*x[3]) / math.hypot(*y[3])

    want = set()
    for x in rows:
        hits = sorted((-round(near(x, y), 9), y[0]) for y in rows if y[0] != x[0] and near(x, y) is not None and near(x, y) >= 0.97)
        want |= {(x[0], other, place) for place, (_, other) in enumerate(hits[:10], 1)}
    pairs = M.near_duplicate_pairs(df, 0.97).withColumn("cosine", F.round("cosine", 9))
    assert {(r.job_id, r.other_id, r.place) for r in M.near_duplicates_of(df, pairs).collect()} == want


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_similar_titles_meet_in_tiles(spark, monkeypatch, least):
    """No pair is lost by prefixes, lengths, places and bounds of tiles; a trigram that all titles share gives rows by
    tiles."""
    import random

    monkeypatch.setattr(M, "TILE", 20)
    rng = random.Random(5)
    titles = [" ".join(["engineer", *(rng.choice(["data", "ml", "lead", "cloud", "ops", "senior", "qa", "x"]) for _ in range(rng.randrange(6)))]) for _ in range(400)]
    titles = sorted(set(titles))
    df = spark.createDataFrame([(t,) for t in [*titles, None, "..."]], "title string")
    own, met = M.title_tiles(df, least)
    tile = {r.title: r.tile for r in own.collect()}
    at = {}
    for r in met.collect():
        at.setdefault(r.title, set()).add(r.tile)
    both = df.where("title is not null").select(F.col("title").alias("a")).join(df.select(F.col("title").alias("b")), F.col("a") < F.col("b"))
    alike = both.where(T.trigram_similarity(F.col("a"), F.col("b")) >= least).collect()
    assert len(alike) > 300
    assert all(tile[a] in at[b] or tile[b] in at[a] for a, b in alike)
    assert sum(map(len, at.values())) <= len(tile) * len(set(tile.values()))


def test_metrics_longhand(spark):
    df = spark.createDataFrame([("q", i, float(9 - i), label) for i, label in enumerate([3, 0, 2])], "q string, i long, s double, label int")
    ranked = V.ranked_labels(df, ["q"], "s", "i")
    assert V.precision_at_k(ranked, ["q"], 5).first()[1] is None
    assert math.isclose(V.precision_at_k(ranked, ["q"], 2).first()[1], 0.5)
    dcg = 7 / math.log2(2) + 3 / math.log2(4)
    assert math.isclose(V.ndcg_at_k(ranked, ["q"], 3, "i").first()[1], dcg / (7 / math.log2(2) + 3 / math.log2(3)))
    assert V.reciprocal_rank(ranked.where("label < 2"), ["q"]).first()[1] == 0.0
    assert V.ndcg_at_k(ranked.where("label = 0"), ["q"], 3, "i").first()[1] is None
    assert V.pearson(df.withColumn("c", F.lit(1.0)), ["q"], "s", "c").first()[1] is None
    empty = spark.createDataFrame([(1, "a")], "d long, x string")
    both = {r.d: (r.precision, r.recall) for r in V.set_prf(empty.limit(0), empty, "d", "x").collect()}
    assert both == {1: (0.0, 0.0)}


def test_sections_and_mentions(spark):
    docs = spark.createDataFrame([(1, "We use node.js\n## Requirements:\nC++ and machine learning\npython is a plus\nBenefits\npython"), (2, "python machine learning")], "doc_id long, text string")
    heads = spark.createDataFrame([("requirements", "REQUIREMENTS"), ("benefits", "BENEFITS")], "phrase string, section string")
    lines = X.section_lines(docs, heads)
    assert [(r.line_no, r.section) for r in lines.where("doc_id = 1").orderBy("line_no").collect()] == [(0, "ABOUT"), (2, "REQUIREMENTS"), (3, "REQUIREMENTS"), (5, "BENEFITS")]
    assert lines.where("doc_id = 2").first().section == "UNKNOWN"
    forms = spark.createDataFrame([("machine learning", 1), ("learning", 2), ("python", 3), ("c++", 4), ("node.js", 5)], "form string, skill_id int")
    spans = X.skill_spans(lines, forms)
    assert sorted((r.line_no, r.skill_id) for r in spans.where("doc_id = 1").collect()) == [(0, 5), (2, 1), (2, 4), (3, 3), (5, 3)]
    skills = {(r.doc_id, r.skill_id): (r.requirement, r.confidence) for r in X.job_skills(spans, lines).collect()}
    assert skills[1, 3] == ("PREFERRED", 0.98)
    assert skills[1, 4] == ("REQUIRED", 0.95)
    assert skills[2, 1] == ("REQUIRED", 0.6)


def test_longer_forms_claim_first(spark):
    """Longest first, leftmost among equals, whatever falls; forms of any number of words; general words held down."""
    lines = spark.createDataFrame([(1, 0, "alpha beta gamma delta", "ABOUT"), (1, 1, "a b c d", "ABOUT"), (1, 2, "one two three four, machine_learning React, Native react native", "REQUIREMENTS"), (1, 3, "3+ years of delta", "REQUIREMENTS")], "doc_id int, line_no int, line string, section string")
    forms = spark.createDataFrame([("alpha beta gamma", 1), ("gamma delta", 2), ("delta", 3), ("a b", 4), ("b c", 5), ("c d", 6), ("one two three four", 7), ("Machine Learning", 8), ("react native", 9)], "form string, skill_id int")
    spans = X.skill_spans(lines, forms)
    assert sorted((r.line_no, r.first, r.skill_id) for r in spans.collect()) == [(0, 1, 1), (0, 4, 3), (1, 1, 4), (1, 3, 6), (2, 1, 7), (2, 6, 8), (2, 11, 9), (3, 4, 3)]
    generic = spark.createDataFrame([(1,), (3,)], "skill_id int")
    skills = {r.skill_id: r for r in X.job_skills(spans, lines, generic=generic).collect()}
    assert 1 not in skills
    assert (skills[3].requirement, skills[3].min_years, skills[3].section, skills[3].confidence) == ("REQUIRED", 3, "REQUIREMENTS", 0.98)
    held = {r.skill_id: (r.confidence, r.needs_review) for r in G.resume_skills(spans, lines.withColumn("section", F.when(F.col("line_no") < 2, "EDUCATION").otherwise("SKILLS")), "doc_id", generic).collect()}
    assert held[1] == (0.5, True)
    assert held[4] == (0.6, False)
    assert held[3] == (0.98, False)


@pytest.mark.parametrize(("suggested", "kinds"), [
    ("Delivered the backend for Acme", ""), ("Worked at Stripe", "organization"), ("Led 5 projects", ""), ("Led five projects", ""), ("Led 5% of projects", "number"),
    ("Saved $2M", ""), ("Saved $2 million", ""), ("Saved 2M", "number"), ("in March 2019", "date,organization"), ("since 2019 in May", ""), ("PMP at Acme", "credential"),
    ("Acme's systems", ""), ("Used Python daily", ""), ("used rust daily", "skill"), ("United led the work.", "organization"), ("Allied was my employer.", "organization"),
    ("Reed hired me.", "organization"), ("So it was. Delivered the backend", ""), ("Forecast for Acme", ""), ("LED BY ACME", "organization"), ("Led \uff15 projects", ""), ("Saved $\uff12M for A\uff43me", ""),
    ("Led 7\u00a0projects", "number"), ("o\ufb03ce of A\u0063me", ""),
])
def test_claims(spark, suggested, kinds):
    source = "At Acme I led 5 projects with Python since 2019, in may, and saved $2,000,000"
    forms = spark.createDataFrame([("python", 1), ("rust", 2)], "form string, skill_id int")
    of = lambda t: spark.createDataFrame([(1, t)], "doc_id int, text string")
    openers = spark.createDataFrame([(w,) for w in ("delivered", "worked", "led", "saved", "used", "forecast", "so", "in")], "word string")
    row = G.claim_grounding(of(suggested), of(source), "doc_id", "text", forms, openers=openers).first()
    assert (row.kinds, row.passed) == (kinds, not kinds)


def test_openers_come_from_a_table(spark):
    of = lambda t: spark.createDataFrame([(1, t)], "doc_id int, text string")
    made = lambda openers: {r.value for r in G.claims(of("Built it. Built Acme\nGood"), "doc_id", "text", openers=openers).collect()}
    assert made(None) == {"Built", "Acme", "Good"}
    corpus = spark.createDataFrame([(1, "we built it, built"), (2, "Built and built well"), (3, "good x1 one")], "doc_id int, text string")
    words = G.ordinary_words(corpus, "doc_id", "text")
    assert {r.word for r in words.collect()} == {"built"}
    assert made(words) == {"Acme", "Good"}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert dict(merges.keyed_merge(old, new, ["k"]).collect()) == {1: "a", 2: "c", 3: "d"}
    assert dict(merges.keyed_merge(old, new, ["k"], guard=F.col("v") == "b").collect()) == {1: "a", 2: "b", 3: "d"}
    batch = spark.createDataFrame([(None, 1), (None, 2), ("x", 3), ("x", 4), ("y", 5)], "e string, o long")
    assert sorted(r.o for r in merges.dedupe_on_external_id(batch, spark.createDataFrame([("y",)], "e string"), ["e"], "o").collect()) == [1, 2, 3]


def test_plan_respects_prerequisites_and_survives_cycles(spark):
    gaps = spark.createDataFrame([(1, 1, "LOW", 0.1), (1, 2, "CRITICAL", 0.9), (1, 3, "HIGH", 0.5), (2, 4, "LOW", 0.1), (2, 5, "HIGH", 0.2)], "user_id long, skill_id long, severity string, frequency double")
    needs = spark.createDataFrame([(2, 1), (4, 5), (5, 4)], "skill_id long, needs long")
    got = {u: [r.skill_id for r in N.learning_plan(gaps, needs).where(F.col("user_id") == u).orderBy("step").collect()] for u in (1, 2)}
    assert got == {1: [3, 1, 2], 2: [5, 4]}
    hours = spark.createDataFrame([(1, 10.0), (2, 4.0), (4, 3.0)], "skill_id long, hours double")
    done = spark.createDataFrame([(1, 1), (9, 9)], "user_id long, skill_id long")
    plan = N.learning_plan(gaps, needs, hours, done)
    assert [tuple(r) for r in plan.orderBy("user_id", "step").collect()] == [(1, 1, 1, True, 10.0, []), (1, 2, 2, False, 4.0, [1]), (2, 4, 1, False, 3.0, [])]
    assert sorted(map(tuple, N.plan_totals(gaps, plan).collect())) == [(1, 2, 14.0, 4.0, 1), (2, 1, 3.0, 3.0, 1)]
    # a finished step frees what needs it at once; the finished one stands first all the same
    both = spark.createDataFrame([(1, 1, "LOW", 0.1), (1, 2, "CRITICAL", 0.9)], "user_id long, skill_id long, severity string, frequency double")
    freed = N.learning_plan(both, needs, None, done)
    assert [(r.skill_id, r.completed, r.after) for r in freed.orderBy("step").collect()] == [(1, True, []), (2, False, [1])]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from(["SAVED", "APPLIED", "INTERVIEW", "REJECTED"]), min_size=1, max_size=12))
def test_application_fold(spark, moves):
    df = spark.createDataFrame([(1, 1, i, i, m) for i, m in enumerate(moves)], "user_id long, job_id long, occurred_at long, event_id long, to_status string")
    status, ok, saved = None, 0, False
    for m in moves:
        status, fine = fold_status(status, m, saved)
        saved |= fine and m == "SAVED"
        ok += fine
    row = application_state_batch(df).first()
    assert (row.status, row.moves, row.refused) == (status, ok, len(moves) - ok)


def test_a_busy_customer_has_25_career_entries_of_a_kind(spark, tmp_path):
    from matchspark.plans.resumes import career_entities

    orders = [(4 * k, 1 if k < 40 else 2, dt.date(1992 + k // 12, k % 12 + 1, 1), 1.0) for k in range(43)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    assert {r.user_id: r["count"] for r in career_entities(spark, str(tmp_path)).groupBy("user_id").count().collect()} == {1: 25, 2: 3}


def test_scored_replies(spark):
    answer = "I would  shard the table, then measure."
    good = '{"scores": {"a": 0.5, "b": 1}, "feedback": " ok ", "strengths": ["x", " ", "y"], "cited_spans": ['
    spans = '{"start": 8, "end": 24, "text": " shard the\\n table", "note": "n"}, {"start": 9, "end": 23, "text": "shard the table"}, {"start": 2, "end": 99}, {"start": 5, "end": 5}, {"start": 0, "end": 7, "text": " "}]}'
    rows = [(1, good + spans), (2, "```json\n" + good + "]}\n```"), (3, good.replace("0.5", "1.5") + "]}"), (4, good.replace(" ok ", " ") + "]}"), (5, "[1]"), (6, None), (7, good.replace('"b": 1', '"c": 1') + "]}")]
    df = spark.createDataFrame(rows, "k int, reply string").withColumn("answer", F.lit(answer))
    got = {r.k: r for r in G.scored_reply(df, "k", "reply", "answer", ("a", "b")).collect()}
    assert {k: r.rejected for k, r in got.items()} == {1: None, 2: None, 3: "no mark for a", 4: "no feedback", 5: "no scores", 6: "no reply", 7: "no mark for b"}
    assert (got[1].a, got[1].overall, got[1].feedback, got[1].strengths, got[1].improvements) == (0.5, 0.75, "ok", ["x", "y"], [])
    assert [(s.start, s.end, s.text, s.note) for s in got[1].spans] == [(8, 24, answer[8:24], "n"), (0, 7, "I would", "")]
    assert (got[2].spans, got[3].overall, got[3].spans) == ([], None, None)


def test_what_a_match_lacks(spark):
    """Without requirements a posting needs data, without skills a candidate needs a profile; both count as neutral."""
    pairs = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, None)], "user_id long, job_id long, similarity double")
    people = spark.createDataFrame([(1, 3, 3, True, True, "X", None, None), (2, None, 3, True, True, "X", None, None)], "user_id long, years int, education_rank int, wants_remote boolean, will_relocate boolean, home string, floor double, floor_currency string")
    jobs = spark.createDataFrame([(k, 2, 4, "NONE", "X", "REMOTE", None, None, None) for k in (1, 2)], "job_id long, min_years int, max_years int, min_education string, country_code string, work_mode string, salary_max double, salary_currency string, salary_period string")
    asked = spark.createDataFrame([(1, 7, "REQUIRED"), (1, 8, "PREFERRED"), (9, 7, "REQUIRED")], "job_id long, skill_id long, requirement string")
    held = spark.createDataFrame([(1, 7)], "user_id long, skill_id long")
    skills = spark.createDataFrame([(7, "b", None), (8, "a", None)], "skill_id long, name string, parent_skill_id long")
    demand = spark.createDataFrame([(7, 0.5), (8, 0.5)], "skill_id long, demand_score double")
    got = {(r.user_id, r.job_id): r for r in M.match(pairs, people, jobs, asked, held, skills, demand, (0.0, 1.0), F.lit("2024-01-01").cast("timestamp")).collect()}
    assert {k: r.skill_status for k, r in got.items()} == {(1, 1): "SCORED", (1, 2): "NEEDS_DATA", (2, 1): "NEEDS_PROFILE"}
    assert (round(got[1, 1].skill, 4), got[1, 2].skill, got[2, 1].skill) == (0.6667, 0.5, 0.5)
    assert (got[1, 1].matched, got[1, 1].missing, got[2, 1].missing) == (["b"], ["a"], ["b", "a"])
    assert round(got[1, 1].scored_weight - got[1, 2].scored_weight, 2) == 0.25
    assert (got[2, 1].semantic_status, got[2, 1].ranking_version, got[2, 1].computed_at) == ("NEEDS_DATA", M.RANKING_VERSION, dt.datetime(2024, 1, 1))
    page = M.recommend(spark.createDataFrame([(1, k, float(k % 3), 1.0) for k in range(6)], "user_id long, job_id long, overall double, scored_weight double"), pairs.select("user_id", "job_id"), 2, 2)
    assert [(r.job_id, r["rank"], r.total) for r in page.orderBy("rank").collect()] == [(4, 2, 4), (0, 3, 4)]


def test_a_quotation_grounds_its_own_suggestion(spark):
    """The original begins within a word, "ten" in "often": keeping it claims nothing, a ten of one's own is rejected."""
    source = spark.createDataFrame([(1, "Often asked of us")], "doc_id long, text string")
    rows = [(1, 0, "ten asked", "ten asked"), (1, 1, "ten asked", "ten asked, twice or two"), (1, 2, "asked of", "asked ten of")]
    found = G.anchor_suggestions(spark.createDataFrame(rows, "doc_id long, place int, original string, suggested string"), source, "doc_id")
    assert {r.place: (r.outcome, r.position) for r in found.collect()} == {0: ("kept", 1), 1: ("rejected", None), 2: ("rejected", None)}


@pytest.mark.parametrize("sent", [0, 1, 2_000])
def test_only_runs_that_begin_like_a_form_are_made(spark, monkeypatch, sent):
    monkeypatch.setattr(X, "SENT_STARTS", sent)
    lines = spark.createDataFrame([(1, 0, "node.js and go, go lang of c++ and node"), (1, 1, ""), (2, 0, "lang go lang")], "doc_id long, line_no int, line string")
    forms = spark.createDataFrame([("go", 1), ("go lang", 2), ("C++", 3), ("node.js", 4), ("of c++ and node", 5)], "form string, skill_id int")
    spans = X.skill_spans(lines, forms)
    got = sorted((r.doc_id, r.line_no, r.first, r.last, r.skill_id) for r in spans.collect())
    assert got == [(1, 0, 1, 1, 4), (1, 0, 3, 3, 1), (1, 0, 5, 6, 2), (1, 0, 7, 10, 5), (2, 0, 2, 3, 2)]
    asked = " IN (" in spans._jdf.queryExecution().analyzed().toString().upper()
    assert asked == (sent == 2_000)


def test_plans_of_many_users_take_no_call_each(spark):
    gaps = spark.createDataFrame([(u, k, "HIGH" if k % 2 else "LOW", k % 3) for u in range(40) for k in range(u % 7)], "user_id long, skill_id long, severity string, frequency int")
    needs = spark.createDataFrame([(1, 2), (2, 4), (3, 3), (5, 0), (0, 5)], "skill_id long, needs long")
    done = gaps.where("skill_id = 4 and user_id % 2 = 0").select("user_id", "skill_id")
    plan = N.learning_plan(gaps, needs, None, done)
    assert "FlatMapGroups" not in plan._jdf.queryExecution().analyzed().toString()
    before = {1: {2}, 2: {4}, 3: {3}, 5: {0}, 0: {5}}
    want = {}
    for u in range(40):
        own = list(range(u % 7))
        over = {4} & set(own) if u % 2 == 0 else set()
        order = []
        while len(order) < len(own):
            left = [k for k in own if k not in order]
            order.append(min([k for k in left if before.get(k, set()) & set(own) <= over | set(order)] or left, key=lambda k: (k % 2 == 0, -(k % 3), k)))
        order.sort(key=lambda k: k not in over)
        want |= {(u, k): i for i, k in enumerate(order, 1)}
    assert {(r.user_id, r.skill_id): r.step for r in plan.collect()} == want
