"""Streams drained over several batches give what their batch forms give; batches that run twice change nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchspark.operators import demand as D
from matchspark.operators import planning as N
from matchspark.streaming import jobs as J
from matchspark.streaming.tables import Kept


def in_files(spark, folder, df, parts):
    """df in files of one batch each, in the order of parts; gives the stream of them."""
    for k, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(str(folder))
        newest = max(folder.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        import os

        os.utime(newest, (1_000_000_000 + k, 1_000_000_000 + k))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


THIRDS = ["n < 4", "n >= 4 and n < 9", "n >= 9"]


@pytest.fixture(scope="module")
def deliveries(spark):
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    long = "word " * 60
    rows = [
        (1, 10, "a", "x1", "h1", at(1), "https://e.org/1", long, "Engineer", "Acme"),
        (2, 11, "a", "x1", "h2", at(2), "https://e.org/2", long, "Engineer", "Acme"),  # delivered again
        (3, 12, "a", "x2", "h1", at(3), "https://e.org/3", long, "Engineer", "Acme"),  # the content of 10
        (4, 13, "b", "x1", "h4", at(4), "nowhere", long, "Engineer", "Acme"),
        (5, 14, "b", "x1", "h4", at(5), "https://e.org/5", long, "Engineer", None),  # 13 was not admitted
        (6, 15, "a", "x1", "h6", at(6), "https://e.org/6", long, "Engineer", "Acme"),  # again, in another batch
        (7, 16, None, "x9", "h7", at(7), "https://e.org/7", long, "Engineer", "Acme"),
        (8, 17, None, "x9", "h8", at(8), "https://e.org/8", long, "Engineer", "Acme"),  # null keys are never equal
        (9, 18, "c", "x3", "old", at(9), "https://e.org/9", long, "Engineer", "Acme"),  # the corpus has the content
        (10, 19, "c", "seen", "h10", at(10), "https://e.org/10", long, "Engineer", "Acme"),  # the corpus has the delivery
        (11, 20, "c", "x4", "h11", at(11), "https://e.org/11", "short", "Engineer", "Acme"),
        (12, 21, "c", "x5", None, at(12), "https://e.org/12", long, " ", "Acme"),
        (13, 22, "a", "x2", "h13", at(13), "https://e.org/13", long, "Engineer", "Acme"),  # 12 was a duplicate: the delivery is new
    ]
    df = spark.createDataFrame(rows, "n int, job_id long, source string, external_id string, content_hash string, arrived_at timestamp, link string, text string, title string, company string")
    corpus = spark.createDataFrame([(1, "c", "seen", "old", at(0))], "job_id long, source string, external_id string, content_hash string, arrived_at timestamp")
    return df, corpus


def told(rows):
    return {r.job_id: (r.outcome, r.reject_reason, r.canonical_job_id) for r in rows.collect()}


def test_ingest_over_batches(spark, tmp_path, deliveries):
    df, corpus = deliveries
    stream = in_files(spark, tmp_path, df, THIRDS)
    kept = J.stream_ingest(stream, corpus)
    got = told(kept.before())
    assert got == {
        10: ("CREATED", None, None), 11: ("DUPLICATE", None, 10), 12: ("DUPLICATE", None, 10), 13: ("FAILED", "no usable link", None), 14: ("CREATED", None, None),
        15: ("DUPLICATE", None, 10), 16: ("CREATED", None, None), 17: ("CREATED", None, None), 18: ("DUPLICATE", None, 1), 19: ("DUPLICATE", None, 1),
        20: ("FAILED", "description too short", None), 21: ("FAILED", "no title", None), 22: ("CREATED", None, None),
    }
    assert kept.before().select("batch").distinct().count() == 3
    # the last batch runs once more, as after a failure: it reads what came before it and replaces its own rows
    again = J.ingest_batch(df.where(THIRDS[2]), corpus.unionByName(kept.before(2).where("outcome = 'CREATED'").select(*J.INGESTED)))
    assert told(again) == {k: got[k] for k in range(18, 23)}
    kept.write(again, 2)
    assert told(kept.before()) == got


def test_ingest_as_one_batch(deliveries):
    """Batch form and stream differ only where a delivery and its content meet in one batch: 22 repeats 12 there."""
    df, corpus = deliveries
    got = told(J.ingest_batch(df, corpus))
    assert got[22] == ("DUPLICATE", None, 12)
    assert [k for k, v in got.items() if v[0] == "CREATED"] == [10, 14, 16, 17] or {k for k, v in got.items() if v[0] == "CREATED"} == {10, 14, 16, 17}
    assert told(J.ingest_batch(df, None))[18][0] == "CREATED"


def test_kept_tables(spark):
    kept = Kept(spark, "kept")
    assert kept.before() is None
    assert kept.latest() is None
    for n, v in ((0, "a"), (1, "b"), (1, "c"), (12, "d")):
        kept.write(spark.createDataFrame([(v,)], "v string"), n)
    assert {r.v for r in kept.before().collect()} == {"a", "c", "d"}
    assert {r.v for r in kept.before(12).collect()} == {"a", "c"}
    assert [r.v for r in kept.latest().collect()] == ["d"]
    assert [r.v for r in kept.latest(12).collect()] == ["c"]


@pytest.fixture(scope="module")
def docs(spark):
    text = "a text that is long enough to be worth a vector, says the rule of eighty characters, and more"
    return spark.createDataFrame([(n, n % 7, f"{text} {n % 5}" if n != 3 else "short") for n in range(12)], "n int, doc_id long, text string")


@pytest.fixture(scope="module")
def counting_encoder():
    def make():
        return lambda texts: [[len(t), t.count("a")] for t in texts]

    return make


def test_index_over_batches(spark, tmp_path, docs, counting_encoder):
    kept = J.stream_index(in_files(spark, tmp_path, docs, THIRDS).drop("n"), None, counting_encoder, "count", 2, "doc_id")
    got = {r.doc_id: r for r in J.indexed_now(kept, "doc_id").collect()}
    last = {}
    for r in docs.orderBy("n").collect():
        if r.n != 3:
            last[r.doc_id] = r.text
    assert {k: (r.model, r.dimensions, r.embedding) for k, r in got.items()} == {k: ("count", 2, [float(len(t)), float(t.count("a"))]) for k, t in last.items()}
    # what is indexed with its hash is not encoded again, and another model's rows do not count
    done = J.indexed_now(kept, "doc_id")
    latest = docs.where("n >= 7 or n in (5, 6)").drop("n")
    assert J.index_batch(latest.join(done.select("doc_id"), "doc_id"), done, counting_encoder, "count", 2, "doc_id").count() == 0
    assert J.index_batch(latest, done, counting_encoder, "other", 2, "doc_id").count() == latest.count()


def test_a_wrong_dimension_ends_the_query(spark, tmp_path, docs, counting_encoder):
    with pytest.raises(Exception, match="index of 3"):
        J.stream_index(in_files(spark, tmp_path, docs, THIRDS).drop("n"), None, counting_encoder, "wide", 3, "doc_id")


def test_application_state_over_batches(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    moves = ["SAVED", "APPLIED", "APPLIED", "SAVED", "INTERVIEW", "REJECTED", "OFFER", "APPLIED", "WITHDRAWN", "SAVED", "APPLIED", "OFFER"]
    rows = [(n, n, 1, 1, m, at(n)) for n, m in enumerate(moves)] + [(n, 100 + n, 2, 1, m, at(n)) for n, m in ((1, "APPLIED"), (5, "SAVED"), (9, "REJECTED"))]
    df = spark.createDataFrame(rows, "n int, event_id long, user_id long, job_id long, to_status string, occurred_at timestamp")
    drained = J.drain(J.application_state(in_files(spark, tmp_path, df, THIRDS).drop("n")), "update", "state-test")
    batch = {r.user_id: r for r in J.application_state_batch(df.drop("n")).collect()}
    fields = ("status", "depth", "is_saved", "applied_at", "moves", "refused")
    last = {r.user_id: r for r in drained.orderBy(F.col("moves") + F.col("refused")).collect()}
    assert {u: tuple(r[f] for f in fields) for u, r in last.items()} == {u: tuple(r[f] for f in fields) for u, r in batch.items()}
    assert (batch[1].status, batch[1].applied_at, batch[1].refused, batch[1].is_saved) == ("OFFER", at(4), 3, True)
    assert (batch[2].status, batch[2].applied_at, batch[2].refused_moves) == ("REJECTED", at(1), ["105: APPLIED > SAVED"])
    bad = {(r.user_id, r.event_id, r.from_status, r.to_status) for r in J.refused(drained).collect()}
    assert bad == {(1, 2, "APPLIED", "APPLIED"), (1, 6, "REJECTED", "OFFER"), (1, 9, "WITHDRAWN", "SAVED"), (2, 105, "APPLIED", "SAVED")} - ({(1, 9, "WITHDRAWN", "SAVED")} if batch[1].refused == 2 else set())
    assert bad == {(r.user_id, r.event_id, r.from_status, r.to_status) for r in J.refused(J.application_state_batch(df.drop("n"))).collect()}


def test_application_state_is_column_work(spark, tmp_path):
    """No Python is called for each application, of which there are very many; late events come after their batch's."""
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    rows = [(1, 1, 1, 1, "APPLIED", at(9)), (5, 2, 1, 1, "APPLIED", at(1)), (10, 3, 1, 1, "OFFER", at(2))]
    df = spark.createDataFrame(rows, "n int, event_id long, user_id long, job_id long, to_status string, occurred_at timestamp")
    states = J.application_state(in_files(spark, tmp_path, df, THIRDS).drop("n"))
    assert "Pandas" not in states._jdf.queryExecution().analyzed().toString()
    got = J.drain(states, "update", "column-test").orderBy(F.col("moves") + F.col("refused"))
    assert [(r.status, r.applied_at, r.moves, r.refused, r.refused_moves) for r in got.collect()] == [("APPLIED", at(9), 1, 0, []), ("APPLIED", at(9), 1, 1, ["2: APPLIED > APPLIED"]), ("OFFER", at(9), 2, 1, [])]


def test_demand_over_batches(spark, tmp_path):
    skills = spark.createDataFrame([(k,) for k in range(5)], "skill_id long")
    named = spark.createDataFrame([(n, k) for n in range(20) for k in range(5) if n % (k + 2) == 0] + [(3, 1), (3, 1), (4, None)], "job_id long, skill_id long")
    posts = spark.createDataFrame([(n, n) for n in range(12)], "n int, job_id long")
    before = spark.createDataFrame([(n,) for n in range(12, 20)], "job_id long")
    stream = in_files(spark, tmp_path, posts, THIRDS).select("job_id")
    kept = J.demand_refresh(stream, named, J.demand_counts(before, named))
    for number, upto in ((1, 4), (2, 9), (3, 12)):
        live = before.union(posts.where(F.col("n") < upto).select("job_id"))
        want = {r.skill_id: r.demand_score for r in D.skill_demand(live, named, skills).collect()}
        assert {r.skill_id: r.demand_score for r in J.demand_of(kept.latest(number), skills).collect()} == want
    empty = J.demand_of(J.demand_counts(before.limit(0), named), skills)
    assert {r.demand_score for r in empty.collect()} == {None}


def test_interview_over_batches(spark, tmp_path):
    scores = [0.5, 0.9, 0.1, 0.9, 0.95, 0.2, 0.8, 0.9, 0.3, 0.7, 0.9, 0.9]
    topics = ["a", "b"]
    at = dt.datetime(2024, 1, 1)
    rows = [(n, s, n, x if s == 1 else (x + 0.3) % 1.0, topics if s != 2 else [], at + dt.timedelta(minutes=n)) for n, x in enumerate(scores) for s in (1, 2)]
    df = spark.createDataFrame(rows, "n int, session_id long, turn long, score double, topics array<string>, answered_at timestamp")
    drained = J.drain(J.stream_interview(in_files(spark, tmp_path, df, THIRDS).drop("n"), 9), "append", "interview-test")
    batch = N.interview_policy(df.drop("n"), 9)
    rows = lambda x: sorted(map(tuple, x.select("session_id", "turn", "move", "topic", "level").collect()))
    assert rows(drained) == rows(batch)
    one = [r[2:] for r in rows(batch) if r[0] == 1]
    assert one[:6] == [("CONTINUE", "b", 1), ("ADVANCE", "b", 2), ("CLARIFY", "b", 1), ("ADVANCE", "b", 2), ("ADVANCE", "b", 3), ("CLARIFY", "b", 2)]
    assert one[8:] == [("FINISH", None, None)] * 4


def test_interviews_expire(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, 1, 1, 0.5, at(0)), (5, 2, 1, 0.5, at(9)), (10, 2, 2, 0.8, at(10))]
    df = spark.createDataFrame(rows, "n int, session_id long, turn long, score double, answered_at timestamp").withColumn("topics", F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    drained = J.drain(J.stream_interview(in_files(spark, tmp_path, df, THIRDS).drop("n")), "append", "expiry-test")
    assert sorted(map(tuple, drained.collect()), key=str) == sorted([(1, 1, "CONTINUE", "b", 1), (1, None, "EXPIRED", None, None), (2, 1, "CONTINUE", "b", 1), (2, 2, "ADVANCE", "c", 1)], key=str)
