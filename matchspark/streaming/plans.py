"""Streams over the given tables, drained; their SQL is that of the batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.functions import text as T
from matchspark.operators import planning as N
from matchspark.plans import base as B
from matchspark.plans.base import query
from matchspark.plans.market import NORMAL_HASH_SQL
from matchspark.streaming import jobs as J

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(s: SparkSession, d: str) -> DataFrame:
    raw = J.read_files(s, f"{d}/events.parquet", _EVENTS)
    kind = F.col("event_type")
    status = F.when(kind == "view", "SAVED").when(kind == "click", "APPLIED").when(kind == "signup", "ASSESSMENT").when(kind == "purchase", "INTERVIEW").otherwise("REJECTED")
    return raw.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("job_id"), status.alias("to_status"), F.col("ts").cast("timestamp").alias("occurred_at"))


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("funnel_windowed", "SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d %H:%M:%S') AS start, to_status, count(*) AS n FROM application_events GROUP BY ALL")
def funnel_windowed(s: SparkSession, d: str) -> DataFrame:
    return _text(J.drain(J.funnel_windowed(_events(s, d)), "complete", "funnel"))


@query("user_sessions", """, gaps AS (SELECT user_id, occurred_at, event_id, CASE WHEN occurred_at >= lag(occurred_at) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM application_events WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, event_id)),
  islands AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY occurred_at, event_id) AS i FROM gaps) SELECT user_id, strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM islands GROUP BY user_id, i""")
def user_sessions(s: SparkSession, d: str) -> DataFrame:
    return _text(J.drain(J.user_sessions(_events(s, d)), "complete", "sessions"))


@query("feedback_latest", "SELECT user_id, job_id, status AS rating FROM applications")
def feedback_latest(s: SparkSession, d: str) -> DataFrame:
    return J.drain(J.feedback_latest(_events(s, d)), "complete", "feedback")


_FOLD_SQL = """, moves_ AS (SELECT user_id, job_id, list({'s': to_status, 'to': to_status, 'at': occurred_at, 'saved': to_status = 'SAVED', 'applied': CASE WHEN to_status IN ('APPLIED', 'ASSESSMENT', 'INTERVIEW') THEN occurred_at END, 'moves': 1, 'refused': 0} ORDER BY occurred_at, event_id) AS e FROM application_events GROUP BY ALL),
  folded AS (SELECT user_id, job_id, list_reduce(e, lambda a, b: CASE WHEN a.s = b.to OR (a.s = 'REJECTED' AND b.to <> 'APPLIED') OR (b.to = 'SAVED' AND NOT a.saved) THEN {'s': a.s, 'to': a.to, 'at': a.at, 'saved': a.saved, 'applied': a.applied, 'moves': a.moves, 'refused': a.refused + 1}
    ELSE {'s': b.to, 'to': b.to, 'at': b.at, 'saved': a.saved OR b.to = 'SAVED', 'applied': CASE WHEN b.to = 'SAVED' THEN NULL WHEN b.to = 'REJECTED' THEN a.applied ELSE coalesce(a.applied, b.at) END, 'moves': a.moves + 1, 'refused': a.refused} END) AS f FROM moves_)
  SELECT user_id, job_id, f.s AS status, CASE f.s WHEN 'SAVED' THEN 0 WHEN 'APPLIED' THEN 1 WHEN 'ASSESSMENT' THEN 2 WHEN 'INTERVIEW' THEN 3 END AS depth, f.saved AS is_saved, strftime(f.applied, '%Y-%m-%d %H:%M:%S') AS applied_at, f.moves AS moves, f.refused AS refused FROM folded"""


def _states(df: DataFrame) -> DataFrame:
    return df.select("user_id", "job_id", "status", "depth", "is_saved", F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss").alias("applied_at"), "moves", "refused")


@query("application_state", _FOLD_SQL)
def application_state(s: SparkSession, d: str) -> DataFrame:
    """One batch drains the whole table, so the updates are the final states."""
    return _states(J.drain(J.application_state(_events(s, d)), "update", "state"))


@query("application_state_batch", _FOLD_SQL)
def application_state_batch(s: SparkSession, d: str) -> DataFrame:
    return _states(J.application_state_batch(B.application_events(s, d)))


_DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_POSTING_SQL = f"""SELECT doc_id, source, doc_id // 3 AS external_id, text, {NORMAL_HASH_SQL} AS h, CASE WHEN doc_id % 11 = 0 THEN 'no usable link' WHEN length(trim(text)) < 200 THEN 'description too short' WHEN lang = 'de' AND doc_id % 2 = 0 THEN 'no title' END AS reason, doc_id % 5 = 0 AS old FROM documents"""


def _postings(docs: DataFrame) -> DataFrame:
    """Documents as deliveries of postings: three ids in a row are one posting if they have one source."""
    k = F.col("doc_id")
    return docs.select(
        k.alias("job_id"), "source", F.floor(k / 3).alias("external_id"), T.content_hash(F.col("text")).alias("content_hash"), F.timestamp_seconds(k).alias("arrived_at"), "text",
        F.when(k % 11 == 0, "ftp://x").otherwise(F.concat(F.lit("https://jobs.example.com/"), k)).alias("link"), F.when((F.col("lang") == "de") & (k % 2 == 0), " ").otherwise("Engineer").alias("title"), F.lit("Acme").alias("company"),
    )


@query("stream_ingest", f""", p AS ({_POSTING_SQL}), good AS (SELECT * FROM p WHERE reason IS NULL AND NOT old), corpus AS (SELECT * FROM p WHERE old),
  k AS (SELECT g.*, coalesce(c.doc_id, CASE WHEN g.source IS NOT NULL THEN first_value(g.doc_id) OVER (PARTITION BY g.source, g.external_id ORDER BY g.doc_id) END) AS first_id
    FROM good g LEFT JOIN (SELECT source, external_id, min(doc_id) AS doc_id FROM corpus GROUP BY ALL) c ON c.source = g.source AND c.external_id = g.external_id),
  fresh AS (SELECT * FROM k WHERE first_id IS NULL OR first_id = doc_id),
  h AS (SELECT h, coalesce(min(doc_id) FILTER (old), min(doc_id)) AS same_id FROM (SELECT h, doc_id, old FROM fresh UNION ALL SELECT h, doc_id, old FROM corpus) GROUP BY h),
  r AS (SELECT k.doc_id, CASE WHEN first_id <> k.doc_id THEN first_id WHEN same_id <> k.doc_id THEN same_id END AS canonical_job_id FROM k LEFT JOIN h USING (h))
  SELECT doc_id AS job_id, CASE WHEN canonical_job_id IS NULL THEN 'CREATED' ELSE 'DUPLICATE' END AS outcome, NULL AS reject_reason, canonical_job_id FROM r
  UNION ALL SELECT doc_id, 'FAILED', reason, NULL FROM p WHERE NOT old AND reason IS NOT NULL""")
def stream_ingest(s: SparkSession, d: str) -> DataFrame:
    """A stream of deliveries; every fifth posting is in the corpus."""
    stream = _postings(J.read_files(s, f"{d}/documents.parquet", _DOCS).where("doc_id % 5 <> 0"))
    corpus = _postings(B.table(s, d, "documents").where("doc_id % 5 = 0"))
    return J.stream_ingest(stream, corpus).before().select("job_id", "outcome", "reject_reason", "canonical_job_id")


def shape_encoder() -> Callable[[list[str]], list[list[float]]]:
    """An encoder that needs no model: how long a text is, and how many blanks and line ends it has."""
    return lambda texts: [[len(t), t.count(" "), t.count("\n")] for t in texts]


@query("stream_index", "SELECT doc_id, 'shape' AS model, sha256('v1' || chr(10) || text) AS hash, length(text) || ' ' || (length(text) - length(replace(text, ' ', ''))) || ' ' || (length(text) - length(replace(text, chr(10), ''))) AS vector FROM documents WHERE length(trim(text)) >= 80 AND doc_id % 2 <> 0")
def stream_index(s: SparkSession, d: str) -> DataFrame:
    """The texts whose hash is not indexed yet are encoded; every second one is."""
    indexed = B.table(s, d, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit("shape").alias("model"), T.document_hash(F.col("text")).alias("hash"))
    kept = J.stream_index(J.read_files(s, f"{d}/documents.parquet", _DOCS).select("doc_id", "text"), indexed, shape_encoder, "shape", 3, "doc_id")
    whole = F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), " ")
    return J.indexed_now(kept, "doc_id").select("doc_id", "model", "hash", whole.alias("vector"))


@query("demand_refresh", """SELECT s.skill_id, round(coalesce(n, 0) / (SELECT count(*) FROM orders), 4) AS demand_score FROM skills s
  LEFT JOIN (SELECT skill_id, count(DISTINCT job_id) AS n FROM job_skills GROUP BY ALL) USING (skill_id)""")
def demand_refresh(s: SparkSession, d: str) -> DataFrame:
    """Every third posting was there before; the others come in the stream."""
    skills, job_skills = B.skills(s, d), B.job_skills(s, d)
    start = J.demand_counts(B.table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("job_id")), job_skills)
    stream = J.read_files(s, f"{d}/orders.parquet", "o_orderkey long").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("job_id"))
    return J.demand_of(J.demand_refresh(stream, job_skills, start).latest(), skills)


TOPICS = ("python", "spark", "design")
_POLICY_SQL = f""", t AS (SELECT conv_id, turn, length(text) % 101 / 100.0 AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
  walk AS (WITH RECURSIVE w AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, NULL::BIGINT AS turn, NULL::VARCHAR AS move, 1 AS k, 1 AS lev, 1 AS asked FROM t
    UNION ALL SELECT t.conv_id, t.n, t.turn, CASE WHEN asked >= 6 THEN 'FINISH' WHEN score < 0.4 THEN 'CLARIFY' WHEN score < 0.7 THEN 'CONTINUE' ELSE 'ADVANCE' END,
      CASE WHEN asked >= 6 OR score < 0.4 THEN k ELSE least(k + 1, {len(TOPICS)}) END, CASE WHEN asked >= 6 THEN lev WHEN score < 0.4 THEN greatest(0, lev - 1) WHEN score >= 0.7 AND k = {len(TOPICS)} THEN least(3, lev + 1) ELSE lev END,
      CASE WHEN asked >= 6 THEN asked ELSE asked + 1 END FROM w JOIN t ON t.conv_id = w.conv_id AND t.n = w.n + 1) SELECT * FROM w)
  SELECT conv_id AS session_id, turn, move, CASE WHEN move <> 'FINISH' THEN {list(TOPICS)!r}[k] END AS topic, CASE WHEN move <> 'FINISH' THEN lev END AS level FROM walk WHERE n > 0"""


def _answers(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").alias("session_id"), "turn", (F.length("text") % 101 / 100.0).alias("score"), F.array(*map(F.lit, TOPICS)).alias("topics"), F.timestamp_seconds(F.col("turn") + 1_000_000_000).alias("answered_at"))


@query("interview_policy", _POLICY_SQL)
def interview_policy(s: SparkSession, d: str) -> DataFrame:
    return N.interview_policy(_answers(B.table(s, d, "conversations")))


@query("stream_interview", _POLICY_SQL)
def stream_interview(s: SparkSession, d: str) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in B.table(s, d, "conversations").schema)
    return J.drain(J.stream_interview(_answers(J.read_files(s, f"{d}/conversations.parquet", schema))), "append", "interview")
