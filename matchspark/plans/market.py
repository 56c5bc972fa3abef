"""Postings, demand, gaps, funnel and ranking over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchspark.functions import text as T
from matchspark.operators import demand as D
from matchspark.operators import postings as P
from matchspark.operators import ranking as R
from matchspark.operators import records as L
from matchspark.plans import base as B
from matchspark.plans.base import as_of, query, table
from matchspark.session import parts_for

NORMAL_HASH_SQL = r"sha256(lower(regexp_replace(text, '\s+', '', 'g')))"


def _live(s: SparkSession, d: str) -> DataFrame:
    return P.live_postings(B.jobs(s, d), as_of())


def _targets(s: SparkSession, d: str) -> DataFrame:
    """Each user's target postings: the open ones that they ordered."""
    open_ = table(s, d, "orders").where("o_orderstatus <> 'F'")
    return open_.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("job_id"))


TARGETS_SQL = ", targets AS (SELECT o_custkey AS user_id, o_orderkey AS job_id FROM orders WHERE o_orderstatus <> 'F')"
RELATED_SQL = """, related AS (
  SELECT DISTINCT user_id, parent_skill_id AS skill_id FROM candidate_skills JOIN skills USING (skill_id) WHERE parent_skill_id IS NOT NULL
  UNION SELECT DISTINCT user_id, s.skill_id FROM candidate_skills c JOIN skills s ON c.skill_id = s.parent_skill_id)"""


# --- filters ------------------------------------------------------------------------------------------------------


@query("live_postings", "SELECT job_id, title, min_years FROM live")
def live_postings(s: SparkSession, d: str) -> DataFrame:
    return _live(s, d).select("job_id", "title", "min_years")


@query("browse_filter", "SELECT job_id FROM live WHERE contains(lower(title), 'high') AND work_mode = 'REMOTE' AND min_years <= 4 AND (max_years IS NULL OR max_years >= 4)")
def browse_filter(s: SparkSession, d: str) -> DataFrame:
    return P.browse_filter(B.jobs(s, d), as_of(), q="HIGH", work_mode="REMOTE", years=4).select("job_id")


@query("text_contains", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def text_contains(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where(P.text_contains("License", "text", "source")).select("doc_id")


@query("range_covers", "SELECT job_id FROM jobs WHERE min_years <= 5 AND (max_years IS NULL OR 5 <= max_years)")
def range_covers(s: SparkSession, d: str) -> DataFrame:
    return B.jobs(s, d).where(P.range_covers(5, "min_years", "max_years")).select("job_id")


@query("posted_within", "SELECT job_id FROM jobs WHERE posted_at IS NULL OR posted_at >= TIMESTAMP '2000-01-01' - INTERVAL 90 DAY")
def posted_within(s: SparkSession, d: str) -> DataFrame:
    return B.jobs(s, d).where(P.posted_within(90, as_of())).select("job_id")


@query("title_matches_any_role", "SELECT job_id FROM live WHERE contains(lower(title), 'urgent') OR contains(lower(title), 'low')")
def title_matches_any_role(s: SparkSession, d: str) -> DataFrame:
    roles = s.createDataFrame([("urgent",), ("LOW",), (" ",)], "role string")
    return P.title_matches_any_role(_live(s, d), roles).select("job_id")


@query("usable_link", r"""SELECT page_id, CASE WHEN regexp_matches(trim(url), '(?i)^https?://[^\s/?#]+') THEN trim(url)
  WHEN NOT regexp_matches(trim(url), '(?i)^[a-z][a-z0-9+.-]*:') AND regexp_matches(trim(url), '^[^\s/?#]+\.[^\s/?#]+') THEN 'https://' || trim(url) END AS link FROM pages""")
def usable_link(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", P.usable_link(F.col("url")).alias("link"))


@query("soft_delete_scope", "SELECT job_id FROM jobs WHERE status = 'ACTIVE' AND company_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def soft_delete_scope(s: SparkSession, d: str) -> DataFrame:
    gone = B.jobs(s, d).withColumn("deleted_at", F.when(F.col("status") != "ACTIVE", F.col("posted_at")))
    owners = table(s, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("company_id"))
    return P.soft_delete_scope(gone, owners=owners, owner="company_id").select("job_id")


@query("taxonomy_search", "SELECT skill_id, name FROM skills WHERE contains(lower(name), 'ring') ORDER BY starts_with(lower(name), 'ring') DESC, length(name), name, skill_id LIMIT 20")
def taxonomy_search(s: SparkSession, d: str) -> DataFrame:
    return P.taxonomy_search(B.skills(s, d), " Ring ", 20).select("skill_id", "name")


@query("visible_candidate_skills", "SELECT user_id, skill_id FROM candidate_skills WHERE skill_id % 10 <> 3")
def visible_candidate_skills(s: SparkSession, d: str) -> DataFrame:
    k = F.col("skill_id")
    held = B.candidate_skills(s, d).select("*", (k % 10 == 3).alias("is_rejected"), (k % 2 == 0).alias("is_user_verified"), F.col("user_id").alias("created_at"))
    return P.visible_candidate_skills(held).select("user_id", "skill_id")


@query("threshold_ge", "SELECT job_id, skill_id FROM job_skills WHERE confidence >= 0.9")
def threshold_ge(s: SparkSession, d: str) -> DataFrame:
    return P.threshold_ge(B.job_skills(s, d), "confidence", 0.9).select("job_id", "skill_id")


@query("embeddable", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 80")
def embeddable(s: SparkSession, d: str) -> DataFrame:
    return P.embeddable(table(s, d, "documents")).select("doc_id")


@query("admit_postings", "SELECT doc_id, CASE WHEN length(trim(text)) < 200 THEN 'description too short' END AS reject_reason, source AS company_clean FROM documents")
def admit_postings(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").withColumn("url", F.concat(F.lit("https://jobs.example.com/"), F.col("doc_id")))
    return P.admit_postings(docs, "url", "text", "lang", "source").select("doc_id", "reject_reason", "company_clean")


@query("ingest_report", f"""SELECT count(*) FILTER (k = 1 AND n >= 200) AS created, count(*) FILTER (k > 1 AND n >= 200) AS duplicate,
  count(*) FILTER (n < 200) AS failed, count(*) AS processed
  FROM (SELECT length(trim(text)) AS n, row_number() OVER (PARTITION BY {NORMAL_HASH_SQL} ORDER BY doc_id) AS k FROM documents)""")
def ingest_report(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", F.length(F.trim("text")).alias("n"), T.content_hash(F.col("text")).alias("content_hash"))
    first = docs.groupBy("content_hash").agg(F.min("doc_id").alias("first"))
    outcome = F.when(F.col("n") < 200, "FAILED").when(F.col("doc_id") == F.col("first"), "CREATED").otherwise("DUPLICATE")
    return P.ingest_report(docs.join(first, "content_hash").select(outcome.alias("outcome")))


@query("check_invariants", """SELECT 'years in order' AS rule, count(*) FILTER (NOT max_years >= min_years) AS violations FROM jobs
  UNION ALL SELECT 'expires after posting', count(*) FILTER (NOT expires_at > posted_at) FROM jobs
  UNION ALL SELECT 'salary below 300000', count(*) FILTER (NOT salary_max < 300000) FROM jobs""")
def check_invariants(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return P.check_invariants(B.jobs(s, d), {"years in order": c("max_years") >= c("min_years"), "expires after posting": c("expires_at") > c("posted_at"), "salary below 300000": c("salary_max") < 300000})


# --- joins --------------------------------------------------------------------------------------------------------


@query("postings_with_application", "SELECT j.job_id, a.user_id, a.status AS application FROM jobs j LEFT JOIN applications a ON j.job_id = a.job_id")
def postings_with_application(s: SparkSession, d: str) -> DataFrame:
    """Of every user, each posting they have dealt with, and the postings nobody has."""
    return L.postings_with_application(B.jobs(s, d).select("job_id"), B.applications(s, d)).select("job_id", "user_id", "application")


@query("exclude_applied", "SELECT user_id, job_id FROM application_events e WHERE NOT EXISTS (SELECT 1 FROM applications a WHERE a.user_id = e.user_id AND a.job_id = e.job_id AND a.status = 'APPLIED') GROUP BY ALL")
def exclude_applied(s: SparkSession, d: str) -> DataFrame:
    pairs = B.application_events(s, d).select("user_id", "job_id").distinct()
    return L.exclude_applied(pairs, B.applications(s, d), ["user_id", "job_id"])


@query("reached_stage", """SELECT a.user_id, a.job_id, a.status = 'INTERVIEW' OR EXISTS (SELECT 1 FROM application_events e
  WHERE e.user_id = a.user_id AND e.job_id = a.job_id AND e.to_status = 'INTERVIEW') AS reached FROM applications a""")
def reached_stage(s: SparkSession, d: str) -> DataFrame:
    return D.reached_stage(B.applications(s, d), B.application_events(s, d), "INTERVIEW").select("user_id", "job_id", "reached")


@query("skill_parent_join", f"{RELATED_SQL} SELECT user_id, skill_id FROM related")
def skill_parent_join(s: SparkSession, d: str) -> DataFrame:
    return D.related_skills(B.candidate_skills(s, d), B.skills(s, d))


@query("skill_facts", """, demand AS (SELECT skill_id, count(DISTINCT job_id) AS n FROM job_skills JOIN live USING (job_id) GROUP BY ALL)
  SELECT skill_id, parent_skill_id, round(coalesce(n, 0) / (SELECT count(*) FROM live), 4) AS demand_score
  FROM skills LEFT JOIN demand USING (skill_id) WHERE skill_id IN (SELECT skill_id FROM candidate_skills)""")
def skill_facts(s: SparkSession, d: str) -> DataFrame:
    scored = D.skill_demand(_live(s, d), B.job_skills(s, d), B.skills(s, d))
    return B.skills(s, d).join(B.candidate_skills(s, d), "skill_id", "left_semi").join(scored, "skill_id").select("skill_id", "parent_skill_id", "demand_score")


@query("candidate_snapshot", """SELECT user_id, country_code, years, coalesce(n_skills, 0) AS n_skills, coalesce(n_applications, 0) AS n_applications, last_status
  FROM candidates LEFT JOIN (SELECT user_id, count(*) AS n_skills FROM candidate_skills GROUP BY ALL) USING (user_id)
  LEFT JOIN (SELECT user_id, count(*) AS n_applications, arg_max(status, job_id) AS last_status FROM applications GROUP BY ALL) USING (user_id)""")
def candidate_snapshot(s: SparkSession, d: str) -> DataFrame:
    return L.candidate_snapshot(B.candidates(s, d), B.candidate_skills(s, d), B.applications(s, d)).select("user_id", "country_code", "years", "n_skills", "n_applications", "last_status")


@query("backlog", "SELECT j.job_id FROM live j LEFT JOIN job_vectors v USING (job_id) WHERE v.embedding IS NULL")
def backlog(s: SparkSession, d: str) -> DataFrame:
    return _live(s, d).select("job_id").join(B.job_vectors(s, d), "job_id", "left_anti")


@query("answers_per_interview", """SELECT conv_id, count(*) FILTER (role = 'assistant') AS answered,
  round(avg(length(text) % 101 / 100.0) FILTER (role = 'assistant'), 3) AS average_mark FROM conversations GROUP BY conv_id""")
def answers_per_interview(s: SparkSession, d: str) -> DataFrame:
    return L.answers_per_interview(table(s, d, "conversations"), "conv_id", F.col("role") == "assistant", F.length("text") % 101 / 100.0)


@query("provenance_scope", "SELECT user_id, count(*) AS n FROM candidate_skills WHERE skill_id IN (SELECT skill_id FROM skills WHERE category = 'ECONOMY') GROUP BY ALL")
def provenance_scope(s: SparkSession, d: str) -> DataFrame:
    return L.provenance_scope(B.candidate_skills(s, d), B.skills(s, d).where("category = 'ECONOMY'"), "skill_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("resolve_names", "SELECT job_id, min(s.skill_id) AS skill_id, count(s.skill_id) AS found, count(*) FILTER (s.skill_id IS NULL) AS missed FROM job_skills j JOIN skills k ON k.skill_id = j.skill_id LEFT JOIN (SELECT name, min(skill_id) AS skill_id FROM skills WHERE skill_id % 5 <> 0 GROUP BY name) s ON s.name = k.name GROUP BY ALL")
def resolve_names(s: SparkSession, d: str) -> DataFrame:
    """Mentions by name go to the name's first id; every fifth skill's name is unknown, and its mentions are missed."""
    known = B.skills(s, d).where("skill_id % 5 <> 0")
    mentions = B.job_skills(s, d).join(B.skills(s, d).select("skill_id", "name"), "skill_id").select("job_id", "name")
    found = L.resolve_names(mentions, known)
    return found.groupBy("job_id").agg(F.min("canonical_id").alias("skill_id"), F.count("canonical_id").alias("found"), F.count_if(F.col("canonical_id").isNull()).alias("missed"))


# --- aggregates ---------------------------------------------------------------------------------------------------


@query("skill_demand", """SELECT s.skill_id, round(coalesce(n, 0) / (SELECT count(*) FROM live), 4) AS demand_score FROM skills s
  LEFT JOIN (SELECT skill_id, count(DISTINCT job_id) AS n FROM job_skills JOIN live USING (job_id) GROUP BY ALL) USING (skill_id)""")
def skill_demand(s: SparkSession, d: str) -> DataFrame:
    return D.skill_demand(_live(s, d), B.job_skills(s, d), B.skills(s, d))


@query("demand_coverage", """, demand AS (SELECT s.skill_id, round(coalesce(n, 0) / (SELECT count(*) FROM live), 4) AS score FROM skills s
  LEFT JOIN (SELECT skill_id, count(DISTINCT job_id) AS n FROM job_skills JOIN live USING (job_id) GROUP BY ALL) USING (skill_id))
  SELECT count(*) FILTER (score > 0) AS scored, count(*) AS skills, max(score) AS highest FROM demand""")
def demand_coverage(s: SparkSession, d: str) -> DataFrame:
    return D.demand_coverage(skill_demand(s, d))


@query("required_counts", "SELECT skill_id, count(*) AS n_jobs FROM job_skills JOIN jobs USING (job_id) WHERE requirement = 'REQUIRED' AND status = 'ACTIVE' GROUP BY ALL")
def required_counts(s: SparkSession, d: str) -> DataFrame:
    return D.required_counts(B.jobs(s, d), B.job_skills(s, d))


GAPS_SQL = f"""{TARGETS_SQL}{RELATED_SQL}, asked AS (
  SELECT user_id, skill_id, sum(CASE WHEN requirement = 'REQUIRED' THEN 1.0 ELSE 0.5 END) AS w FROM targets JOIN job_skills USING (job_id) GROUP BY ALL),
rated AS (SELECT user_id, skill_id, round_even(CAST(w AS DOUBLE) / n, 4) AS frequency FROM asked JOIN (SELECT user_id, count(DISTINCT job_id) AS n FROM targets GROUP BY ALL) USING (user_id)),
gaps AS (SELECT user_id, skill_id, frequency,
  CASE WHEN (user_id, skill_id) IN (SELECT (user_id, skill_id) FROM candidate_skills) THEN 'STRONG'
       WHEN (user_id, skill_id) IN (SELECT (user_id, skill_id) FROM related) THEN 'PARTIAL' ELSE 'MISSING' END AS gap_status,
  CASE WHEN frequency >= 0.6 THEN 'CRITICAL' WHEN frequency >= 0.35 THEN 'HIGH' WHEN frequency >= 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM rated WHERE frequency >= 0.05)"""


def _gaps(s: SparkSession, d: str) -> DataFrame:
    return D.skill_gaps(_targets(s, d), B.job_skills(s, d), B.candidate_skills(s, d), B.skills(s, d))


@query("skill_gaps", f"{GAPS_SQL} SELECT * FROM gaps")
def skill_gaps(s: SparkSession, d: str) -> DataFrame:
    return _gaps(s, d)


@query("gap_availability", f"""{GAPS_SQL} SELECT user_id, CASE WHEN user_id NOT IN (SELECT user_id FROM targets) THEN 'NO_TARGET'
  WHEN user_id NOT IN (SELECT user_id FROM gaps) THEN 'NO_JOBS' ELSE 'READY' END AS availability FROM candidates""")
def gap_availability(s: SparkSession, d: str) -> DataFrame:
    return D.gap_availability(_targets(s, d), B.candidates(s, d), _gaps(s, d))


FACTS_SQL = """, facts AS (SELECT a.user_id, a.job_id, title, country_code AS location,
  CASE WHEN score IS NULL THEN 'Not recorded' WHEN trunc(score) >= 70 THEN '70+' WHEN trunc(score) >= 60 THEN '60-69' WHEN trunc(score) >= 50 THEN '50-59' ELSE 'Under 50' END AS band,
  CAST(coalesce(i, false) OR a.status = 'INTERVIEW' AS INTEGER) AS interviewed, CAST(coalesce(o, false) OR a.status = 'OFFER' AS INTEGER) AS offered
  FROM applications a JOIN jobs USING (job_id) LEFT JOIN (SELECT user_id, job_id, bool_or(to_status = 'INTERVIEW') AS i, bool_or(to_status = 'OFFER') AS o, max(value) AS score FROM application_events GROUP BY ALL) e
  ON e.user_id = a.user_id AND e.job_id = a.job_id WHERE applied_at IS NOT NULL)"""


@query("funnel_facts", f"{FACTS_SQL} SELECT * FROM facts")
def funnel_facts(s: SparkSession, d: str) -> DataFrame:
    return D.funnel_facts(B.applications(s, d), B.jobs(s, d), B.application_events(s, d))


@query("funnel_report", f"""{FACTS_SQL}, shaped AS (SELECT user_id, lower(trim(coalesce(title, ''))) AS role, title, coalesce(location, 'Not stated') AS location, band, interviewed, offered FROM facts),
long AS (SELECT user_id, 'overall' AS segment, 'overall' AS g, 'overall' AS label, interviewed, offered FROM shaped
  UNION ALL SELECT user_id, 'role', role, title, interviewed, offered FROM shaped UNION ALL SELECT user_id, 'location', location, location, interviewed, offered FROM shaped
  UNION ALL SELECT user_id, 'band', band, band, interviewed, offered FROM shaped),
counted AS (SELECT user_id, segment, min(label) AS label, count(*) AS applications, CAST(sum(interviewed) AS BIGINT) AS interviews, CAST(sum(offered) AS BIGINT) AS offers FROM long GROUP BY user_id, segment, g)
SELECT *, CASE WHEN applications >= 5 THEN round(interviews / applications, 4) END AS interview_rate, CASE WHEN applications >= 5 THEN round(offers / applications, 4) END AS offer_rate FROM counted""")
def funnel_report(s: SparkSession, d: str) -> DataFrame:
    return D.funnel_report(funnel_facts(s, d))


@query("score_band", "SELECT event_id, CASE WHEN trunc(value) >= 70 THEN '70+' WHEN trunc(value) >= 60 THEN '60-69' WHEN trunc(value) >= 50 THEN '50-59' ELSE 'Under 50' END AS band FROM events")
def score_band(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", D.score_band(F.col("value")).alias("band"))


@query("weighted_topics", f"""{TARGETS_SQL}{RELATED_SQL}, summed AS (SELECT t.user_id, j.skill_id,
  round(sum(CASE WHEN requirement = 'REQUIRED' THEN 1.0 ELSE 0.5 END * CASE WHEN c.skill_id IS NOT NULL THEN 1.0 WHEN r.skill_id IS NOT NULL THEN 1.2 ELSE 1.4 END)::DOUBLE, 6) AS weight, round(sum(confidence), 6) AS confidence
  FROM targets t JOIN job_skills j USING (job_id) LEFT JOIN candidate_skills c ON c.user_id = t.user_id AND c.skill_id = j.skill_id LEFT JOIN related r ON r.user_id = t.user_id AND r.skill_id = j.skill_id GROUP BY ALL)
  SELECT * FROM (SELECT user_id, skill_id, name, weight, confidence, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, confidence DESC, name, skill_id) AS place FROM summed JOIN skills USING (skill_id)) WHERE place <= 8""")
def weighted_topics(s: SparkSession, d: str) -> DataFrame:
    parts = parts_for(table(s, d, "lineitem"), 250_000)
    return D.weighted_topics(_targets(s, d), B.job_skills(s, d, parts), B.candidate_skills(s, d, parts), B.skills(s, d), parts=parts).withColumn("place", F.col("place").cast("long"))


def _runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("query"), F.col("ts").cast("timestamp").alias("started_at"), (1 + F.col("event_id") % 3).alias("requests_spent"))


@query("requests_since", "SELECT CAST(coalesce(sum(1 + event_id % 3), 0) AS BIGINT) AS requests FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def requests_since(s: SparkSession, d: str) -> DataFrame:
    return D.requests_since(_runs(s, d), F.lit("2024-01-10").cast("timestamp"))


@query("last_used", "SELECT event_type AS query, CAST(max(ts) AS VARCHAR)[1:19] AS last_used FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL")
def last_used(s: SparkSession, d: str) -> DataFrame:
    return D.last_used(_runs(s, d), F.lit("2024-01-10").cast("timestamp")).withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss"))


@query("skill_counts_by_source", "SELECT category, count(*) AS n_held, count(DISTINCT user_id) AS n_users FROM candidate_skills JOIN skills USING (skill_id) GROUP BY ALL")
def skill_counts_by_source(s: SparkSession, d: str) -> DataFrame:
    return L.counts_by(B.candidate_skills(s, d).join(B.skills(s, d), "skill_id"), ["category"], "user_id", "n_held")


@query("score_distribution", "SELECT min(value) AS least, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, max(value) AS most FROM events")
def score_distribution(s: SparkSession, d: str) -> DataFrame:
    return D.distribution(table(s, d, "events"), "value")


@query("feedback_summary", "SELECT status, count(*) AS n FROM applications GROUP BY ALL")
def feedback_summary(s: SparkSession, d: str) -> DataFrame:
    return L.counts_by(B.applications(s, d), ["status"])


# --- ranking ------------------------------------------------------------------------------------------------------


@query("rank_page", """SELECT company_id, job_id, rank, total FROM (SELECT company_id, job_id, row_number() OVER (PARTITION BY company_id ORDER BY salary_max DESC, job_id) AS rank,
  count(*) OVER (PARTITION BY company_id) AS total FROM jobs WHERE salary_max >= 50000) WHERE rank BETWEEN 11 AND 20""")
def rank_page(s: SparkSession, d: str) -> DataFrame:
    page = R.rank_page(B.jobs(s, d), "company_id", "salary_max", "job_id", 11, 10, 50000)
    return page.select("company_id", "job_id", F.col("rank").cast("long").alias("rank"), "total")


@query("recent_first", "SELECT company_id, job_id, rank FROM (SELECT company_id, job_id, row_number() OVER (PARTITION BY company_id ORDER BY posted_at DESC NULLS LAST, job_id) AS rank FROM live) WHERE rank <= 5")
def recent_first(s: SparkSession, d: str) -> DataFrame:
    top = R.top_k_per_key(_live(s, d), ["company_id"], 5, F.desc_nulls_last("posted_at"), F.asc("job_id"))
    return top.select("company_id", "job_id", F.col("rank").cast("long").alias("rank"))


@query("latest_per_key", "SELECT user_id, arg_max(job_id, (applied_at, job_id)) AS job_id FROM applications WHERE applied_at IS NOT NULL GROUP BY ALL")
def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    sent = B.applications(s, d).where("applied_at is not null")
    return R.latest_per_key(sent, ["user_id"], F.desc("applied_at"), F.desc("job_id")).select("user_id", "job_id")


@query("default_resume", "SELECT user_id, skill_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY skill_id % 2 = 0 DESC, skill_id DESC) AS k FROM candidate_skills) WHERE k = 1")
def default_resume(s: SparkSession, d: str) -> DataFrame:
    return R.latest_per_key(B.candidate_skills(s, d), ["user_id"], (F.col("skill_id") % 2 == 0).desc(), F.desc("skill_id"))


@query("preferred_model_anchor", "SELECT company_id, job_id FROM (SELECT company_id, job_id, row_number() OVER (PARTITION BY company_id ORDER BY job_id % 3 = 0 DESC, job_id DESC) AS k FROM job_vectors) WHERE k = 1")
def preferred_model_anchor(s: SparkSession, d: str) -> DataFrame:
    return R.latest_per_key(B.job_vectors(s, d), ["company_id"], (F.col("job_id") % 3 == 0).desc(), F.desc("job_id")).select("company_id", "job_id")


@query("primary_successor", "SELECT company_id, arg_max(job_id, (posted_at, job_id)) AS successor FROM jobs GROUP BY ALL")
def primary_successor(s: SparkSession, d: str) -> DataFrame:
    return R.primary_successor(B.jobs(s, d), "company_id", "job_id", "posted_at")


@query("next_version_number", """SELECT job_id, n + row_number() OVER (PARTITION BY company_id ORDER BY job_id) AS version FROM (SELECT * FROM jobs WHERE status = 'ACTIVE')
  JOIN (SELECT company_id, count(*) FILTER (status <> 'ACTIVE') AS n FROM jobs GROUP BY ALL) USING (company_id)""")
def next_version_number(s: SparkSession, d: str) -> DataFrame:
    jobs = B.jobs(s, d).select("job_id", "company_id", "status")
    old = jobs.where("status <> 'ACTIVE'").groupBy("company_id").agg(F.count("*").alias("version"))
    return R.next_version_number(jobs.where("status = 'ACTIVE'"), old, "company_id", "version", "job_id").select("job_id", "version")


@query("canonical_posting", f"""SELECT doc_id AS job_id, CASE WHEN first_id <> doc_id THEN first_id END AS canonical_job_id
  FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {NORMAL_HASH_SQL}) AS first_id FROM documents)""")
def canonical_posting(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("job_id"), F.lit("ACTIVE").alias("status"), F.lit(0).alias("posted_at"), T.content_hash(F.col("text")).alias("content_hash"))
    return R.canonical_posting(docs)


@query("stable_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || 'salt'), doc_id LIMIT 40")
def stable_sample(s: SparkSession, d: str) -> DataFrame:
    return R.stable_sample(table(s, d, "documents"), "doc_id", "salt", 40).select("doc_id")


@query("seeded_shuffle_rank", "SELECT job_id, row_number() OVER (PARTITION BY company_id ORDER BY sha256('7' || CAST(job_id AS VARCHAR)), job_id) AS rank FROM jobs")
def seeded_shuffle_rank(s: SparkSession, d: str) -> DataFrame:
    return R.seeded_shuffle_rank(B.jobs(s, d), "job_id", "7", ["company_id"]).select("job_id", F.col("rank").cast("long").alias("rank"))


@query("tied_ranks", "SELECT job_id, rank() OVER (PARTITION BY company_id ORDER BY min_years) + (count(*) OVER (PARTITION BY company_id, min_years) - 1) / 2 AS tied_rank FROM jobs")
def tied_ranks(s: SparkSession, d: str) -> DataFrame:
    return B.jobs(s, d).select("job_id", R.tied_ranks("min_years", ["company_id"]))


@query("top_k_pool", """, scores AS (SELECT company_id, job_id, 'salary' AS ranker, coalesce(salary_max, 0) AS score FROM jobs UNION ALL SELECT company_id, job_id, 'years', min_years FROM jobs)
  SELECT company_id, job_id, array_to_string(list_sort(list(ranker)), ',') AS rankers FROM (SELECT *, row_number() OVER (PARTITION BY company_id, ranker ORDER BY score DESC, job_id) AS k FROM scores) WHERE k <= 15 GROUP BY ALL""")
def top_k_pool(s: SparkSession, d: str) -> DataFrame:
    jobs = B.jobs(s, d)
    scores = jobs.select("company_id", "job_id", F.lit("salary").alias("ranker"), F.coalesce("salary_max", F.lit(0.0)).alias("score")).union(jobs.select("company_id", "job_id", F.lit("years"), F.col("min_years").cast("double")))
    return R.top_k_pool(scores, "company_id", "job_id", "ranker", "score", 15).withColumn("rankers", F.array_join("rankers", ","))


@query("skill_display_order", "SELECT job_id, skill_id, row_number() OVER (PARTITION BY job_id ORDER BY requirement = 'REQUIRED' DESC, confidence DESC, name, skill_id) AS place FROM job_skills JOIN skills USING (skill_id)")
def skill_display_order(s: SparkSession, d: str) -> DataFrame:
    return L.display_order(B.job_skills(s, d), B.skills(s, d)).select("job_id", "skill_id", F.col("place").cast("long").alias("place"))


@query("career_order", "SELECT company_id, job_id, row_number() OVER (PARTITION BY company_id ORDER BY expires_at DESC NULLS LAST, posted_at DESC, job_id) AS place FROM jobs")
def career_order(s: SparkSession, d: str) -> DataFrame:
    return L.career_order(B.jobs(s, d), "company_id", "expires_at", "posted_at", "job_id").select("company_id", "job_id", F.col("place").cast("long").alias("place"))


@query("persona_dedupe", r"""SELECT arg_min(doc_id, (-length(text), doc_id)) AS doc_id FROM documents GROUP BY substring(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), 1, 400)""")
def persona_dedupe(s: SparkSession, d: str) -> DataFrame:
    return R.persona_dedupe(table(s, d, "documents"))
