"""Merges, set differences and plans over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.functions import text as T
from matchspark.operators import merges as M
from matchspark.operators import planning as N
from matchspark.operators import records as L
from matchspark.plans import base as B
from matchspark.plans.base import query, table
from matchspark.plans.market import GAPS_SQL, skill_gaps
from matchspark.plans.parsing import FOLD


def _old(s: SparkSession, d: str) -> DataFrame:
    return B.job_skills(s, d).where("job_id % 3 <> 0").select("job_id", "skill_id", "confidence", F.lit(0).alias("version"))


def _new(s: SparkSession, d: str) -> DataFrame:
    return B.job_skills(s, d).where("job_id % 2 = 0").select("job_id", "skill_id", (F.col("confidence") / 2).alias("confidence"), F.lit(1).alias("version"))


OLD_NEW_SQL = ", old AS (SELECT job_id, skill_id, confidence, 0 AS version FROM job_skills WHERE job_id % 3 <> 0), new AS (SELECT job_id, skill_id, confidence / 2 AS confidence, 1 AS version FROM job_skills WHERE job_id % 2 = 0)"


@query("merge_vectors", f"{OLD_NEW_SQL} SELECT * FROM new UNION ALL SELECT * FROM old WHERE job_id % 2 <> 0")
def merge_vectors(s: SparkSession, d: str) -> DataFrame:
    return M.keyed_merge(_old(s, d), _new(s, d), ["job_id", "skill_id"])


@query("merge_extracted_skills", f"{OLD_NEW_SQL} SELECT * FROM new WHERE job_id % 3 = 0 OR NOT skill_id % 5 = 0 UNION ALL SELECT * FROM old WHERE job_id % 2 <> 0 OR skill_id % 5 = 0")
def merge_extracted_skills(s: SparkSession, d: str) -> DataFrame:
    return M.keyed_merge(_old(s, d), _new(s, d), ["job_id", "skill_id"], guard=F.col("skill_id") % 5 == 0)


@query("merge_career_rows", f"{OLD_NEW_SQL} SELECT * FROM new UNION ALL SELECT * FROM old WHERE job_id % 2 <> 0 AND skill_id % 4 = 0")
def merge_career_rows(s: SparkSession, d: str) -> DataFrame:
    """New rows replace old ones; old rows that are not verified and no longer found go."""
    merged = M.keyed_merge(_old(s, d), _new(s, d), ["job_id", "skill_id"])
    gone = M.stale_rows(_old(s, d).withColumn("k", F.struct("job_id", "skill_id")), _new(s, d).select(F.struct("job_id", "skill_id").alias("k")), "k", F.col("skill_id") % 4 == 0)
    return merged.join(gone.select("job_id", "skill_id"), ["job_id", "skill_id"], "left_anti")


@query("stale_rows", f"{OLD_NEW_SQL} SELECT job_id, skill_id FROM old WHERE job_id % 2 <> 0 AND skill_id % 4 <> 0")
def stale_rows(s: SparkSession, d: str) -> DataFrame:
    key = F.struct("job_id", "skill_id").alias("k")
    return M.stale_rows(_old(s, d).select("*", key), _new(s, d).select(key), "k", F.col("skill_id") % 4 == 0).select("job_id", "skill_id")


@query("merge_taxonomy", "SELECT skill_id, s.name, coalesce(n.category, s.category) AS category, coalesce(parent_skill_id, parent) AS parent_skill_id FROM skills s LEFT JOIN (SELECT p_name AS name, max(p_brand) AS category, min(p_partkey) AS parent FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name) n USING (name)")
def merge_taxonomy(s: SparkSession, d: str) -> DataFrame:
    new = table(s, d, "part").where("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("name")).agg(F.max("p_brand").alias("category"), F.min("p_partkey").alias("parent_skill_id"))
    return M.merge_taxonomy(B.skills(s, d), new)


@query("replace_job_skills", f"{OLD_NEW_SQL} SELECT * FROM new UNION ALL SELECT * FROM old WHERE job_id NOT IN (SELECT job_id FROM new)")
def replace_job_skills(s: SparkSession, d: str) -> DataFrame:
    return M.replace_job_skills(_old(s, d), _new(s, d))


@query("merge_application", """, latest AS (SELECT user_id, job_id, arg_max(to_status, (occurred_at, event_id)) AS status, arg_max(value, (occurred_at, event_id)) AS score FROM application_events GROUP BY ALL)
  SELECT user_id, job_id, CASE WHEN user_id % 2 = 0 THEN 'SAVED' ELSE status END AS status, CASE WHEN user_id % 2 <> 0 AND status <> 'SAVED' THEN score END AS score FROM latest""")
def merge_application(s: SparkSession, d: str) -> DataFrame:
    last = F.struct("occurred_at", "event_id")
    old = B.application_events(s, d).groupBy("user_id", "job_id").agg(F.max_by("to_status", last).alias("status"), F.max_by("value", last).alias("score"))
    new = old.where("user_id % 2 = 0").withColumn("status", F.lit("SAVED"))
    return M.merge_application(old, new, ["user_id", "job_id"])


@query("merge_feedback", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS rating FROM events GROUP BY ALL")
def merge_feedback(s: SparkSession, d: str) -> DataFrame:
    """The first half of the events is there already, in its merged form; the rest comes in."""
    events = table(s, d, "events").select("user_id", F.col("event_type").alias("rating"), "ts", "event_id")
    there = L.merge_feedback(events.where("event_id % 2 = 0"), events.limit(0), ["user_id"], ["ts", "event_id"])
    return L.merge_feedback(there, events.where("event_id % 2 <> 0"), ["user_id"], ["ts", "event_id"]).select("user_id", "rating")


@query("fill_if_empty", """SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN country_code WHEN user_id % 2 = 0 THEN 'NX' END AS country_code, array_to_string(CASE WHEN user_id % 2 = 0 AND user_id % 3 = 0 THEN ['country_code'] ELSE [] END, ',') AS applied,
  array_to_string(CASE WHEN user_id % 2 = 0 AND user_id % 3 <> 0 THEN ['country_code'] ELSE [] END, ',') AS skipped FROM candidates""")
def fill_if_empty(s: SparkSession, d: str) -> DataFrame:
    profile = B.candidates(s, d).select("user_id", F.when(F.col("user_id") % 3 != 0, F.col("country_code")).alias("country_code"))
    found = B.candidates(s, d).where("user_id % 2 = 0").select("user_id", F.lit("NX").alias("country_code"))
    return M.fill_if_empty(profile, found, "user_id", ["country_code"]).withColumns({c: F.array_join(c, ",") for c in ("applied", "skipped")})


@query("attach_link", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url WHEN page_id % 3 = 0 THEN 'https://jobs.example.com/' || CAST(page_id AS VARCHAR) ELSE 'none' END AS url FROM pages")
def attach_link(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    postings = table(s, d, "pages").select("page_id", F.when(k % 2 == 0, F.col("url")).otherwise("none").alias("url"))
    links = table(s, d, "pages").where("page_id % 3 = 0").select("page_id", F.concat(F.lit("https://jobs.example.com/"), k).alias("url"))
    return M.attach_link(postings, links, "page_id")


@query("resolve_companies", f"SELECT sha256(n) AS company_id, n AS normalized_name, min(source) AS name FROM (SELECT source, {FOLD.format('source')} AS n FROM documents) WHERE n <> '' AND n <> 'src3' GROUP BY n")
def resolve_companies(s: SparkSession, d: str) -> DataFrame:
    known = s.createDataFrame([("src3",)], "normalized_name string")
    return M.resolve_companies(table(s, d, "documents"), known, "source")


@query("dedupe_on_external_id", "SELECT min(doc_id) AS doc_id FROM documents WHERE length(text) NOT IN (SELECT length(text) FROM documents WHERE doc_id % 10 = 0) AND doc_id % 10 <> 0 GROUP BY length(text)")
def dedupe_on_external_id(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", F.length("text").alias("external_id"))
    return M.dedupe_on_external_id(docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 = 0"), ["external_id"], "doc_id").select("doc_id")


@query("reuse_parse_by_hash", "SELECT n.doc_id, o.result FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1) n LEFT JOIN (SELECT sha256(text) AS h, max(doc_id) AS result FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL) o USING (h)")
def reuse_parse_by_hash(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.col("doc_id").alias("result"))
    return M.reuse_parse_by_hash(docs.where("doc_id % 2 = 1").select("doc_id", "h"), docs.where("doc_id % 2 = 0"), ["h"], "result", "doc_id").select("doc_id", "result")


@query("names_already_claimed", "SELECT DISTINCT o_custkey AS user_id, l_partkey AS skill_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' EXCEPT SELECT user_id, skill_id FROM candidate_skills")
def names_already_claimed(s: SparkSession, d: str) -> DataFrame:
    open_ = table(s, d, "orders").where("o_orderstatus <> 'F'").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return M.not_claimed(open_.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("skill_id")), B.candidate_skills(s, d), ["user_id", "skill_id"])


@query("candidate_pool_union", "SELECT job_id FROM (SELECT job_id FROM jobs ORDER BY salary_max DESC NULLS LAST, job_id LIMIT 50) UNION SELECT job_id FROM (SELECT job_id FROM jobs ORDER BY posted_at DESC, job_id LIMIT 50)")
def candidate_pool_union(s: SparkSession, d: str) -> DataFrame:
    return L.pool_union(B.jobs(s, d), "job_id", [[F.desc_nulls_last("salary_max")], [F.desc("posted_at")]], 50)


@query("unknown_terms", r"""SELECT doc_id, term, place FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY term) AS place FROM (SELECT DISTINCT doc_id, unnest(string_split(lang || ' ' || source, ' ')) AS term FROM documents) WHERE term NOT IN ('en', 'src1', 'src2')) WHERE place <= 50""")
def unknown_terms(s: SparkSession, d: str) -> DataFrame:
    terms = table(s, d, "documents").select("doc_id", F.explode(F.split(F.concat_ws(" ", "lang", "source"), " ")).alias("term")).distinct()
    forms = s.createDataFrame([("en",), ("src1",), ("src2",)], "term string")
    return M.unknown_terms(terms, forms, "doc_id").select("doc_id", "term", F.col("place").cast("long").alias("place"))


@query("reparse_delta", f"""{OLD_NEW_SQL} SELECT count(*) AS considered, count(*) FILTER (coalesce(a, 0) <> coalesce(b, 0)) AS changed, CAST(sum(coalesce(b, 0)) AS BIGINT) AS total_before, CAST(sum(coalesce(a, 0)) AS BIGINT) AS total_after,
  count(*) FILTER (coalesce(a, 0) < coalesce(b, 0)) AS lost FROM (SELECT job_id, count(*) AS b FROM old GROUP BY ALL) FULL JOIN (SELECT job_id, count(*) AS a FROM new GROUP BY ALL) USING (job_id)""")
def reparse_delta(s: SparkSession, d: str) -> DataFrame:
    count = lambda df: df.groupBy("job_id").agg(F.count("*").alias("n"))
    return M.delta_report(count(_old(s, d)), count(_new(s, d)), "job_id", "n")


@query("index_result", "SELECT count(*) AS considered, count(*) FILTER (length(trim(text)) < 80) AS too_short, count(*) FILTER (length(trim(text)) >= 80 AND doc_id % 2 = 0) AS skipped, count(*) FILTER (length(trim(text)) >= 80 AND doc_id % 2 <> 0) AS embedded FROM documents")
def index_result(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text", T.document_hash(F.col("text")).alias("hash"))
    indexed = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("hash")).otherwise("old").alias("hash"))
    return M.index_outcome(docs, indexed, "doc_id")


@query("prerequisite_depth", """, walk AS (SELECT skill_id, CAST(floor(log2(skill_id)) AS INTEGER) AS depth, [CAST(floor(skill_id / 2 ** i) AS BIGINT) for i in generate_series(0, 40)] AS above FROM skills WHERE skill_id >= 1)
  SELECT skill_id, CASE WHEN list_has_any(above, [4, 5]) THEN NULL ELSE depth END AS depth FROM walk""")
def prerequisite_depth(s: SparkSession, d: str) -> DataFrame:
    """Every part needs the one of half its number, and parts 4 and 5 need each other, so chains are as deep as the
    logarithm of the table, and what hangs on the cycle has no depth."""
    k = F.col("skill_id")
    halves = B.skills(s, d).where("skill_id > 1").select("skill_id", F.floor(k / 2).alias("needs"))
    cycle = s.createDataFrame([(4, 5), (5, 4)], "skill_id long, needs long")
    return N.prerequisite_depth(halves.union(cycle))


_PLAN_SQL = f"""{GAPS_SQL}, open AS (SELECT g.*, parent_skill_id AS need, CASE severity WHEN 'CRITICAL' THEN 0 ELSE 1 END AS sev FROM gaps g JOIN skills USING (skill_id)
    WHERE gap_status <> 'STRONG' AND severity IN ('CRITICAL', 'HIGH') AND skill_id % 9 <> 0),
  needed AS (SELECT o.*, CASE WHEN need IN (SELECT skill_id FROM open p WHERE p.user_id = o.user_id) THEN need END AS after_, skill_id % 5 = 0 AS completed FROM open o),
  walk AS (WITH RECURSIVE w AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::BIGINT[] AS placed FROM needed
    UNION ALL SELECT user_id, n + 1, list_append(placed, best) FROM (SELECT w.user_id, w.n, w.placed,
      arg_min(o.skill_id, (CASE WHEN o.after_ IS NULL OR o.after_ % 5 = 0 OR list_contains(w.placed, o.after_) THEN 0 ELSE 1 END, o.sev, -o.frequency, o.skill_id)) AS best
      FROM w JOIN needed o ON o.user_id = w.user_id AND NOT list_contains(w.placed, o.skill_id) GROUP BY ALL)) SELECT user_id, n, placed[n] AS skill_id FROM w WHERE n > 0)"""


@query("learning_plan", f"""{_PLAN_SQL} SELECT user_id, skill_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY NOT completed, n) AS INTEGER) AS step, completed, (skill_id % 40 + 8)::DOUBLE AS hours, coalesce(after_::VARCHAR, '') AS after
  FROM walk JOIN needed USING (user_id, skill_id)""")
def learning_plan(s: SparkSession, d: str) -> DataFrame:
    return _plan(s, d)[1].withColumn("after", F.array_join(F.transform("after", lambda x: x.cast("string")), " "))


@query("plan_totals", f"""{_PLAN_SQL}, asked_ AS (SELECT user_id, count(*) AS n FROM gaps WHERE gap_status <> 'STRONG' AND severity IN ('CRITICAL', 'HIGH') GROUP BY ALL),
  told AS (SELECT user_id, count(*) AS steps, sum(skill_id % 40 + 8)::DOUBLE AS total_hours, coalesce(sum(skill_id % 40 + 8) FILTER (NOT completed), 0)::DOUBLE AS remaining_hours FROM needed GROUP BY ALL)
  SELECT user_id, coalesce(steps, 0) AS steps, coalesce(total_hours, 0) AS total_hours, coalesce(remaining_hours, 0) AS remaining_hours, n - coalesce(steps, 0) AS skipped FROM asked_ LEFT JOIN told USING (user_id)""")
def plan_totals(s: SparkSession, d: str) -> DataFrame:
    return N.plan_totals(*_plan(s, d))


def _plan(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Gaps and plan: every ninth skill cannot be planned, every fifth is finished."""
    gaps = skill_gaps(s, d).where("gap_status <> 'STRONG' and severity in ('CRITICAL', 'HIGH')")
    skills = B.skills(s, d)
    needs = skills.where("parent_skill_id is not null").select("skill_id", F.col("parent_skill_id").alias("needs"))
    hours = skills.where("skill_id % 9 <> 0").select("skill_id", (F.col("skill_id") % 40 + 8).alias("hours"))
    return gaps, N.learning_plan(gaps, needs, hours, gaps.where("skill_id % 5 = 0").select("user_id", "skill_id"))


@query("adaptive_ladder", """, t AS (SELECT conv_id, turn, length(text) % 101 / 100.0 AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
  r AS (SELECT conv_id, list(CASE WHEN score < 0.4 THEN -1 WHEN score < 0.7 THEN 0 ELSE 1 END ORDER BY turn) AS s FROM t GROUP BY ALL)
  SELECT conv_id AS session_id, turn, CASE WHEN n >= 6 THEN 'FINISH' WHEN score < 0.4 THEN 'CLARIFY' WHEN score < 0.7 THEN 'CONTINUE' ELSE 'ADVANCE' END AS action,
  CAST(list_reduce(list_concat([1], s[1:n]), lambda a, b: least(3, greatest(0, a + b))) AS INTEGER) AS level FROM t JOIN r USING (conv_id)""")
def adaptive_ladder(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", (F.length("text") % 101 / 100.0).alias("score"))
    return N.adaptive_ladder(turns)
