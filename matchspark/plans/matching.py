"""Recall, near duplicates and the explainable match score over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.functions import scoring as S
from matchspark.functions import text as T
from matchspark.operators import demand as D
from matchspark.operators import matching as M
from matchspark.operators import postings as P
from matchspark.operators import records as L
from matchspark.plans import base as B
from matchspark.plans.base import as_of, query, table
from matchspark.session import written

#: The given vectors are random: their similarities need another span, floor and threshold than real ones.
SPAN, FLOOR, NEAR = (-0.25, 0.45), 0.2, 0.35
K = 50
#: What is added to a posting's id for a copy of it.
COPY = 100_000_000

COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
RELATED_SQL = """, related AS (
  SELECT DISTINCT user_id, parent_skill_id AS skill_id FROM candidate_skills JOIN skills USING (skill_id) WHERE parent_skill_id IS NOT NULL
  UNION SELECT DISTINCT user_id, s.skill_id FROM candidate_skills c JOIN skills s ON c.skill_id = s.parent_skill_id)"""
RECALL_SQL = f""", recall AS (SELECT user_id, job_id, similarity, place FROM (
  SELECT a.user_id, b.job_id, {COS} AS similarity, row_number() OVER (PARTITION BY a.user_id ORDER BY {COS} DESC, b.job_id) AS place
  FROM candidate_vectors a, job_vectors b WHERE b.job_id IN (SELECT job_id FROM live)) WHERE place <= {K})"""


def _live(s: SparkSession, d: str) -> DataFrame:
    return P.live_postings(B.jobs(s, d), as_of())


def _recall(s: SparkSession, d: str) -> DataFrame:
    items = B.job_vectors(s, d).join(_live(s, d).select("job_id"), "job_id", "left_semi")
    return M.top_k_similar(B.candidate_vectors(s, d), items, K, "user_id", "job_id")


@query("recall_top_k", f"{RECALL_SQL} SELECT user_id, job_id, round(similarity, 6) AS similarity, place FROM recall")
def recall_top_k(s: SparkSession, d: str) -> DataFrame:
    return _recall(s, d).select("user_id", "job_id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query("recall_availability", "SELECT user_id, CASE WHEN user_id NOT IN (SELECT user_id FROM candidate_skills) THEN 'NO_RESUME' WHEN user_id NOT IN (SELECT user_id FROM candidate_vectors) THEN 'PENDING' ELSE 'READY' END AS availability FROM candidates")
def recall_availability(s: SparkSession, d: str) -> DataFrame:
    return L.recall_availability(B.candidates(s, d), B.candidate_skills(s, d), B.candidate_vectors(s, d))


@query("similar_jobs", f"""SELECT * FROM (SELECT a.job_id AS anchor_id, b.job_id, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.job_id ORDER BY {COS} DESC, b.job_id) AS place
  FROM job_vectors a, job_vectors b WHERE a.job_id % 50 = 0 AND a.job_id <> b.job_id AND b.job_id IN (SELECT job_id FROM live) AND {COS} >= {FLOOR}) WHERE place <= 6""")
def similar_jobs(s: SparkSession, d: str) -> DataFrame:
    vectors = B.job_vectors(s, d)
    items = vectors.join(_live(s, d).select("job_id"), "job_id", "left_semi")
    anchors = vectors.where("job_id % 50 = 0").select(F.col("job_id").alias("anchor_id"), "embedding")  # the stated query set
    near = M.top_k_similar(anchors, items, 6, "anchor_id", "job_id", floor=FLOOR, not_self=True)
    return near.select("anchor_id", "job_id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query("pair_cosine", f"SELECT a.user_id, b.job_id, round({COS}, 6) AS cosine FROM candidate_vectors a JOIN job_vectors b ON b.job_id BETWEEN a.user_id + 1 AND a.user_id + 9")
def pair_cosine(s: SparkSession, d: str) -> DataFrame:
    users, items = B.candidate_vectors(s, d), B.job_vectors(s, d)
    pairs = users.select("user_id", F.explode(F.sequence(F.col("user_id") + 1, F.col("user_id") + 9)).alias("job_id")).join(items.select("job_id"), "job_id", "left_semi")
    return M.pair_cosine(pairs, users, items, "user_id", "job_id").select("user_id", "job_id", F.round("cosine", 6).alias("cosine"))


@query("same_model_vectors", "SELECT a.user_id, b.job_id FROM candidate_vectors a JOIN job_vectors b ON b.company_id = a.user_id % 10")
def same_model_vectors(s: SparkSession, d: str) -> DataFrame:
    users = B.candidate_vectors(s, d).select("user_id", "model", (F.col("user_id") % 10).cast("int").alias("company_id"))
    return L.same_model(users, B.job_vectors(s, d).select("job_id", "model", "company_id"), ["company_id"]).select("user_id", "job_id")


def _postings(s: SparkSession, d: str) -> DataFrame:
    named = B.job_vectors(s, d).join(table(s, d, "part").select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title")), "job_id")
    return named.select("job_id", "company_id", "title", "embedding")


GRAMS = r"""list_distinct(flatten([[ ('  ' || w || ' ')[i : i + 2] for i in generate_series(1, length(w) + 1)] for w in list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda v: v <> '')]))"""
TRIGRAM_SQL = "len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))".format(x=GRAMS.format("a.title"), y=GRAMS.format("b.title"))
NEAR_SQL = f""", all_postings AS (SELECT job_id, company_id, p_name AS title, embedding FROM job_vectors JOIN part ON p_partkey = job_id),
postings AS (SELECT min(job_id) AS job_id, company_id, title, embedding FROM all_postings GROUP BY ALL),
near AS (SELECT a.job_id AS a, b.job_id AS b, {COS} AS cosine, a.company_id = b.company_id AS shares_company, {TRIGRAM_SQL} >= 0.3 AS similar_title
  FROM postings a JOIN postings b ON a.job_id < b.job_id WHERE {COS} >= {NEAR} AND (a.company_id = b.company_id OR {TRIGRAM_SQL} >= 0.3))"""


@query("near_duplicate_pairs", f"{NEAR_SQL} SELECT a, b, round(cosine, 6) AS cosine, shares_company, similar_title FROM near")
def near_duplicate_pairs(s: SparkSession, d: str) -> DataFrame:
    return M.near_duplicate_pairs(_postings(s, d), NEAR).withColumn("cosine", F.round("cosine", 6)).drop("n_a", "n_b")


@query("near_duplicate_classes", f"""{NEAR_SQL}, sized AS (SELECT *, min(job_id) OVER w AS class_id, count(*) OVER w AS n FROM all_postings WINDOW w AS (PARTITION BY company_id, title, embedding)),
  both_ AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near)
  SELECT job_id, class_id, CAST(n - 1 + coalesce((SELECT sum(z.n) FROM both_ JOIN (SELECT DISTINCT class_id, n FROM sized) z ON z.class_id = b WHERE a = s.class_id), 0) AS BIGINT) AS n_links FROM sized s""")
def near_duplicate_classes(s: SparkSession, d: str) -> DataFrame:
    postings = _postings(s, d)
    return M.near_duplicate_classes(postings, M.near_duplicate_pairs(postings, NEAR))


@query("near_duplicates_of", f""", first_ AS (SELECT job_id, company_id, p_name AS title, embedding FROM job_vectors JOIN part ON p_partkey = job_id),
postings AS (SELECT * FROM first_ UNION ALL SELECT job_id + n * {COPY}, company_id, title, embedding FROM first_, range(1, 15) r(n) WHERE job_id % 7 = 0 AND (n = 1 OR job_id % 35 = 0)),
near AS (SELECT a.job_id AS job_id, b.job_id AS other_id, {COS} AS cosine FROM postings a JOIN postings b ON a.job_id <> b.job_id
  WHERE {COS} >= {NEAR} AND (a.company_id = b.company_id OR {TRIGRAM_SQL} >= 0.3))
SELECT * FROM (SELECT job_id, other_id, row_number() OVER (PARTITION BY job_id ORDER BY round(cosine, 9) DESC, other_id) AS place FROM near) WHERE place <= 10""")
def near_duplicates_of(s: SparkSession, d: str) -> DataFrame:
    """Every seventh posting has a copy, every 35th fourteen of them."""
    postings = _postings(s, d)
    repeated = postings.where("job_id % 7 = 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(14)))).where("_n = 1 or job_id % 35 = 0")
    postings = postings.unionByName(repeated.withColumn("job_id", F.col("job_id") + F.col("_n") * COPY).drop("_n"))
    pairs = M.near_duplicate_pairs(postings, NEAR).withColumn("cosine", F.round("cosine", 9))
    return M.near_duplicates_of(postings, pairs).select("job_id", "other_id", F.col("place").cast("long").alias("place"))


@query("trigram_similarity", f"SELECT a.p_partkey AS a, b.p_partkey AS b, round({TRIGRAM_SQL}, 6) AS similarity FROM (SELECT p_partkey, p_name, p_name AS title FROM part) a JOIN (SELECT p_partkey, p_name AS title FROM part) b ON b.p_partkey = a.p_partkey + 1")
def trigram_similarity(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    a, b = part.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")), part.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(T.trigram_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("l2_normalize", "SELECT vec_id, round(sqrt(list_sum([x * x for x in [v / sqrt(list_sum([w * w for w in embedding::DOUBLE[]])) for v in embedding::DOUBLE[]]])), 6) AS norm FROM embeddings")
def l2_normalize(s: SparkSession, d: str) -> DataFrame:
    unit = M.l2_normalize(F.col("embedding"))
    return table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


# --- the score ----------------------------------------------------------------------------------------------------

BUCKETS_SQL = f"""{RELATED_SQL}{RECALL_SQL}, buckets AS (SELECT r.user_id, r.job_id, j.skill_id, requirement,
  CASE WHEN c.skill_id IS NOT NULL THEN 'MATCHED' WHEN x.skill_id IS NOT NULL THEN 'PARTIAL' ELSE 'MISSING' END AS bucket
  FROM recall r JOIN job_skills j USING (job_id) LEFT JOIN candidate_skills c ON c.user_id = r.user_id AND c.skill_id = j.skill_id LEFT JOIN related x ON x.user_id = r.user_id AND x.skill_id = j.skill_id)"""
SKILL_SQL = f"""{BUCKETS_SQL}, demand AS (SELECT s.skill_id, round(coalesce(n, 0) / (SELECT count(*) FROM live), 4) AS demand_score FROM skills s
  LEFT JOIN (SELECT skill_id, count(DISTINCT job_id) AS n FROM job_skills JOIN live USING (job_id) GROUP BY ALL) USING (skill_id)),
weighed AS (SELECT *, CASE requirement WHEN 'REQUIRED' THEN 1.0 ELSE 0.5 END * coalesce(-ln(greatest(demand_score, 0.01)), 1.0)::DOUBLE AS w,
  CASE bucket WHEN 'MATCHED' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 ELSE 0.0 END::DOUBLE AS m FROM buckets LEFT JOIN demand USING (skill_id)),
skill_scores AS (SELECT user_id, job_id, sum(w * m) / sum(w) AS skill, count(*) FILTER (bucket = 'MATCHED') AS n_matched, count(*) FILTER (bucket = 'PARTIAL') AS n_partial, count(*) FILTER (bucket = 'MISSING') AS n_missing FROM weighed GROUP BY ALL)"""
MATCH_SQL = f"""{SKILL_SQL}, wide AS (SELECT r.*, c.years, c.education_rank, c.wants_remote, c.will_relocate, c.country_code AS home, c.min_salary * 30 AS floor, c.salary_currency AS floor_currency,
  j.min_years, j.max_years, j.country_code, j.work_mode, j.salary_max, j.salary_currency, j.salary_period, j.job_id % 6 AS need, CASE WHEN r.user_id IN (SELECT user_id FROM candidate_skills) THEN k.skill END AS raw_skill, n_matched, n_partial, n_missing
  FROM recall r JOIN candidates c USING (user_id) JOIN jobs j USING (job_id) LEFT JOIN skill_scores k ON k.user_id = r.user_id AND k.job_id = r.job_id),
dims AS (SELECT *, round_even(greatest(0.0, least(1.0, (similarity - -0.25) / 0.7)), 4) AS semantic,
  CASE WHEN raw_skill IS NULL THEN 0.5 ELSE round_even(raw_skill, 4) END AS skill,
  CASE WHEN years IS NULL THEN 0.5 WHEN years < min_years THEN round_even(greatest(0.0, 1 - (min_years - years) / min_years), 4) WHEN years > max_years THEN round_even(greatest(0.7, 1 - 0.05 * (years - max_years)), 4) ELSE 1.0 END AS experience,
  CASE WHEN education_rank >= need THEN 1.0 WHEN education_rank = need - 1 THEN 0.6 ELSE 0.2 END::DOUBLE AS education,
  CASE WHEN work_mode = 'REMOTE' AND wants_remote THEN 1.0 WHEN country_code IS NULL THEN 0.5 WHEN home = country_code AND will_relocate THEN 0.7 WHEN home = country_code THEN 0.3 ELSE 0.1 END::DOUBLE AS location,
  CASE WHEN salary_max IS NULL OR floor IS NULL OR salary_currency <> floor_currency OR salary_period IS NULL THEN 0.5
    ELSE round_even(least(1.0, salary_max * CASE salary_period WHEN 'YEARLY' THEN 1 ELSE 12 END / floor), 4) END AS salary,
  CAST(round(100 * (0.35 + CASE WHEN raw_skill IS NULL THEN 0 ELSE 0.25 END + CASE WHEN years IS NULL THEN 0 ELSE 0.15 END + 0.10
    + CASE WHEN work_mode = 'REMOTE' AND wants_remote THEN 0.10 WHEN country_code IS NULL THEN 0 ELSE 0.10 END
    + CASE WHEN salary_max IS NULL OR floor IS NULL OR salary_currency <> floor_currency OR salary_period IS NULL THEN 0 ELSE 0.05 END)) AS INTEGER) / 100 AS scored_weight FROM wide),
parts AS (SELECT user_id, job_id, unnest(['semantic', 'skill', 'experience', 'education', 'location', 'salary']) AS dimension, unnest([semantic, skill, experience, education, location, salary]::DOUBLE[]) AS score, unnest([35, 25, 15, 10, 10, 5]) AS w FROM dims),
tenths AS (SELECT user_id, job_id, dimension, score, w, CAST(round(score * 10000) AS BIGINT) * w AS x FROM parts),
contributions AS (SELECT user_id, job_id, dimension, score, w / 100 AS weight, x // 1000 + CASE WHEN x % 1000 > 500 OR (x % 1000 = 500 AND (x // 1000) % 2 = 1) THEN 1 ELSE 0 END AS t FROM tenths),
matches AS (SELECT d.user_id, d.job_id, semantic, skill, experience, education, location, salary, scored_weight, n_matched, n_partial, n_missing, overall FROM dims d
  JOIN (SELECT user_id, job_id, CAST(sum(t) AS DOUBLE) / 10 AS overall FROM contributions GROUP BY ALL) USING (user_id, job_id))"""


@query("match_partition", f"{BUCKETS_SQL} SELECT * FROM buckets")
def match_partition(s: SparkSession, d: str) -> DataFrame:
    return M.match_partition(_recall(s, d), B.job_skills(s, d), B.candidate_skills(s, d), B.skills(s, d))


_LIST_SQL = ", ".join(f"coalesce(string_agg(name, ';' ORDER BY requirement <> 'REQUIRED', name, skill_id) FILTER (bucket = '{b}'), '') AS {b.lower()}" for b in ("MATCHED", "PARTIAL", "MISSING"))


@query("match_lists", f"{BUCKETS_SQL} SELECT user_id, job_id, {_LIST_SQL} FROM buckets JOIN skills USING (skill_id) GROUP BY ALL")
def match_lists(s: SparkSession, d: str) -> DataFrame:
    lists = M.match_lists(match_partition(s, d), B.skills(s, d))
    return lists.select("user_id", "job_id", *(F.array_join(c, ";").alias(c) for c in ("matched", "partial", "missing")))


def _skill_scores(s: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    demand = D.skill_demand(_live(s, d), B.job_skills(s, d), B.skills(s, d))
    return M.skill_score(M.match_partition(pairs, B.job_skills(s, d), B.candidate_skills(s, d), B.skills(s, d)), demand)


@query("score_skill", f"{SKILL_SQL} SELECT user_id, job_id, round(skill, 4) AS skill, n_matched, n_partial, n_missing FROM skill_scores")
def score_skill(s: SparkSession, d: str) -> DataFrame:
    return _skill_scores(s, d, _recall(s, d)).withColumn("skill", F.round("skill", 4))


def _matches(s: SparkSession, d: str, lists: bool = False) -> DataFrame:
    """Recall, then all six dimensions for each recalled pair; the vectors stay behind in the recall, which runs once."""
    pairs = written(_recall(s, d).select("user_id", "job_id", "similarity"))
    people = B.candidates(s, d).select("user_id", "years", "education_rank", "wants_remote", "will_relocate", F.col("country_code").alias("home"), (F.col("min_salary") * 30).alias("floor"), F.col("salary_currency").alias("floor_currency"))
    demand = D.skill_demand(_live(s, d), B.job_skills(s, d), B.skills(s, d))
    return M.match(pairs, people, B.jobs(s, d), B.job_skills(s, d), B.candidate_skills(s, d), B.skills(s, d), demand, SPAN, as_of(), lists)


@query("match_many", f"""{MATCH_SQL}, lists AS (SELECT user_id, job_id, {_LIST_SQL} FROM buckets JOIN skills USING (skill_id) GROUP BY ALL)
SELECT m.*, CASE WHEN n_matched IS NULL THEN 'NEEDS_DATA' WHEN m.user_id NOT IN (SELECT user_id FROM candidate_skills) THEN 'NEEDS_PROFILE' ELSE 'SCORED' END AS skill_status,
  matched, partial, missing, 'v1' AS ranking_version, '{B.AS_OF} 00:00:00' AS computed_at FROM matches m LEFT JOIN lists USING (user_id, job_id)""")
def match_many(s: SparkSession, d: str) -> DataFrame:
    out = _matches(s, d, lists=True)
    lists = (F.array_join(c, ";").alias(c) for c in ("matched", "partial", "missing"))
    return out.select("user_id", "job_id", *S.WEIGHTS, "scored_weight", "n_matched", "n_partial", "n_missing", "overall", "skill_status", *lists, "ranking_version", F.date_format("computed_at", "yyyy-MM-dd HH:mm:ss").alias("computed_at"))


@query("match_breakdown", f"{MATCH_SQL} SELECT user_id, job_id, dimension, score, weight, CAST(t AS DOUBLE) / 10 AS contribution FROM contributions")
def match_breakdown(s: SparkSession, d: str) -> DataFrame:
    return _matches(s, d).select("user_id", "job_id", F.inline(S.breakdown())).drop("status")


@query("recommend", f"""{MATCH_SQL} SELECT * FROM (SELECT user_id, job_id, overall, scored_weight, row_number() OVER (PARTITION BY user_id ORDER BY overall DESC, job_id) AS rank,
  count(*) OVER (PARTITION BY user_id) AS total FROM matches m WHERE NOT EXISTS (SELECT 1 FROM applications p WHERE p.user_id = m.user_id AND p.job_id = m.job_id AND p.status = 'APPLIED')) WHERE rank <= 20""")
def recommend(s: SparkSession, d: str) -> DataFrame:
    """For every user with a vector: the first page of live postings not applied to, best match first."""
    applied = B.applications(s, d).where("status = 'APPLIED'")
    return M.recommend(_matches(s, d), applied).withColumn("rank", F.col("rank").cast("long"))


@query("score_experience", """SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 0.5 WHEN job_id % 13 < min_years THEN round_even(greatest(0.0, 1 - (min_years - job_id % 13) / min_years), 4)
  WHEN job_id % 13 > max_years THEN round_even(greatest(0.7, 1 - 0.05 * (job_id % 13 - max_years)), 4) ELSE 1.0 END::DOUBLE AS score,
  CASE WHEN job_id % 5 = 0 THEN 'NEEDS_PROFILE' ELSE 'SCORED' END AS status FROM jobs""")
def score_experience(s: SparkSession, d: str) -> DataFrame:
    k = F.col("job_id")
    score, status = S.experience(F.when(k % 5 != 0, k % 13), F.col("min_years"), F.col("max_years"))
    return B.jobs(s, d).select("job_id", score.alias("score"), status.alias("status"))


@query("score_education", """SELECT job_id, CASE WHEN job_id % 4 = 0 THEN 0.5 WHEN job_id % 5 >= job_id % 6 THEN 1.0 WHEN job_id % 5 = job_id % 6 - 1 THEN 0.6 ELSE 0.2 END::DOUBLE AS score FROM jobs""")
def score_education(s: SparkSession, d: str) -> DataFrame:
    k = F.col("job_id")
    return B.jobs(s, d).select("job_id", S.education(F.when(k % 4 != 0, k % 5), S.education_rank(F.col("min_education")))[0].alias("score"))


@query("score_salary", """SELECT job_id, CASE WHEN salary_max IS NULL OR salary_currency <> 'USD' OR salary_period IS NULL THEN 0.5
  ELSE round_even(least(1.0, salary_max * CASE salary_period WHEN 'YEARLY' THEN 1 ELSE 12 END / 400000), 4) END::DOUBLE AS score FROM jobs""")
def score_salary(s: SparkSession, d: str) -> DataFrame:
    score, _ = S.salary(F.lit(None).cast("double"), F.col("salary_max"), F.col("salary_currency"), F.col("salary_period"), F.lit(400000.0), F.lit("USD"))
    return B.jobs(s, d).select("job_id", score.alias("score"))


@query("to_yearly", "SELECT job_id, round(salary_max * CASE salary_period WHEN 'YEARLY' THEN 1 WHEN 'MONTHLY' THEN 12 END, 2) AS yearly FROM jobs WHERE salary_max IS NOT NULL")
def to_yearly(s: SparkSession, d: str) -> DataFrame:
    return B.jobs(s, d).where("salary_max is not null").select("job_id", F.round(S.to_yearly(F.col("salary_max"), F.col("salary_period")), 2).alias("yearly"))


@query("skill_rarity", """SELECT s.skill_id, round(-ln(greatest(round(coalesce(n, 0) / (SELECT count(*) FROM live), 4), 0.01)), 6) AS rarity FROM skills s
  LEFT JOIN (SELECT skill_id, count(DISTINCT job_id) AS n FROM job_skills JOIN live USING (job_id) GROUP BY ALL) USING (skill_id)""")
def skill_rarity(s: SparkSession, d: str) -> DataFrame:
    demand = D.skill_demand(_live(s, d), B.job_skills(s, d), B.skills(s, d))
    return demand.select("skill_id", F.round(S.skill_rarity(F.col("demand_score")), 6).alias("rarity"))


@query("reason_text", f"""{MATCH_SQL} SELECT user_id, job_id, CASE WHEN semantic >= 0.75 THEN 'A strong semantic match.' WHEN semantic >= 0.5 THEN 'A fair semantic match.'
  WHEN semantic >= 0.25 THEN 'A weak semantic match.' ELSE 'Little semantic match.' END AS reason FROM dims""")
def reason_text(s: SparkSession, d: str) -> DataFrame:
    score, status = S.semantic(F.col("similarity"), SPAN)
    return _recall(s, d).select("user_id", "job_id", S.reason_text(score, status, "semantic").alias("reason"))


@query("months_between_spans", """SELECT o_custkey AS user_id, nullif(round_even(sum(CASE WHEN months > 0 THEN months ELSE 0 END) / 12, 1), 0) AS years FROM (SELECT o_custkey,
  CASE WHEN o_orderkey % 3 = 0 THEN (2000 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) ELSE 7 END AS months FROM orders) GROUP BY ALL""")
def months_between_spans(s: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate").cast("date")
    spans = table(s, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.collect_list(F.struct(at.alias("start"), F.when(F.col("o_orderkey") % 3 != 0, F.add_months(F.trunc(at, "month"), 7)).alias("end"))).alias("spans"))
    return spans.select("user_id", S.months_between_spans(F.col("spans"), F.lit(B.AS_OF).cast("date")).alias("years"))
