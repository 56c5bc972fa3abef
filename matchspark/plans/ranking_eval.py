"""Offline evaluation over the given tables.

Rankers: the postings of each company (query) by salary or by years; graded labels 0 to 3 come from the ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators import evaluation as V
from matchspark.operators import lexical as X
from matchspark.operators import records as L
from matchspark.plans import base as B
from matchspark.plans.base import query, table
from matchspark.plans.matching import MATCH_SQL, match_breakdown
from matchspark.plans.matching import _matches as match_many
from matchspark.plans.parsing import STOP_SQL

SCORED_SQL = ", scored AS (SELECT company_id, job_id, coalesce(salary_max, 0) + min_years * 10000 AS score, (job_id * 7) % 4 AS label FROM jobs WHERE status = 'ACTIVE')"
RANKED_SQL = f"{SCORED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, job_id) AS rank FROM scored)"


def _scored(s: SparkSession, d: str) -> DataFrame:
    score = F.coalesce("salary_max", F.lit(0.0)) + F.col("min_years") * 10000
    return B.jobs(s, d).where("status = 'ACTIVE'").select("company_id", "job_id", score.alias("score"), (F.col("job_id") * 7 % 4).alias("label"))


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return V.ranked_labels(_scored(s, d), ["company_id"], "score", "job_id")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("ranked_labels", f"{RANKED_SQL} SELECT company_id, job_id, label, rank FROM ranked")
def ranked_labels(s: SparkSession, d: str) -> DataFrame:
    return _ranked(s, d).select("company_id", "job_id", "label", F.col("rank").cast("long").alias("rank"))


@query("precision_at_k", f"{RANKED_SQL} SELECT company_id, CASE WHEN count(*) >= 10 THEN count(*) FILTER (rank <= 10 AND label >= 2) / 10 END AS precision_at_10 FROM ranked GROUP BY ALL")
def precision_at_k(s: SparkSession, d: str) -> DataFrame:
    return V.precision_at_k(_ranked(s, d), ["company_id"], 10)


@query("ndcg_at_k", f"""{RANKED_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY label DESC, job_id) AS b FROM ranked)
  SELECT company_id, round(sum((pow(2, label) - 1) / log2(rank + 1)) FILTER (rank <= 10) / sum((pow(2, label) - 1) / log2(b + 1)) FILTER (b <= 10), 6) AS ndcg_at_10 FROM best GROUP BY ALL""")
def ndcg_at_k(s: SparkSession, d: str) -> DataFrame:
    return _round(V.ndcg_at_k(_ranked(s, d), ["company_id"], 10, "job_id"), "ndcg_at_10")


@query("reciprocal_rank", f"{RANKED_SQL} SELECT company_id, round(coalesce(1 / min(rank) FILTER (label >= 2), 0), 6) AS reciprocal_rank FROM ranked GROUP BY ALL")
def reciprocal_rank(s: SparkSession, d: str) -> DataFrame:
    return _round(V.reciprocal_rank(_ranked(s, d), ["company_id"]), "reciprocal_rank")


@query("recall_curve", f"{RANKED_SQL} SELECT company_id, k, round(count(*) FILTER (label >= 2 AND rank <= k) / nullif(count(*) FILTER (label >= 2), 0), 6) AS recall FROM ranked, (VALUES (50), (100), (200), (300), (500)) t(k) GROUP BY ALL")
def recall_curve(s: SparkSession, d: str) -> DataFrame:
    return _round(V.recall_curve(_ranked(s, d), ["company_id"], [50, 100, 200, 300, 500]), "recall")


@query("spearman", f"""{SCORED_SQL}, tied AS (SELECT company_id, rank() OVER (PARTITION BY company_id ORDER BY score) + (count(*) OVER (PARTITION BY company_id, score) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY company_id ORDER BY label) + (count(*) OVER (PARTITION BY company_id, label) - 1) / 2 AS rb FROM scored) SELECT company_id, round(corr(ra, rb), 6) AS spearman FROM tied GROUP BY ALL""")
def spearman(s: SparkSession, d: str) -> DataFrame:
    return _round(V.spearman(_scored(s, d), ["company_id"], "score", "label"), "spearman")


@query("pearson", f"{SCORED_SQL} SELECT company_id, round(corr(score, label), 6) AS pearson FROM scored GROUP BY ALL")
def pearson(s: SparkSession, d: str) -> DataFrame:
    return _round(V.pearson(_scored(s, d), ["company_id"], "score", "label"), "pearson")


@query("mean_absolute_error", f"{SCORED_SQL} SELECT company_id, round(avg(abs(score / 100000 - label)), 6) AS mae FROM scored GROUP BY ALL")
def mean_absolute_error(s: SparkSession, d: str) -> DataFrame:
    return _round(V.mean_absolute_error(_scored(s, d).withColumn("guess", F.col("score") / 100000), ["company_id"], "guess", "label"), "mae")


@query("threshold_sweep", """, sweep AS (SELECT t AS threshold, count(*) FILTER (truth AND score >= t) AS tp, count(*) FILTER (NOT truth AND score >= t) AS fp, count(*) FILTER (truth AND score < t) AS fn, count(*) FILTER (NOT truth AND score < t) AS tn
  FROM (SELECT confidence AS score, requirement = 'REQUIRED' AS truth FROM job_skills), (VALUES (0.2::DOUBLE), (0.5), (0.8), (0.95), (1.5)) v(t) GROUP BY ALL)
  SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM sweep""")
def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    judged = B.job_skills(s, d).withColumn("truth", F.col("requirement") == "REQUIRED")
    return _round(V.threshold_sweep(judged, "confidence", "truth", [0.2, 0.5, 0.8, 0.95, 1.5]), "precision", "recall", "f1")


TOKENS_SQL = rf", tokens AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9+#.]+'), lambda w: NOT list_contains({STOP_SQL}, w))) AS token FROM documents), asked AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9+#.]+'), lambda w: NOT list_contains({STOP_SQL}, w))) AS token FROM benchmark)"


@query("tfidf_rank", f"""{TOKENS_SQL}, tf AS (SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY ALL), idf AS (SELECT token, ln(((SELECT count(DISTINCT doc_id) FROM tokens) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY ALL),
  dw AS (SELECT doc_id, token, (1 + ln(n)) * idf AS w FROM tf JOIN idf USING (token)), qw AS (SELECT item_id, token, (1 + ln(n)) * idf AS w FROM (SELECT item_id, token, count(*) AS n FROM asked GROUP BY ALL) JOIN idf USING (token)),
  scores AS (SELECT item_id, doc_id, sum(q.w * d.w) AS dot FROM qw q JOIN dw d USING (token) GROUP BY ALL),
  final AS (SELECT item_id, doc_id, round(dot / (nq * nd), 6) AS score FROM scores JOIN (SELECT item_id, sqrt(sum(w * w)) AS nq FROM qw GROUP BY ALL) USING (item_id) JOIN (SELECT doc_id, sqrt(sum(w * w)) AS nd FROM dw GROUP BY ALL) USING (doc_id))
  SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM final) WHERE rank <= 10""")
def tfidf_rank(s: SparkSession, d: str) -> DataFrame:
    best = X.tfidf_rank(table(s, d, "benchmark"), table(s, d, "documents"), "item_id", "doc_id")
    return best.withColumn("rank", F.col("rank").cast("long"))


PRED_SQL = ", predicted AS (SELECT job_id, skill_id FROM job_skills WHERE (job_id + skill_id) % 5 <> 0 UNION SELECT job_id, skill_id + 1 FROM job_skills WHERE skill_id % 7 = 0), gold AS (SELECT job_id, skill_id FROM job_skills)"


def _sets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    gold = B.job_skills(s, d).select("job_id", "skill_id")
    extra = gold.where("skill_id % 7 = 0").select("job_id", (F.col("skill_id") + 1).alias("skill_id"))
    return gold.where("(job_id + skill_id) % 5 <> 0").union(extra).distinct(), gold


@query("set_prf", f"""{PRED_SQL}, n AS (SELECT coalesce(p.job_id, g.job_id) AS job_id, count(p.job_id) AS np, count(g.job_id) AS ng, count(*) FILTER (p.job_id IS NOT NULL AND g.job_id IS NOT NULL) AS hits
  FROM predicted p FULL JOIN gold g ON p.job_id = g.job_id AND p.skill_id = g.skill_id GROUP BY ALL), r AS (SELECT job_id, hits, CASE WHEN np > 0 THEN hits / np WHEN ng = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN ng > 0 THEN hits / ng ELSE 1.0 END AS r FROM n)
  SELECT job_id, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r""")
def set_prf(s: SparkSession, d: str) -> DataFrame:
    return _round(V.set_prf(*_sets(s, d), "job_id", "skill_id"), "precision", "recall", "f1")


@query("extraction_errors", f"""{PRED_SQL} SELECT 'false_positive' AS kind, skill_id, count(*) AS n FROM (SELECT * FROM predicted EXCEPT SELECT * FROM gold) GROUP BY ALL
  UNION ALL SELECT 'false_negative', skill_id, count(*) FROM (SELECT * FROM gold EXCEPT SELECT * FROM predicted) GROUP BY ALL""")
def extraction_errors(s: SparkSession, d: str) -> DataFrame:
    return V.extraction_errors(*_sets(s, d), "job_id", "skill_id")


@query("length_baseline", """, marks AS (SELECT conv_id, turn, length(text) AS n, length(text) % 101 / 100.0 AS mark FROM conversations),
  l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n, turn) AS k FROM marks), m AS (SELECT conv_id, mark, row_number() OVER (PARTITION BY conv_id ORDER BY mark, turn) AS k FROM marks)
  SELECT conv_id, turn, round(avg(m.mark) OVER (PARTITION BY conv_id, n), 6)::DOUBLE AS guess FROM l JOIN m USING (conv_id, k)""")
def length_baseline(s: SparkSession, d: str) -> DataFrame:
    marks = table(s, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"), (F.length("text") % 101 / 100.0).alias("mark"))
    return _round(V.length_baseline(marks, ["conv_id"], "turn", "n", "mark"), "guess")


@query("constant_baseline", f"{SCORED_SQL} SELECT job_id, round(avg(label) OVER (), 6) AS guess FROM scored")
def constant_baseline(s: SparkSession, d: str) -> DataFrame:
    return _round(V.constant_baseline(_scored(s, d), "label").select("job_id", "guess"), "guess")


@query("ablate", f"""{MATCH_SQL}, total AS (SELECT user_id, job_id, sum(score * weight) AS s, sum(weight) AS w FROM contributions GROUP BY ALL)
  SELECT user_id, job_id, dimension AS dropped, round((s - score * weight) / (w - weight), 6) AS score FROM contributions JOIN total USING (user_id, job_id)""")
def ablate(s: SparkSession, d: str) -> DataFrame:
    return _round(V.ablate(match_breakdown(s, d), ["user_id"], "job_id"), "score")


@query("ablation_ndcg", f"""{MATCH_SQL}, total AS (SELECT user_id, job_id, sum(score * weight) AS s, sum(weight) AS w FROM contributions GROUP BY ALL),
  scored_ AS (SELECT user_id, job_id, dimension AS dropped, round((s - score * weight) / (w - weight), 6) AS score FROM contributions JOIN total USING (user_id, job_id) UNION ALL SELECT user_id, job_id, 'none', overall FROM matches),
  ranked_ AS (SELECT *, job_id % 4 AS label, row_number() OVER (PARTITION BY user_id, dropped ORDER BY score DESC, job_id) AS r, row_number() OVER (PARTITION BY user_id, dropped ORDER BY job_id % 4 DESC, job_id) AS b FROM scored_),
  each_ AS (SELECT user_id, dropped, sum((2 ** label - 1) / log2(r + 1)) FILTER (r <= 10) / nullif(sum((2 ** label - 1) / log2(b + 1)) FILTER (b <= 10), 0) AS n FROM ranked_ GROUP BY ALL), mean_ AS (SELECT dropped, avg(n) AS ndcg FROM each_ GROUP BY ALL)
  SELECT dropped, round(ndcg, 6) AS ndcg, round(ndcg - (SELECT ndcg FROM mean_ WHERE dropped = 'none'), 6) AS change FROM mean_""")
def ablation_ndcg(s: SparkSession, d: str) -> DataFrame:
    full = match_many(s, d).select("user_id", "job_id", F.col("overall").alias("score"))
    labels = B.job_vectors(s, d).select("job_id", (F.col("job_id") % 4).alias("label"))
    return _round(V.ablation_ndcg(ablate(s, d), full, labels, ["user_id"], "job_id"), "ndcg", "change")


@query("pair_digest", "SELECT sha256(concat_ws('|', count(*), bit_xor(('0x' || h[1:15])::BIGINT), bit_xor(('0x' || h[16:30])::BIGINT), bit_xor(('0x' || h[31:45])::BIGINT), bit_xor(('0x' || h[46:60])::BIGINT)))[1:12] AS digest FROM (SELECT DISTINCT sha256(CAST(doc_id AS VARCHAR) || '|' || CAST(quality AS VARCHAR)) AS h FROM labels)")
def pair_digest(s: SparkSession, d: str) -> DataFrame:
    return V.pair_digest(table(s, d, "labels"), F.col("doc_id").cast("string"), F.col("quality").cast("string"))


@query("agreement_report", """SELECT lang, count(*) AS n, round(avg(abs(quality - toxic)), 6) AS mae, round(avg(quality) - avg(toxic), 6) AS gap, round(corr(quality, toxic), 6) AS pearson
  FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def agreement_report(s: SparkSession, d: str) -> DataFrame:
    both = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    base = both.groupBy("lang").agg(F.count("*").alias("n"), (F.avg("quality") - F.avg("toxic")).alias("gap"))
    out = base.join(V.mean_absolute_error(both, ["lang"], "quality", "toxic"), "lang").join(V.pearson(both, ["lang"], "quality", "toxic"), "lang")
    return _round(out, "mae", "gap", "pearson")


@query("duplicate_pool_stats", """, pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.source = b.source AS same_source, sha256(a.text) = sha256(b.text) AS same_hash, substring(a.text, 1, 300) = substring(b.text, 1, 300) AS same_opening
  FROM documents a JOIN documents b ON substring(a.text, 1, 40) = substring(b.text, 1, 40) AND a.doc_id < b.doc_id)
  SELECT count(*) AS pairs, count(*) FILTER (same_hash) AS duplicates, count(*) FILTER (same_source) AS same_source, count(*) FILTER (same_opening) AS same_opening, count(*) FILTER (same_opening AND NOT same_hash) AS opening_only FROM pairs""")
def duplicate_pool_stats(s: SparkSession, d: str) -> DataFrame:
    """Pairs of texts that open alike; texts are never paired with each other."""
    return L.pair_counts(table(s, d, "documents"), F.substring("text", 1, 40), F.sha2("text", 256), F.col("source"), F.substring("text", 1, 300))