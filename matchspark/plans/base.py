"""The query registry and the domain views over the given tables: once for Spark, once as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.session import dealt

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

AS_OF = "2000-01-01"
EDUCATION = ("NONE", "HIGH_SCHOOL", "DIPLOMA", "BACHELORS", "MASTERS", "DOCTORATE")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql goes on after the domain views, as a SELECT or as further `, name AS (...)` parts."""

    def add(f: Query) -> Query:
        REGISTRY[name] = (f, f"WITH {DOMAIN}{sql}" if sql else None)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


def skills(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("skill_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.when(k % 10 != 0, k - k % 10).alias("parent_skill_id"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    level = F.lit(None).cast("string")
    for i, name in enumerate(EDUCATION):
        level = F.when(k % 6 == i, name).otherwise(level)
    return table(spark, d, "orders").select(
        k.alias("job_id"),
        F.col("o_orderpriority").alias("title"),
        (F.col("o_custkey") % 50).alias("company_id"),
        F.when(F.col("o_orderstatus") != "F", "ACTIVE").otherwise("DUPLICATE").alias("status"),
        at.alias("posted_at"),
        F.when(k % 4 != 0, at + F.expr("interval 3 years")).alias("expires_at"),
        F.when(k % 5 == 0, F.col("o_totalprice")).alias("salary_max"),
        F.when(k % 2 == 0, "USD").otherwise("EUR").alias("salary_currency"),
        F.when(k % 3 == 0, "YEARLY").when(k % 3 == 1, "MONTHLY").alias("salary_period"),
        (k % 8).alias("min_years"),
        F.when(k % 3 != 0, k % 8 + 4).alias("max_years"),
        level.alias("min_education"),
        F.when(k % 7 != 0, F.format_string("N%02d", F.col("o_custkey") % 25)).alias("country_code"),
        F.when(k % 2 == 0, F.when(k % 4 == 0, "REMOTE").otherwise("HYBRID")).alias("work_mode"),
    )


def job_skills(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """One row for each (job, skill): lines that repeat a part are folded. With parts, dealt by job into so many."""
    return (
        dealt(table(spark, d, "lineitem"), parts, "l_orderkey")
        .groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id"))
        .agg(F.when(F.bool_or(F.col("l_returnflag") == "R"), "REQUIRED").otherwise("PREFERRED").alias("requirement"), (F.max("l_quantity") / 50).alias("confidence"))
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("user_id"),
        F.format_string("N%02d", F.col("c_nationkey")).alias("country_code"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("min_salary"),
        F.when(k % 2 == 0, "USD").otherwise("EUR").alias("salary_currency"),
        F.when(k % 7 != 0, k % 12).alias("years"),
        (k % 6).alias("education_rank"),
        (k % 4 == 0).alias("wants_remote"),
        (k % 3 == 0).alias("will_relocate"),
    )


def candidate_skills(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """Skills held: those of closed postings, so that open ones do not leak into them. With parts, dealt into so many."""
    closed = dealt(table(spark, d, "orders").where("o_orderstatus = 'F'"), parts, "o_orderkey")
    held = closed.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("skill_id"))
    return dealt(held, parts, "user_id", "skill_id").distinct()


def job_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding", F.col("label").alias("company_id"), F.lit("m").alias("model"))


def candidate_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: every vector whose id is divisible by 50, if a candidate has that id."""
    vectors = table(spark, d, "embeddings").where("vec_id % 50 = 0")
    return vectors.join(table(spark, d, "customer"), F.col("vec_id") == F.col("c_custkey"), "left_semi").select(F.col("vec_id").alias("user_id"), "embedding", F.lit("m").alias("model"))


def application_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "SAVED").when(kind == "click", "APPLIED").when(kind == "signup", "ASSESSMENT").when(kind == "purchase", "INTERVIEW").otherwise("REJECTED")
    return table(spark, d, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("job_id"),
        status.alias("to_status"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        "value",
    )


def applications(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each (user, job) is its state."""
    return application_events(spark, d).groupBy("user_id", "job_id").agg(
        F.max_by("to_status", F.struct("occurred_at", "event_id")).alias("status"),
        F.min(F.when(F.col("to_status") != "SAVED", F.col("occurred_at"))).alias("applied_at"),
        F.count("*").alias("n_events"),
    )


DOMAIN = """
skills AS (SELECT p_partkey AS skill_id, p_name AS name, p_type AS category,
  CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - p_partkey % 10 END AS parent_skill_id FROM part),
jobs AS (SELECT o_orderkey AS job_id, o_orderpriority AS title, o_custkey % 50 AS company_id,
  CASE WHEN o_orderstatus <> 'F' THEN 'ACTIVE' ELSE 'DUPLICATE' END AS status, o_orderdate AS posted_at,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 3 YEAR END AS expires_at,
  CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END AS salary_max,
  CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS salary_currency,
  CASE o_orderkey % 3 WHEN 0 THEN 'YEARLY' WHEN 1 THEN 'MONTHLY' END AS salary_period,
  o_orderkey % 8 AS min_years, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 8 + 4 END AS max_years,
  ['NONE', 'HIGH_SCHOOL', 'DIPLOMA', 'BACHELORS', 'MASTERS', 'DOCTORATE'][o_orderkey % 6 + 1] AS min_education,
  CASE WHEN o_orderkey % 7 <> 0 THEN printf('N%02d', o_custkey % 25) END AS country_code,
  CASE WHEN o_orderkey % 4 = 0 THEN 'REMOTE' WHEN o_orderkey % 2 = 0 THEN 'HYBRID' END AS work_mode FROM orders),
job_skills AS (SELECT l_orderkey AS job_id, l_partkey AS skill_id,
  CASE WHEN bool_or(l_returnflag = 'R') THEN 'REQUIRED' ELSE 'PREFERRED' END AS requirement, max(l_quantity) / 50 AS confidence
  FROM lineitem GROUP BY ALL),
candidates AS (SELECT c_custkey AS user_id, printf('N%02d', c_nationkey) AS country_code,
  CASE WHEN c_acctbal > 0 THEN c_acctbal END AS min_salary, CASE WHEN c_custkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS salary_currency,
  CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 12 END AS years, c_custkey % 6 AS education_rank,
  c_custkey % 4 = 0 AS wants_remote, c_custkey % 3 = 0 AS will_relocate FROM customer),
candidate_skills AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS skill_id
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'),
job_vectors AS (SELECT vec_id AS job_id, embedding, label AS company_id FROM embeddings),
candidate_vectors AS (SELECT vec_id AS user_id, embedding FROM embeddings WHERE vec_id % 50 = 0 AND vec_id IN (SELECT c_custkey FROM customer)),
application_events AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id,
  CASE event_type WHEN 'view' THEN 'SAVED' WHEN 'click' THEN 'APPLIED' WHEN 'signup' THEN 'ASSESSMENT' WHEN 'purchase' THEN 'INTERVIEW' ELSE 'REJECTED' END AS to_status,
  ts AS occurred_at, value FROM events),
applications AS (SELECT user_id, job_id, arg_max(to_status, (occurred_at, event_id)) AS status,
  min(occurred_at) FILTER (to_status <> 'SAVED') AS applied_at, count(*) AS n_events FROM application_events GROUP BY ALL),
live AS (SELECT * FROM jobs WHERE status = 'ACTIVE' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2000-01-01'))
"""
