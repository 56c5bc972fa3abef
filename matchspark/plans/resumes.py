"""Resumes whose lines come from the orders table: a customer is a resume, an order one entry of one kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators import careers
from matchspark.plans.base import query, table
from matchspark.session import parts_for

_PROSE = "It does a great many things for a great many people."


def resume_lines(s: SparkSession, d: str) -> DataFrame:
    """(user_id, section, line_no, line): each order gives some lines of the section that its key names."""
    k, c, at = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    say = lambda text, *args: F.format_string(text, *args)
    year = F.year(at)
    work: list[Column] = [say("Senior Engineer %d", k % 3), say("Acme%d Ltd | Pune, India", c % 50), F.concat(F.date_format(at, "MMM yyyy"), F.lit(" - Present")), F.concat(F.lit("- did things worth "), F.col("o_totalprice")), F.lit("  \t")]
    study = [say("B.Sc in Field%d | Acme College %d", k % 5, c % 20), say("%d - %d CGPA: 8.%d", year, year + 3, k % 10)]
    project = [say("Tool T%d", k), F.when(k % 8 == 2, _PROSE).otherwise(""), F.when(k % 3 == 0, say("- see https://example.org/p/%d", k)).otherwise(say("- part %d", k % 7)), F.lit("- more of it")]
    award = [say("- AWS Certified Expert %d, %d", k % 9, year)]
    lines = F.when(k % 4 == 0, F.array(*work)).when(k % 4 == 1, F.array(*study)).when(k % 4 == 2, F.array(*project)).otherwise(F.array(*award))
    section = F.when(k % 4 == 0, "EXPERIENCE").when(k % 4 == 1, "EDUCATION").when(k % 4 == 2, "PROJECTS").otherwise("CERTIFICATIONS")
    orders = table(s, d, "orders").select(c.alias("user_id"), section.alias("section"), k.alias("_k"), F.posexplode(lines).alias("_p", "line"))
    return orders.select("user_id", "section", (F.col("_k") * 8 + F.col("_p")).alias("line_no"), "line")


@query("career_entities", rf""", o AS (SELECT o_custkey AS user_id, o_orderkey AS k, o_orderdate AS at_, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey) AS block FROM orders),
  e AS (SELECT user_id, k, CASE k % 4 WHEN 0 THEN 'WORK' WHEN 1 THEN 'EDUCATION' WHEN 2 THEN 'PROJECT' ELSE 'CERTIFICATION' END AS kind,
    CASE k % 4 WHEN 0 THEN 'Senior Engineer ' || k % 3 WHEN 1 THEN 'Acme College ' || user_id % 20 WHEN 2 THEN 'Tool T' || k ELSE 'AWS Certified Expert ' || k % 9 END AS name,
    CASE k % 4 WHEN 0 THEN 'Acme' || user_id % 50 || ' Ltd' WHEN 3 THEN 'AWS' END AS organisation, CASE WHEN k % 4 = 0 THEN 'Pune, India' END AS location,
    CASE WHEN k % 4 = 1 THEN 'B.Sc in Field' || k % 5 END AS degree, CASE WHEN k % 4 = 1 THEN 'Field' || k % 5 END AS field_of_study, CASE WHEN k % 4 = 1 THEN 'BACHELORS' END AS level, CASE WHEN k % 4 = 1 THEN '8.' || k % 10 END AS grade,
    CASE WHEN k % 4 = 2 AND k % 3 = 0 THEN 'https://example.org/p/' || k END AS url,
    CASE WHEN k % 8 = 2 THEN '{_PROSE}' WHEN k % 4 = 2 AND k % 3 = 0 THEN 'see https://example.org/p/' || k WHEN k % 4 = 2 THEN 'part ' || k % 7 END AS description,
    CASE k % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 END AS bullets,
    CASE k % 4 WHEN 0 THEN strftime(at_, '%Y-%m') || '-01' WHEN 1 THEN y || '-01-01' WHEN 3 THEN y || '-01-01' END AS start, CASE WHEN k % 4 = 1 THEN (y + 3) || '-01-01' END AS end_, k % 4 = 0 AS is_current, 0.9::DOUBLE AS confidence,
    CASE k % 4 WHEN 0 THEN 'exp:seniorengineer' || k % 3 || ':acme' || user_id % 50 || 'ltd:' || strftime(at_, '%Y%m') WHEN 1 THEN 'edu:acmecollege' || user_id % 20 || ':bscinfield' || k % 5 || ':' || y + 3 || '01' WHEN 2 THEN 'proj:toolt' || k || '::' ELSE 'cert:awscertifiedexpert' || k % 9 || ':aws' END AS content_key
    FROM o WHERE block <= 25),
  one AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, kind, content_key ORDER BY k) = 1)
  SELECT * EXCLUDE (k), CAST(row_number() OVER (PARTITION BY user_id, kind ORDER BY k) AS INTEGER) AS position FROM one""")
def career_entities(s: SparkSession, d: str) -> DataFrame:
    """Entries of all four kinds; 25 blocks of a kind at most."""
    found = careers.career_entities(resume_lines(s, d), "user_id", 2026, parts=parts_for(table(s, d, "orders"), 100_000))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    columns = ("name", "organisation", "location", "degree", "field_of_study", "level", "grade", "url", "description")
    return found.select("user_id", "kind", "position", *columns, F.when(F.col("highlights").isNotNull(), F.size("highlights")).alias("bullets"), day("start").alias("start"), day("end").alias("end_"), "is_current", "confidence", "content_key")
