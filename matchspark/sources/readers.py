"""Sources and sinks: batches with per-record rejection, nested provider payloads, label maps, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTING = "external_id string, source string, title string, company string, description string, url string"
PAYLOAD = (
    "struct<data: struct<jobs: array<struct<job_id: string, job_uid: string, job_title: string, employer_name: string, job_apply_link: string, "
    "job_description: string, job_city: string, job_state: string, job_country: string, job_posted_at_datetime_utc: string>>>>"
)
#: A string may be as long as Spark's own; by itself Spark rejects lines with one of over 20 million characters.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


def read_postings_batch(spark: SparkSession, path: str, schema: str = POSTING) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a JSON-lines batch; a bad record is reported with its reason and stops nothing."""
    raw = spark.read.schema(f"{schema}, _bad string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", **ANY_LENGTH).json(path)
    reason = F.when(F.col("_bad").isNotNull(), "Record is not valid JSON.").when(F.trim(F.coalesce("description", F.lit(""))) == "", "Record has no description.")
    judged = raw.withColumn("reject_reason", reason)
    return judged.where("reject_reason is null").drop("_bad", "reject_reason"), judged.where("reject_reason is not null").select("external_id", "reject_reason", "_bad")


def flatten_provider_postings(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """One flat posting for each element of data.jobs that has an id, a title and a description."""
    jobs = raw.select(F.explode(F.from_json(payload, PAYLOAD)["data"]["jobs"]).alias("j")).select("j.*")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    country = F.trim("job_country")
    return jobs.where(text("job_id").isNotNull() & text("job_title").isNotNull() & text("job_description").isNotNull()).select(
        F.coalesce(text("job_uid"), F.substring(F.sha2("job_id", 256), 1, 32)).alias("external_id"),
        F.col("job_title").alias("title"),
        text("employer_name").alias("company"),
        F.col("job_description").alias("description"),
        text("job_apply_link").alias("url"),
        F.nullif(F.concat_ws(", ", text("job_city"), text("job_state"), text("job_country")), F.lit("")).alias("location"),
        F.when(F.length(country) == 2, F.upper(country)).alias("country_code"),
        F.try_to_timestamp("job_posted_at_datetime_utc").alias("posted_at"),
    )


def read_label_map(raw: DataFrame, column: str = "labels") -> DataFrame:
    """(query_id, doc_id, label) from JSON objects {"query|doc": label}; null labels are left out."""
    pairs = raw.select(F.explode(F.from_json(column, "map<string,int>")))
    return pairs.where("value is not null").select(F.split("key", "\\|")[0].alias("query_id"), F.split("key", "\\|")[1].alias("doc_id"), F.col("value").alias("label"))


def read_jsonl_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**ANY_LENGTH).json(path)


def snapshot(jobs: DataFrame, job_skills: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """The newest n postings that have a vector, with their skills as a sorted list."""
    newest = jobs.join(vectors.select("job_id"), "job_id", "left_semi").orderBy(F.desc("posted_at"), "job_id").limit(n)
    wanted = job_skills.join(newest.select("job_id"), "job_id", "left_semi").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("skill_id", "requirement"))).alias("skills"))
    return newest.join(wanted, "job_id", "left")


def export_snapshot(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").json(path)
