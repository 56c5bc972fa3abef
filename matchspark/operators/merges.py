"""Keyed merges and set differences. Files know no MERGE, so each gives the whole new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchspark.functions.text import fold_text


def keyed_merge(old: DataFrame, new: DataFrame, keys: list[str], guard: Column | None = None) -> DataFrame:
    """old with new's rows in place of those with their keys; rows of old for which guard holds stay as they are."""
    rank = F.when(F.col("_new"), 1).otherwise(F.when(guard, 0).otherwise(2)) if guard is not None else F.when(F.col("_new"), 1).otherwise(2)
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    return both.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(rank))).where("_rank = 1").drop("_rank", "_new")


def merge_application(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The score is kept only with an application that was sent."""
    merged = keyed_merge(old, new, keys)
    return merged.withColumn("score", F.when(F.col("status") != "SAVED", F.col("score")))


def replace_job_skills(old: DataFrame, new: DataFrame, job: str = "job_id", skill: str = "skill_id") -> DataFrame:
    """A job's new set replaces its old one; a job with no new rows keeps the old. Null is no job that could be replaced.

    Old and new rows are dealt by job and sorted once, so a task holds nothing but its sort, which can spill."""
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    all_of = W.partitionBy(job).orderBy(skill).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    replaced = F.col(job).isNotNull() & F.max("_new").over(all_of)
    nth = F.row_number().over(W.partitionBy(job, skill).orderBy(F.desc("_new")))
    kept = both.withColumn("_replaced", replaced).withColumn("_nth", nth)
    return kept.where(F.when(F.col("_new"), F.col("_nth") == 1).otherwise(~F.col("_replaced"))).drop("_new", "_replaced", "_nth")


def merge_taxonomy(old: DataFrame, new: DataFrame) -> DataFrame:
    """By name: category is refreshed, ids stay, parents are set only where there is none."""
    fresh = new.select("name", F.col("category").alias("_category"), F.col("parent_skill_id").alias("_parent"))
    return old.join(fresh, "name", "left").select("skill_id", "name", F.coalesce("_category", "category").alias("category"), F.coalesce("parent_skill_id", "_parent").alias("parent_skill_id"))


def fill_if_empty(profile: DataFrame, extracted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """profile with empty fields filled; applied and skipped name the fields that were and those that had a value."""
    found = extracted.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    has = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull()
    fields = lambda when: F.filter(F.array(*(F.when(when(c), c) for c in columns)), lambda x: x.isNotNull())
    applied, skipped = fields(lambda c: ~has(c) & has(f"_{c}")), fields(lambda c: has(c) & has(f"_{c}"))
    joined = profile.join(found, key, "left")
    kept = [c for c in profile.columns if c not in columns]
    return joined.select(*kept, *(F.when(has(c), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in columns), applied.alias("applied"), skipped.alias("skipped"))


def attach_link(postings: DataFrame, links: DataFrame, key: str, url: str = "url") -> DataFrame:
    usable = F.col(url).rlike("(?i)^https?://")
    return postings.join(links.select(key, F.col(url).alias("_link")), key, "left").withColumn(url, F.when(F.coalesce(usable, F.lit(False)), F.col(url)).otherwise(F.coalesce("_link", url))).drop("_link")


def resolve_companies(names: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """(company_id, normalized_name, name) of companies not known yet, one for each normalized name."""
    normal = names.select(F.col(name).alias("name"), fold_text(F.col(name)).alias("normalized_name")).where("normalized_name <> ''")
    fresh = normal.groupBy("normalized_name").agg(F.min("name").alias("name")).join(known, "normalized_name", "left_anti")
    return fresh.select(F.sha2("normalized_name", 256).alias("company_id"), "normalized_name", "name")


def dedupe_on_external_id(batch: DataFrame, corpus: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of batch whose keys are new: not in the corpus, and the first of the batch. Null keys are never equal."""
    known = batch.where(" and ".join(f"{k} is not null" for k in keys)).join(corpus.select(*keys).distinct(), keys, "left_anti")
    first = known.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")
    return first.unionByName(batch.where(" or ".join(f"{k} is null" for k in keys)))


def reuse_parse_by_hash(new: DataFrame, parsed: DataFrame, keys: list[str], result: str, order: str) -> DataFrame:
    """new with the latest complete result for the same keys, null where there is none."""
    latest = parsed.groupBy(*keys).agg(F.max_by(result, order).alias(result))
    return new.join(latest, keys, "left")


def not_claimed(suggested: DataFrame, claimed: DataFrame, keys: list[str]) -> DataFrame:
    """Suggestions that are nowhere on the profile, rejected ones included."""
    return suggested.join(claimed.select(*keys), keys, "left_anti").distinct()


def stale_rows(old: DataFrame, new: DataFrame, key: str, protected: Column) -> DataFrame:
    return old.where(~protected).join(new.select(key), key, "left_anti")


def unknown_terms(terms: DataFrame, forms: DataFrame, doc: str, most: int = 50) -> DataFrame:
    """(doc, term, place): listed terms that the taxonomy lacks, the first `most` of each doc in order."""
    new = terms.join(forms.select("term"), "term", "left_anti")
    return new.withColumn("place", F.row_number().over(W.partitionBy(doc).orderBy("term"))).where(F.col("place") <= most)


def delta_report(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """considered, changed, total_before, total_after, lost: counts of a keyed measure before and after a re-run."""
    both = before.select(key, F.col(value).alias("_b")).join(after.select(key, F.col(value).alias("_a")), key, "full")
    b, a = F.coalesce("_b", F.lit(0)), F.coalesce("_a", F.lit(0))
    return both.agg(F.count("*").alias("considered"), F.count_if(a != b).alias("changed"), F.sum(b).alias("total_before"), F.sum(a).alias("total_after"), F.count_if(a < b).alias("lost"))


def index_outcome(docs: DataFrame, indexed: DataFrame, key: str, least: int = 80) -> DataFrame:
    """considered, too_short, skipped (same hash), embedded."""
    joined = docs.join(indexed.select(key, F.col("hash").alias("_hash")), key, "left")
    short = F.length(F.trim("text")) < least
    same = ~short & F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False))
    return joined.agg(F.count("*").alias("considered"), F.count_if(short).alias("too_short"), F.count_if(same).alias("skipped"), F.count_if(~short & ~same).alias("embedded"))
