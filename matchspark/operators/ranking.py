"""Top-k, latest, canonical and paging operators. Every order ends in an id, so ranks are total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_k_per_key(df: DataFrame, keys: list[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def rank_page(scored: DataFrame, user: str, score: str, item: str, first: int, size: int, least: float | None = None) -> DataFrame:
    """Rows first to first + size - 1 (from 1) of each user's ranking, with the total before it was cut."""
    kept = scored.where(F.col(score) >= least) if least is not None else scored
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy(user).orderBy(F.desc(score), F.asc(item)))).withColumn("total", F.count("*").over(W.partitionBy(user)))
    return ranked.where(F.col("rank").between(first, first + size - 1))


def canonical_posting(jobs: DataFrame, key: str = "content_hash", order: str = "posted_at", job: str = "job_id") -> DataFrame:
    """(job, canonical_job_id): the oldest active row with the same content; null for that row itself. The first is
    found by an aggregate, so a content of very many copies is no single task's burden."""
    first = jobs.where(F.col("status") == "ACTIVE").groupBy(key).agg(F.min_by(job, F.struct(order, job)).alias("_first"))
    return jobs.join(first, key, "left").select(job, F.when(F.col("_first") != F.col(job), F.col("_first")).alias("canonical_job_id"))


def stable_sample(df: DataFrame, item: str, salt: str, n: int) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.col(item).cast("string"), F.lit(salt))), item).limit(n)


def seeded_shuffle_rank(df: DataFrame, item: str, seed: str, keys: list[str]) -> DataFrame:
    key = F.sha2(F.concat(F.lit(seed), F.col(item).cast("string")), 256)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(key, item)))


def tied_ranks(value: str, keys: list[str], name: str = "tied_rank") -> Column:
    """Average rank of equal values."""
    return (F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2.0).alias(name)


def next_version_number(new: DataFrame, old: DataFrame, key: str, version: str, order: str) -> DataFrame:
    last = old.groupBy(key).agg(F.max(version).alias("_last"))
    place = F.row_number().over(W.partitionBy(key).orderBy(order))
    return new.join(last, key, "left").withColumn(version, F.coalesce("_last", F.lit(0)) + place).drop("_last")


def primary_successor(items: DataFrame, owner: str, item: str, order: str) -> DataFrame:
    return items.groupBy(owner).agg(F.max_by(item, F.struct(order, item)).alias("successor"))


def persona_dedupe(docs: DataFrame, item: str = "doc_id", text: str = "text", chars: int = 400) -> DataFrame:
    """Of the texts that open alike (case and white space aside) the longest, then the one with the least id."""
    opening = F.substring(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), 1, chars)
    best = docs.groupBy(opening.alias("_opening")).agg(F.min_by(item, F.struct(-F.length(text), item)).alias(item))
    return best.select(item)


def top_k_pool(scores: DataFrame, query: str, item: str, ranker: str, score: str, k: int) -> DataFrame:
    """(query, item, rankers): the union of each ranker's first k."""
    best = top_k_per_key(scores, [query, ranker], k, F.desc(score), F.asc(item))
    return best.groupBy(query, item).agg(F.array_sort(F.collect_set(ranker)).alias("rankers"))
