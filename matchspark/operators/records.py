"""Joins, scopes and counts over application, interview and career records, by key columns that the caller names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def postings_with_application(jobs: DataFrame, applications: DataFrame, user: int | Column | None = None, job: str = "job_id") -> DataFrame:
    """jobs with application, the status of the user's own, null where there is none; for all users if none is named,
    a row for each (user_id, posting) with an application and one with nulls for each posting without any."""
    own = applications if user is None else applications.where(F.col("user_id") == user)
    columns = [job, F.col("status").alias("application")] + (["user_id"] if user is None else [])
    return jobs.join(own.select(*columns), job, "left")


def exclude_applied(pairs: DataFrame, applications: DataFrame, keys: list[str], applied: str = "status = 'APPLIED'") -> DataFrame:
    """pairs without those that have been applied to; saved ones stay."""
    return pairs.join(applications.where(applied).select(*keys), keys, "left_anti")


def candidate_snapshot(candidates: DataFrame, held: DataFrame, applications: DataFrame, user: str = "user_id") -> DataFrame:
    """candidates with n_skills, n_applications and the status of the application to the last posting."""
    skills = held.groupBy(user).agg(F.count("*").alias("n_skills"))
    sent = applications.groupBy(user).agg(F.count("*").alias("n_applications"), F.max_by("status", "job_id").alias("last_status"))
    both = candidates.join(skills, user, "left").join(sent, user, "left")
    return both.fillna(0, ["n_skills", "n_applications"])


def answers_per_interview(turns: DataFrame, session: str, answered: Column, mark: Column, places: int = 3) -> DataFrame:
    """(session, answered, average_mark): 0 and null for a session without answers."""
    return turns.groupBy(session).agg(F.count_if(F.coalesce(answered, F.lit(False))).alias("answered"), F.round(F.avg(F.when(answered, mark)), places).alias("average_mark"))


def provenance_scope(held: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """The rows of held that come from one of the sources."""
    return held.join(sources.select(key).distinct(), key, "left_semi")


def resolve_names(mentions: DataFrame, skills: DataFrame, name: str = "name") -> DataFrame:
    """mentions with canonical_id, the smallest skill_id of that name, null where no skill has it."""
    canonical = skills.groupBy(name).agg(F.min("skill_id").alias("canonical_id"))
    return mentions.join(canonical, name, "left")


def counts_by(rows: DataFrame, keys: list[str], users: str | None = None, count: str = "n") -> DataFrame:
    """(keys, count) and, if users is named, n_users, how many different ones there are."""
    more = [F.countDistinct(users).alias("n_users")] if users else []
    return rows.groupBy(*keys).agg(F.count("*").alias(count), *more)


def display_order(job_skills: DataFrame, skills: DataFrame, job: str = "job_id") -> DataFrame:
    """job_skills with name and place: required first, then the surest, then by name and id."""
    named = job_skills.join(skills.select("skill_id", "name"), "skill_id")
    order = W.partitionBy(job).orderBy((F.col("requirement") == "REQUIRED").desc(), F.desc("confidence"), "name", "skill_id")
    return named.withColumn("place", F.row_number().over(order))


def career_order(rows: DataFrame, owner: str, end: str, start: str, row: str) -> DataFrame:
    """rows with place: the latest end first, open ones last, then the latest start, then by id."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(owner).orderBy(F.desc_nulls_last(end), F.desc(start), row)))


def recall_availability(candidates: DataFrame, held: DataFrame, vectors: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, availability): NO_RESUME without skills, PENDING without a vector, else READY."""
    has = lambda df, name: df.select(user).distinct().withColumn(name, F.lit(True))
    both = candidates.select(user).join(has(held, "_h"), user, "left").join(has(vectors, "_v"), user, "left")
    return both.select(user, F.when(F.col("_h").isNull(), "NO_RESUME").when(F.col("_v").isNull(), "PENDING").otherwise("READY").alias("availability"))


def same_model(left: DataFrame, right: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """Vectors that may be compared: of one model, and alike in keys."""
    return left.join(right, [model, *keys])


def merge_feedback(old: DataFrame, new: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """One row for each key: the latest by `at` of the old rows and the new ones."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_last"))
    return last.select(*keys, "_last.*")


def pool_union(rows: DataFrame, row: str, orders: list[list[Column]], most: int) -> DataFrame:
    """(row) of the first `most` rows of each order, once each: the top-k of each goes on, not the table."""
    tops = [rows.orderBy(*order, row).limit(most).select(row) for order in orders]
    out = tops[0]
    for top in tops[1:]:
        out = out.union(top)
    return out.distinct()


def pair_split(pairs: DataFrame, rows: DataFrame, row: str, a: str = "a", b: str = "b") -> DataFrame:
    """pairs (a, b) with the columns of rows for either side, named after it."""
    side = lambda name: rows.select(*(F.col(c).alias(name if c == row else f"{c}_{name}") for c in rows.columns))
    return pairs.join(side(a), a, "left").join(side(b), b, "left")


def pair_counts(rows: DataFrame, group: Column, duplicate: Column, source: Column, opening: Column) -> DataFrame:
    """(pairs, duplicates, same_source, same_opening, opening_only) of the pairs of rows within a group, counted from
    group sizes: n rows have n (n - 1) / 2 pairs, and pairs that agree in more are those of the finer groups."""
    named = rows.select(group.alias("o"), duplicate.alias("h"), source.alias("s"), opening.alias("p"))
    n = F.count("*")
    sets = named.groupingSets([["o"], ["o", "h"], ["o", "s"], ["o", "p"], ["o", "p", "h"]], "o", "h", "s", "p").agg(F.grouping_id().alias("g"), (n * (n - 1) / 2).cast("long").alias("k"))
    total = lambda g: F.coalesce(F.sum(F.when(F.col("g") == g, F.col("k"))), F.lit(0))
    summed = sets.agg(total(7).alias("pairs"), total(3).alias("duplicates"), total(5).alias("same_source"), total(6).alias("same_opening"), total(2).alias("both"))
    return summed.select("pairs", "duplicates", "same_source", "same_opening", (F.col("same_opening") - F.col("both")).alias("opening_only"))
