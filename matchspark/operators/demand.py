"""Skill demand, gaps, funnel and ledger aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchspark.session import dealt

STAGES = ("APPLIED", "ASSESSMENT", "INTERVIEW", "OFFER")
REQUIRED_WEIGHT, PREFERRED_WEIGHT = 1.0, 0.5


def skill_demand(live: DataFrame, job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """(skill_id, demand_score): the share of live postings that name the skill; 0 if none does, null if there are
    no live postings at all."""
    total = live.agg(F.count("*").alias("_live"))
    wanted = job_skills.select("job_id", "skill_id").join(live.select("job_id"), "job_id").distinct().groupBy("skill_id").agg(F.count("*").alias("_n"))
    return skills.select("skill_id").join(wanted, "skill_id", "left").crossJoin(total).select("skill_id", F.when(F.col("_live") > 0, F.round(F.coalesce("_n", F.lit(0)) / F.col("_live"), 4)).alias("demand_score"))


def demand_coverage(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if(F.col("demand_score") > 0).alias("scored"), F.count("*").alias("skills"), F.max("demand_score").alias("highest"))


def required_counts(jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    active = jobs.where("status = 'ACTIVE'").select("job_id")
    return job_skills.where("requirement = 'REQUIRED'").join(active, "job_id", "left_semi").groupBy("skill_id").agg(F.count("*").alias("n_jobs"))


def related_skills(held: DataFrame, skills: DataFrame, owner: str = "user_id", parts: int | None = None) -> DataFrame:
    """(owner, skill_id) of the parents and the children of what is held; one level, never further."""
    links = skills.where("parent_skill_id is not null").select(F.col("skill_id").alias("child"), F.col("parent_skill_id").alias("parent"))
    held = dealt(held, parts, "skill_id")
    up = held.join(links, held["skill_id"] == links["child"]).select(owner, F.col("parent").alias("skill_id"))
    down = held.join(links, held["skill_id"] == links["parent"]).select(owner, F.col("child").alias("skill_id"))
    return dealt(up.union(down), parts, owner, "skill_id").distinct()


def skill_gaps(targets: DataFrame, job_skills: DataFrame, held: DataFrame, skills: DataFrame, least: float = 0.05) -> DataFrame:
    """targets: (user_id, job_id). A row for each skill that the user's targets ask for often enough."""
    size = targets.groupBy("user_id").agg(F.countDistinct("job_id").alias("_jobs"))
    weight = F.when(F.col("requirement") == "REQUIRED", REQUIRED_WEIGHT).otherwise(PREFERRED_WEIGHT)
    asked = targets.join(job_skills, "job_id").groupBy("user_id", "skill_id").agg(F.sum(weight).alias("_weight"))
    frequency = F.bround((F.col("_weight") / F.col("_jobs")).cast("decimal(20,12)"), 4).cast("double")
    rated = asked.join(size, "user_id").select("user_id", "skill_id", frequency.alias("frequency")).where(F.col("frequency") >= least)
    own, near = held.select("user_id", "skill_id").withColumn("_held", F.lit(True)), related_skills(held, skills).withColumn("_near", F.lit(True))
    status = F.when(F.col("_held"), "STRONG").when(F.col("_near"), "PARTIAL").otherwise("MISSING")
    f = F.col("frequency")
    severity = F.when(f >= 0.60, "CRITICAL").when(f >= 0.35, "HIGH").when(f >= 0.15, "MEDIUM").otherwise("LOW")
    return rated.join(own, ["user_id", "skill_id"], "left").join(near, ["user_id", "skill_id"], "left").select("user_id", "skill_id", "frequency", status.alias("gap_status"), severity.alias("severity"))


def gap_availability(targets: DataFrame, users: DataFrame, gaps: DataFrame) -> DataFrame:
    """Why a user's list of gaps is empty, if it is."""
    has_target, has_job = targets.select("user_id").distinct().withColumn("_t", F.lit(1)), gaps.select("user_id").distinct().withColumn("_j", F.lit(1))
    state = F.when(F.col("_t").isNull(), "NO_TARGET").when(F.col("_j").isNull(), "NO_JOBS").otherwise("READY")
    return users.select("user_id").join(has_target, "user_id", "left").join(has_job, "user_id", "left").select("user_id", state.alias("availability"))


def score_band(score: Column) -> Column:
    s = score.cast("int")
    return F.when(s.isNull(), "Not recorded").when(s >= 70, "70+").when(s >= 60, "60-69").when(s >= 50, "50-59").otherwise("Under 50")


def reached_stage(applications: DataFrame, events: DataFrame, stage: str) -> DataFrame:
    """applications with reached: the stage is the current one or some event led to it."""
    seen = events.groupBy("user_id", "job_id").agg(F.bool_or(F.col("to_status") == stage).alias("_seen"))
    return applications.join(seen, ["user_id", "job_id"], "left").withColumn("reached", F.coalesce("_seen", F.lit(False)) | (F.col("status") == stage)).drop("_seen")


def funnel_facts(applications: DataFrame, jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Applications that were sent, with the posting's title, country and a score, and how far each came."""
    reached = events.groupBy("user_id", "job_id").agg(F.bool_or(F.col("to_status") == "INTERVIEW").alias("_i"), F.bool_or(F.col("to_status") == "OFFER").alias("_o"), F.max("value").alias("score"))
    flag = lambda c, s: (F.coalesce(c, F.lit(False)) | (F.col("status") == s)).cast("int")
    facts = applications.where("applied_at is not null").join(jobs.select("job_id", "title", F.col("country_code").alias("location")), "job_id").join(reached, ["user_id", "job_id"], "left")
    return facts.select("user_id", "job_id", "title", "location", score_band(F.col("score")).alias("band"), flag("_i", "INTERVIEW").alias("interviewed"), flag("_o", "OFFER").alias("offered"))


def funnel_report(facts: DataFrame, least: int = 5) -> DataFrame:
    """Overall and by role, location and score band, in one pass over the facts. Rates are null below `least`."""
    shaped = facts.withColumn("role", F.lower(F.trim(F.coalesce("title", F.lit(""))))).withColumn("location", F.coalesce("location", F.lit("Not stated")))
    grouped = shaped.groupingSets([["user_id"], ["user_id", "role"], ["user_id", "location"], ["user_id", "band"]], "user_id", "role", "location", "band").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("applications"), F.sum("interviewed").alias("interviews"), F.sum("offered").alias("offers"), F.min("title").alias("_title")
    )
    kind = F.when(F.col("_g") == 7, "overall").when(F.col("_g") == 3, "role").when(F.col("_g") == 5, "location").otherwise("band")
    label = F.when(kind == "role", F.coalesce("_title", F.lit("Not stated"))).when(kind == "location", F.col("location")).when(kind == "band", F.col("band")).otherwise("overall")
    rate = lambda c: F.when(F.col("applications") >= least, F.round(F.col(c) / F.col("applications"), 4))
    return grouped.select("user_id", kind.alias("segment"), label.alias("label"), "applications", "interviews", "offers", rate("interviews").alias("interview_rate"), rate("offers").alias("offer_rate"))


def weighted_topics(targets: DataFrame, job_skills: DataFrame, held: DataFrame, skills: DataFrame, most: int = 8, parts: int | None = None) -> DataFrame:
    """(user_id, skill_id, name, weight, confidence, place): what to ask a user about, by how firmly it is wanted and
    how far it is from what they have. What is joined is dealt by posting, user, skill and user again, into `parts`
    parts if that is given."""
    firm = F.when(F.col("requirement") == "REQUIRED", REQUIRED_WEIGHT).otherwise(PREFERRED_WEIGHT)
    own, near = held.select("user_id", "skill_id").withColumn("_held", F.lit(True)), related_skills(held, skills, parts=parts).withColumn("_near", F.lit(True))
    distance = F.when(F.col("_held"), 1.0).when(F.col("_near"), 1.2).otherwise(1.4)
    asked = dealt(dealt(targets, parts, "job_id").join(job_skills, "job_id"), parts, "user_id", "skill_id")
    summed = asked.join(own, ["user_id", "skill_id"], "left").join(near, ["user_id", "skill_id"], "left").groupBy("user_id", "skill_id").agg(F.round(F.sum(firm * distance), 6).alias("weight"), F.round(F.sum("confidence"), 6).alias("confidence"))
    named = dealt(dealt(summed, parts, "skill_id").join(skills.select("skill_id", "name"), "skill_id"), parts, "user_id")
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("weight"), F.desc("confidence"), "name", "skill_id"))
    return named.withColumn("place", place).where(F.col("place") <= most)


def requests_since(runs: DataFrame, since: Column) -> DataFrame:
    return runs.agg(F.coalesce(F.sum(F.when(F.col("started_at") >= since, F.col("requests_spent"))), F.lit(0)).alias("requests"))


def last_used(runs: DataFrame, since: Column) -> DataFrame:
    return runs.where(F.col("started_at") >= since).groupBy("query").agg(F.max("started_at").alias("last_used"))


_SLOTS = 1024


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Smallest, 5 %, middle, 95 %, largest; between two values the quantile is in proportion. Exact: equal values are
    counted first, then numbered within slots of the span, so no task sees more than the values of a slot."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    span = counted.agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum("n").alias("total")).withColumn("_all", F.lit(0))
    wide = F.col("most") > F.col("least")
    slot = F.when(wide, F.floor((F.col("v") - F.col("least")) / (F.col("most") - F.col("least")) * (_SLOTS - 1))).otherwise(0).cast("int")
    dealt = counted.withColumn("_all", F.lit(0)).join(F.broadcast(span), "_all").withColumn("slot", slot)
    slots = dealt.groupBy("slot").agg(F.sum("n").alias("in_slot"))  # at most _SLOTS rows
    before = slots.select("slot", F.coalesce(F.sum("in_slot").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = dealt.join(F.broadcast(before), "slot").withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy("slot").orderBy("v")))

    def quantile(p: float) -> Column:
        place = F.lit(p) * (F.col("total") - 1)
        at = lambda k: F.max(F.when((F.col("upto") - F.col("n") <= k) & (F.col("upto") > k), F.col("v")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return placed.agg(F.max("least").alias("least"), quantile(0.05).alias("p05"), quantile(0.5).alias("median"), quantile(0.95).alias("p95"), F.max("most").alias("most"))
