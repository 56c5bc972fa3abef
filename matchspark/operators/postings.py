"""Filters over postings, applications and skills. Times are parameters, so that results can be repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_OPENING = 4


def live_postings(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Active and not expired at as_of; a posting without an expiry never expires."""
    return jobs.where((F.col("status") == "ACTIVE") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))


def text_contains(term: str, *columns: str) -> Column:
    """Case-insensitive substring of any of the columns."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c)), F.lit(term.lower())) for c in columns))


def range_covers(value: Column | float, low: str, high: str) -> Column:
    """Whether [low, high] holds the value; a null bound is no bound."""
    v = value if isinstance(value, Column) else F.lit(value)
    return (F.col(low).isNull() | (F.col(low) <= v)) & (F.col(high).isNull() | (v <= F.col(high)))


def posted_within(days: int, as_of: Column, column: str = "posted_at") -> Column:
    """Undated rows stay."""
    return F.col(column).isNull() | (F.col(column) >= as_of - F.make_interval(days=F.lit(days)))


def browse_filter(jobs: DataFrame, as_of: Column, q: str | None = None, work_mode: str | None = None, years: int | None = None, country: str | None = None, within_days: int | None = None, company: int | None = None) -> DataFrame:
    """The conjunction of the predicates that are set."""
    wanted: list[Column] = []
    if q:
        wanted.append(text_contains(q, "title"))
    if work_mode:
        wanted.append(F.col("work_mode") == work_mode)
    if years is not None:
        wanted.append(range_covers(years, "min_years", "max_years"))
    if country:
        wanted.append(F.col("country_code") == country)
    if within_days is not None:
        wanted.append(posted_within(within_days, as_of))
    if company is not None:
        wanted.append(F.col("company_id") == company)
    return reduce(lambda df, p: df.where(p), wanted, live_postings(jobs, as_of))


def title_matches_any_role(jobs: DataFrame, roles: DataFrame, role: str = "role") -> DataFrame:
    """Rows of jobs whose title holds some non-blank role. A title that holds a role holds its first letters (up to
    _OPENING): titles, each once, meet the roles by these through an equal join, and only then the whole role is looked
    for; the postings follow by title."""
    asked = roles.where(F.trim(role) != "").select(F.lower(role).alias("_role")).distinct().withColumn("_key", F.substring("_role", 1, _OPENING))
    low = F.lower("title")
    at = lambda n: F.transform(F.when(F.length(low) >= n, F.sequence(F.lit(1), F.length(low) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(low, i, F.lit(n)))
    pieces = F.array_distinct(F.flatten(F.array(*(at(n) for n in range(1, _OPENING + 1)))))
    titles = jobs.select("title").distinct().select("title", F.explode(pieces).alias("_key"))
    hit = titles.join(asked, "_key").where(F.contains(F.lower("title"), F.col("_role"))).select("title").distinct()
    return jobs.join(hit, "title", "left_semi")


def usable_link(url: Column, longest: int = 2000) -> Column:
    """http(s) links as they are, bare hosts with https:// before them; null for other schemes and overlong ones."""
    u = F.trim(url)
    link = F.when(u.rlike(r"(?i)^https?://[^\s/?#]+"), u).when(~u.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & u.rlike(r"^[^\s/?#]+\.[^\s/?#]+"), F.concat(F.lit("https://"), u))
    return F.when(F.length(link) <= longest, link)


def soft_delete_scope(df: DataFrame, deleted_at: str = "deleted_at", owners: DataFrame | None = None, owner: str = "user_id") -> DataFrame:
    kept = df.where(F.col(deleted_at).isNull())
    return kept.join(owners.select(owner), owner, "left_semi") if owners is not None else kept


def taxonomy_search(skills: DataFrame, term: str, limit: int) -> DataFrame:
    """Names that start with or hold the term: prefixes first, then shorter names, then by name and id."""
    t = term.strip().lower()
    low = F.lower("name")
    return skills.where(F.contains(low, F.lit(t))).orderBy(F.startswith(low, F.lit(t)).desc(), F.length("name"), "name", "skill_id").limit(limit)


def visible_candidate_skills(held: DataFrame) -> DataFrame:
    return held.where(~F.coalesce("is_rejected", F.lit(False))).orderBy(F.desc("is_user_verified"), "created_at", "skill_id")


def threshold_ge(df: DataFrame, score: str, least: float) -> DataFrame:
    return df.where(F.col(score) >= least)


def embeddable(docs: DataFrame, text: str = "text", least: int = 80) -> DataFrame:
    return docs.where(F.length(F.trim(text)) >= least)


def admit_postings(postings: DataFrame, link: str, text: str, title: str, company: str, least: int = 200) -> DataFrame:
    """postings with reject_reason (the first that holds; null if admitted) and company_clean."""
    reason = F.when(usable_link(F.col(link)).isNull(), "no usable link").when(F.length(F.coalesce(F.trim(text), F.lit(""))) < least, "description too short").when(F.trim(F.coalesce(title, F.lit(""))) == "", "no title")
    hidden = F.lower(F.trim(company)).isin("confidential", "not disclosed", "n/a", "none", "")
    return postings.withColumn("reject_reason", reason).withColumn("company_clean", F.when(~hidden, F.trim(company)))


def ingest_report(outcomes: DataFrame, outcome: str = "outcome") -> DataFrame:
    o = F.col(outcome)
    counts = [F.count_if(o == v).alias(v.lower()) for v in ("CREATED", "DUPLICATE", "FAILED")]
    return outcomes.agg(*counts, F.count_if(o.isin("CREATED", "DUPLICATE", "FAILED")).alias("processed"))


def check_invariants(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) in one pass; a rule that is null for a row is not violated by it."""
    counted = df.agg(*(F.count_if(~ok).alias(f"r{i}") for i, ok in enumerate(rules.values())))
    names = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(rules)))
    return counted.select(F.inline(names))
