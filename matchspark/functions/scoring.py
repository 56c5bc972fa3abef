"""The six match dimensions as columns of one wide row; each gives (score, status).

Unknown is never zero: a dimension that cannot be computed scores NEUTRAL and says why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The documented weights; they sum to 1 and are never redistributed.
WEIGHTS = {"semantic": 0.35, "skill": 0.25, "experience": 0.15, "education": 0.10, "location": 0.10, "salary": 0.05}
NEUTRAL = 0.5
COSINE_RANGE = (0.35, 0.78)
RANKING_VERSION = "v1-hand-tuned"
EDUCATION_LEVELS = ("NONE", "HIGH_SCHOOL", "DIPLOMA", "BACHELORS", "MASTERS", "DOCTORATE")
PERIODS_A_YEAR = {"YEARLY": 1, "MONTHLY": 12, "HOURLY": 2080}
WORK_MODE_WORDS = ("remote", "hybrid", "onsite", "on-site", "work from home", "wfh")

Dimension = tuple[Column, Column]


def half_even(x: Column, places: int) -> Column:
    return F.bround(x.cast("decimal(20,12)"), places).cast("double")


def _pick(*cases: tuple[Column, float | Column, str], other: tuple[float | Column, str]) -> Dimension:
    score, status = F.lit(other[0]) if not isinstance(other[0], Column) else other[0], F.lit(other[1])
    for when, s, name in reversed(cases):
        score, status = F.when(when, s).otherwise(score), F.when(when, name).otherwise(status)
    return half_even(score.cast("double"), 4), status


def semantic(cosine: Column, span: tuple[float, float] = COSINE_RANGE) -> Dimension:
    lo, hi = span
    return _pick((cosine.isNull(), NEUTRAL, "NEEDS_DATA"), other=(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine - lo) / (hi - lo))), "SCORED"))


def experience(years: Column, low: Column, high: Column) -> Dimension:
    """0 years is a value; null is unknown."""
    return _pick(
        (low.isNull() & high.isNull(), 1.0, "NOT_STATED"),
        (years.isNull(), NEUTRAL, "NEEDS_PROFILE"),
        (years < low, F.greatest(F.lit(0.0), 1 - (low - years) / low), "SCORED"),
        (years > high, F.greatest(F.lit(0.7), 1 - 0.05 * (years - high)), "SCORED"),
        other=(1.0, "SCORED"),
    )


def education_rank(level: Column) -> Column:
    rank = F.lit(None).cast("int")
    for i, name in enumerate(EDUCATION_LEVELS):
        rank = F.when(level == name, i).otherwise(rank)
    return rank


def education(have: Column, need: Column) -> Dimension:
    """have and need as ranks."""
    gap = have - need
    return _pick((need.isNull(), 1.0, "NOT_STATED"), (have.isNull(), NEUTRAL, "NEEDS_PROFILE"), (gap >= 0, 1.0, "SCORED"), (gap == -1, 0.6, "SCORED"), other=(0.2, "SCORED"))


def place_tokens(*values: Column) -> Column:
    """Distinct lower-case place names; "key: value" pieces and work modes are no places."""
    parts = F.split(F.concat_ws(",", *values), r"[,/|;]|\s+-\s+")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.lower(F.trim(p))), lambda p: (p != "") & ~F.contains(p, F.lit(":")) & ~p.isin(*WORK_MODE_WORDS)))


def location(places: Column, remote_wish: Column, country: Column, relocate: Column, job_places: Column, job_country: Column, work_mode: Column) -> Dimension:
    same = country == job_country
    return _pick(
        ((F.size(places) == 0) & ~remote_wish & country.isNull(), NEUTRAL, "NEEDS_PROFILE"),
        ((work_mode == "REMOTE") & remote_wish, 1.0, "SCORED"),
        ((F.size(job_places) == 0) & job_country.isNull(), NEUTRAL, "NEEDS_DATA"),
        (F.arrays_overlap(places, job_places), 1.0, "SCORED"),
        (same & relocate, 0.7, "SCORED"),
        (same, 0.3, "SCORED"),
        (~same, 0.1, "SCORED"),
        other=(NEUTRAL, "NEEDS_DATA"),
    )


def to_yearly(amount: Column, period: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, times in PERIODS_A_YEAR.items():
        out = F.when(period == name, amount * times).otherwise(out)
    return out


def salary(low: Column, high: Column, currency: Column, period: Column, floor: Column, floor_currency: Column) -> Dimension:
    quoted = F.coalesce(high, low)
    yearly = to_yearly(quoted, period)
    return _pick(
        (quoted.isNull(), NEUTRAL, "NOT_STATED"),
        (floor.isNull(), NEUTRAL, "NEEDS_PROFILE"),
        (currency.isNull() | floor_currency.isNull() | (currency != floor_currency), NEUTRAL, "NEEDS_DATA"),
        (yearly.isNull(), NEUTRAL, "NEEDS_DATA"),
        (yearly >= floor, 1.0, "SCORED"),
        other=(F.greatest(F.lit(0.0), F.least(F.lit(1.0), yearly / floor)), "SCORED"),
    )


def skill_rarity(demand: Column) -> Column:
    """Rarer skills weigh more; an unmeasured one weighs 1."""
    return F.coalesce(-F.ln(F.greatest(demand, F.lit(0.01))), F.lit(1.0))


def contribution(score: Column, weight: float) -> Column:
    return F.bround(score.cast("decimal(5,4)") * F.lit(f"{weight:.2f}").cast("decimal(3,2)") * 100, 1)


def breakdown() -> Column:
    """Six rows in fixed order from the columns <dimension> and <dimension>_status."""
    return F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(n).alias("score"), F.lit(w).alias("weight"), F.col(f"{n}_status").alias("status"), contribution(F.col(n), w).cast("double").alias("contribution")) for n, w in WEIGHTS.items()))


def overall() -> Column:
    """The sum of the rounded contributions."""
    total = F.lit(0).cast("decimal(10,1)")
    for n, w in WEIGHTS.items():
        total = total + contribution(F.col(n), w)
    return total.cast("double")


def scored_weight() -> Column:
    total = F.lit(0).cast("decimal(5,2)")
    for n, w in WEIGHTS.items():
        total = total + F.when(F.col(f"{n}_status") == "SCORED", F.lit(f"{w:.2f}").cast("decimal(3,2)")).otherwise(F.lit(0).cast("decimal(3,2)"))
    return total.cast("double")


def months_between_spans(spans: Column, as_of: Column) -> Column:
    """Years to one place over (start, end) spans; an open end is as_of, reversed spans count nothing, 0 is null."""
    def months(s: Column) -> Column:
        end = F.coalesce(s["end"], as_of)
        n = (F.year(end) - F.year(s["start"])) * 12 + F.month(end) - F.month(s["start"])
        return F.when(s["start"].isNotNull() & (n > 0), n).otherwise(0)

    total = F.aggregate(spans, F.lit(0), lambda acc, s: acc + months(s))
    return F.nullif(F.bround((total / 12).cast("decimal(12,6)"), 1), F.lit(0).cast("decimal(12,1)")).cast("double")


def reason_text(score: Column, status: Column, name: str) -> Column:
    """A sentence without numbers; unknown dimensions say whose turn it is."""
    return (
        F.when(status == "NOT_STATED", f"The posting states no {name} requirement.")
        .when(status == "NEEDS_PROFILE", f"Add your {name} to your profile to have it compared.")
        .when(status == "NEEDS_DATA", f"There is not enough about {name} in this posting.")
        .when(score >= 0.75, f"A strong {name} match.")
        .when(score >= 0.5, f"A fair {name} match.")
        .when(score >= 0.25, f"A weak {name} match.")
        .otherwise(f"Little {name} match.")
    )
