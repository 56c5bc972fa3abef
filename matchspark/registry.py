"""Name to (Spark callable, oracle SQL); __spark_entry__ only re-exports it."""

from __future__ import annotations

from matchspark.plans import grounding, market, matching, more, parsing, ranking_eval, resumes, upserts  # noqa: F401  each registers its queries
from matchspark.plans.base import REGISTRY, Query
from matchspark.streaming import plans as _streams  # noqa: F401

FLAGSHIP = "recommend"


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
