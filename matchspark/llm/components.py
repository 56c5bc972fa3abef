"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node that can be reached.

    Each step is joins and sums by key: no neighbourhood is ever held in one place. The number of steps grows with
    the logarithm of the largest component. Null ends and links of a node with itself are no links."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = cut(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct())
    last = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        last = now
        edges = cut(_small_star(_large_star(edges)))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
    return both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()
