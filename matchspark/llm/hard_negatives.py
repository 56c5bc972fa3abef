"""Hard-negative mining by threshold joins that bound suffixes (in the way of L2AP).

Every search is a threshold join: all rows whose inner product with an anchor reaches the anchor's threshold. Anchors
and rows meet in tiles of bounded size, whatever their number. In a tile the dimensions are ordered by weight, and the
rows are indexed dimension by dimension; a row's trailing dimensions are left out of the index as soon as the norm of
what is left cannot reach the lowest threshold by itself. The scores of the indexed dimensions are summed up block by
block, pairs go as soon as their sum and the product of the remaining norms stay below the threshold, and what
survives gets its exact score. Thresholds begin high and are lowered until the anchor's windows are full or its floor
is reached. A tile sends the best few of each window, so what is merged is bounded too, and nothing is left out: the
best k of all are among the best k of the tiles.

Two searches make the negatives: the best `positives` rows of the anchor's label, then, for each of them, the best
`negatives` rows of another label with a score between `low` and `high` hundredths of the positive's.

Defined results: rows with null id, null label or null vector, or with a null component, take no part. Rows repeated
in full count once; rows that share an id but not all else are rows of their own, as anchors too. A vector that is
shorter than others counts as filled up with zeros, an empty one has score 0 with all. Equal scores are in order of
id. An anchor without another row of its label has no positives, so no rows; the same holds for positives with a
negative score, as no score lies in their window. Tables without rows give none. Other columns are not looked at.
Scores are exact while sums of products stay below 2^53, as floats in BLAS; beyond that, as 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchspark.llm.common import cut, table

#: Anchors and rows of a tile, dimensions summed up at once, and the share of pairs under which the others are no
#: longer looked at. None of these changes a result.
ANCHORS = 512
ROWS = 8192
_BLOCK = 16
_FEW = 0.1
#: How thresholds are lowered, from the highest score that is possible; then the floor.
STEPS = (0.9, 0.75, 0.6, 0.45, 0.3, 0.15)
EXACT = 1 << 53


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of integers, filled up to width."""
    out = np.zeros((len(column), width), np.int64)
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.cast(pa.list_(pa.int64()))
    at = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], n)] = values[at[0] : at[-1]]
    return out


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Column k: the norm of what the dimensions from k on hold; one more column of zeros."""
    out = np.zeros((len(x), x.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum(np.square(x, dtype=np.float64)[:, ::-1], axis=1)[:, ::-1])
    return out


class Index:
    """The rows of a tile, to be searched by thresholds."""

    def __init__(self, x: np.ndarray) -> None:
        self.order = np.argsort(-np.square(x, dtype=np.float64).sum(axis=0), kind="stable")
        self.whole, self.x = x, x[:, self.order].astype(np.float64)
        self.norms = suffix_norms(self.x)

    def reach(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs whose score is least[anchor] or more."""
        ours = q[:, self.order].astype(np.float64)
        rest = suffix_norms(ours)
        d = ours.shape[1]
        slack = 1e-9 * (rest[:, 0].max(initial=0) * self.norms[:, 0].max(initial=0) + 1)
        floor = np.where(np.isfinite(least), least - slack, least)
        # a row is indexed up to where the norm that is left cannot reach the lowest threshold
        indexed = (self.norms[:, :d] * rest[:, :d].max(axis=0, initial=0) >= floor.min(initial=np.inf)).sum(axis=1)
        rows = np.argsort(-indexed, kind="stable")
        n = int((indexed > 0).sum())
        rows = rows[:n]
        x, norms = self.x[rows], self.norms[rows]
        upto = np.minimum(_BLOCK * -(-indexed[rows] // _BLOCK), d)
        part = np.zeros((len(ours), n))
        a = r = np.zeros(0, np.int64)
        for k in range(0, d, _BLOCK):
            e = min(k + _BLOCK, d)
            most = int((upto > k).sum())  # the postings of these dimensions: the rows that are indexed so far
            part[:, :most] += ours[:, k:e] @ x[:most, k:e].T
            at = np.minimum(e, upto)  # where a row's index has ended, the norm from there on is its bound
            alive = part + rest[:, at] * norms[np.arange(n), at] >= floor[:, None]
            if e == d or alive.mean() < _FEW or not alive.any():
                a, r = np.nonzero(alive)
                break
        score = self._exact(q, a, rows[r])
        good = score >= least[a]
        return a[good], rows[r[good]], score[good]

    def _exact(self, q: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        for s in range(0, len(a), 1 << 16):
            out[s : s + (1 << 16)] = np.einsum("ij,ij->i", q[a[s : s + (1 << 16)]], self.whole[r[s : s + (1 << 16)]])
        return out


def exact_in_floats(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether no sum of products can leave the integers that floats hold exactly."""
    biggest = lambda m: int(np.abs(m).max(initial=0))
    return biggest(q) * biggest(x) * max(1, q.shape[1]) < EXACT


def windows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, may: Callable[[np.ndarray, np.ndarray], np.ndarray], owner: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each window (owner: its anchor; scores from low to high) its best rows: (window, rows, scores). may(a, r)
    tells which pairs count."""
    index = Index(x)
    top = np.sqrt(np.square(q, dtype=np.float64).sum(axis=1)) * index.norms[:, 0].max(initial=0)
    ceiling, floor = np.full(len(q), -np.inf), np.full(len(q), np.inf)
    np.maximum.at(ceiling, owner, np.minimum(high, top[owner] + 1))
    np.minimum.at(floor, owner, low)
    open_ = np.flatnonzero(np.bincount(owner, minlength=len(q)) > 0)
    of_anchor = np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner, minlength=len(q)))[:-1]) if len(q) else []
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for step in (*STEPS, None):
        if not len(open_):
            break
        least = floor[open_] if step is None else np.maximum(floor[open_], np.where(ceiling[open_] > 0, ceiling[open_] * step, floor[open_]))
        if not exact_in_floats(q, x):
            score = q[open_] @ x.T
            a, r = np.nonzero(score >= least[:, None])
            score = score[a, r]
        else:
            a, r, score = index.reach(q[open_], least)
        good = may(open_[a], r)
        a, r, score = a[good], r[good], score[good]
        order = np.lexsort((ids[r], -score, a))
        a, r, score = a[order], r[order], score[order]
        begin = np.searchsorted(a, np.arange(len(open_) + 1))
        still = []
        for k, anchor in enumerate(open_.tolist()):
            rk, sk = r[begin[k] : begin[k + 1]], score[begin[k] : begin[k + 1]]
            full = True
            for w in of_anchor[anchor].tolist():
                s = int(np.searchsorted(-sk, -high[w], side="left"))
                e = min(s + most, int(np.searchsorted(-sk, -low[w], side="right")))
                out[w] = (rk[s:max(s, e)], sk[s:max(s, e)])
                full &= e - s == most
            if not full and least[k] > floor[anchor]:
                still.append(anchor)
        open_ = np.array(still, np.int64)
    return [(w, *found) for w, found in sorted(out.items()) if len(found[0])]


def _tile(best: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The search of one tile. Anchors: key, label, v, and windows (p, low, high)."""

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        owner = p = key = ids = np.zeros(0, np.int64)
        if len(ours) and len(theirs):
            width = max(1, *(pc.max(pc.list_value_length(c)).as_py() for c in (ours.column("v"), theirs.column("rv"))))
            q, x = matrix(ours.column("v"), width), matrix(theirs.column("rv"), width)
            key, ids = ours.column("key").to_numpy(), theirs.column("rid").to_numpy()
            mine, label, rlabel = theirs.column("rkey").to_numpy(), ours.column("label").to_numpy(), theirs.column("rlabel").to_numpy()
            each = ours.column("asked").to_pylist()
            owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
            p = np.array([w["p"] for x in each for w in x], np.int64)
            low = np.array([-np.inf if w["low"] is None else w["low"] for x in each for w in x], np.float64)
            high = np.array([np.inf if w["high"] is None else w["high"] for x in each for w in x], np.float64)
            may = (lambda a, r: (label[a] == rlabel[r]) & (key[a] != mine[r])) if same else (lambda a, r: label[a] != rlabel[r])
            found = windows(q, x, ids, may, owner, low, high, best)
        n = [len(r) for _, r, _ in found]
        w = np.repeat(np.array([w for w, _, _ in found], np.int64), n)
        r = np.concatenate([r for _, r, _ in found] or [np.zeros(0, np.int64)])
        return pa.table({"key": pa.array(key[owner[w]] if len(w) else w), "p": pa.array(p[w] if len(w) else w), "found": pa.array(ids[r] if len(r) else r), "score": pa.array(np.concatenate([s for _, _, s in found] or [np.zeros(0, np.int64)]))})

    return run


def _search(asked: DataFrame, rows: DataFrame, best: int, same: bool) -> DataFrame:
    """(key, p, found, score, rank): the best rows of every window of asked (key, label, v, asked). Where only rows of
    the anchor's label count, labels are dealt into tiles apart."""
    blocks = lambda c, most: F.greatest(F.ceil(c / most), F.lit(1)).cast("int")
    if same:
        sizes = rows.groupBy("label").agg(blocks(F.count("*"), ROWS).alias("_nj")).join(asked.groupBy("label").agg(blocks(F.count("*"), ANCHORS).alias("_ni")), "label")
        sizes = cut(sizes)
        deal = lambda t: t.join(sizes, "label")
    else:
        ni, nj = asked.agg(blocks(F.count("*"), ANCHORS)).first()[0], rows.agg(blocks(F.count("*"), ROWS)).first()[0]
        deal = lambda t: t.withColumns({"_ni": F.lit(ni), "_nj": F.lit(nj)})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda c, n: F.pmod(F.hash(c), F.col(n))
    first = F.col("label") if same else F.lit(0).cast("long")
    ours = deal(asked).select(first.alias("g"), of("key", "_ni").alias("i"), every("_nj").alias("j"), "key", "label", "v", "asked")
    theirs = deal(rows).select(first.alias("rg"), every("_ni").alias("ri"), of("key", "_nj").alias("rj"), F.col("key").alias("rkey"), F.col("label").alias("rlabel"), F.col("id").alias("rid"), F.col("v").alias("rv"))
    met = ours.groupBy("g", "i", "j").cogroup(theirs.groupBy("rg", "ri", "rj")).applyInArrow(_tile(best, same), "key long, p long, found long, score long")
    order = W.partitionBy("key", "p").orderBy(F.desc("score"), "found")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def integers(vector: str | Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(v.isNotNull() & ~odd, F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "v", label_col: str = "label") -> DataFrame:
    """rows: integer ids and labels, vectors of integers. (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for every anchor and each of its best rows of one label the best rows of other labels whose score
    is from low to high hundredths of the positive's."""
    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<bigint>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    held = held.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", lambda x: x.isNull()), F.lit(True)))
    held = cut(held.withColumn("key", F.xxhash64("id", "label", "v")).dropDuplicates(["key", "id", "label", "v"]))
    anchors = held.where("anchor").select("key", "id", "label", "v")
    window = lambda p, a, b: F.struct(p.cast("long").alias("p"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    any_ = F.array(window(F.lit(0), F.lit(None), F.lit(None)))
    best = cut(_search(anchors.withColumn("asked", any_), held, positives, True).select("key", F.col("rank").cast("long").alias("p"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
    bounds = window(F.col("p"), F.expr(f"({low} * positive_score) div 100 + if(({low} * positive_score) % 100 > 0, 1, 0)"), F.expr(f"({high} * positive_score) div 100 - if(({high} * positive_score) % 100 < 0, 1, 0)"))
    # at most so many windows as an anchor has positives
    asked = best.groupBy("key").agg(F.collect_list(bounds).alias("asked")).withColumn("asked", F.filter("asked", lambda w: w["low"] <= w["high"])).where(F.size("asked") > 0)
    found = _search(anchors.join(asked, "key"), held, negatives, False)
    named = found.join(best, ["key", "p"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return named.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every anchor of embeddings (ids divisible by 100); see the module's defined results for nulls,
    ties, repeated rows and empty tables."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", integers("embedding").alias("v"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


#: The same by DuckDB, pair by pair.
OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10
"""
