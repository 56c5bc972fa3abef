"""Ranking, agreement and extraction metrics. Undefined values are null, never zero; means skip nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchspark.operators.ranking import tied_ranks

RELEVANT_AT = 2


def ranked_labels(scored: DataFrame, keys: list[str], score: str, item: str) -> DataFrame:
    """scored with rank from 1: best score first, smaller item at ties."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), F.asc(item))))


def precision_at_k(ranked: DataFrame, keys: list[str], k: int, label: str = "label") -> DataFrame:
    top = ranked.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if((F.col("rank") <= k) & (F.col(label) >= RELEVANT_AT)).alias("_hits"))
    return top.select(*keys, F.when(F.col("_n") >= k, F.col("_hits") / k).alias(f"precision_at_{k}"))


def _gain(label: str, rank: str) -> Column:
    return (F.pow(F.lit(2.0), F.col(label)) - 1) / F.log2(F.col(rank) + 1.0)


def ndcg_at_k(ranked: DataFrame, keys: list[str], k: int, item: str, label: str = "label") -> DataFrame:
    """Against the best order of the same labels; null where nothing could be gained."""
    ideal = ranked.withColumn("_best", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(label), F.asc(item))))
    sums = ideal.groupBy(*keys).agg(F.sum(F.when(F.col("rank") <= k, _gain(label, "rank"))).alias("_dcg"), F.sum(F.when(F.col("_best") <= k, _gain(label, "_best"))).alias("_ideal"))
    return sums.select(*keys, F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).alias(f"ndcg_at_{k}"))


def reciprocal_rank(ranked: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """0 where nothing relevant was ranked: that is an outcome, not missing data."""
    first = F.min(F.when(F.col(label) >= RELEVANT_AT, F.col("rank")))
    return ranked.groupBy(*keys).agg(F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"))


def recall_curve(ranked: DataFrame, keys: list[str], ks: list[int], label: str = "label") -> DataFrame:
    """(keys, k, recall) for all k from one ranking."""
    wanted = F.col(label) >= RELEVANT_AT
    sums = ranked.groupBy(*keys).agg(F.count_if(wanted).alias("_all"), *(F.count_if(wanted & (F.col("rank") <= k)).alias(f"_{k}") for k in ks))
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.col("_all") > 0, F.col(f"_{k}") / F.col("_all")).alias("recall")) for k in ks))
    return sums.select(*keys, F.inline(rows))


def pearson(df: DataFrame, keys: list[str], a: str, b: str, name: str = "pearson") -> DataFrame:
    """Null where a side is constant: its correlation would be rounding dust."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))).alias(name))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b).select("*", tied_ranks(a, keys, "_ra"), tied_ranks(b, keys, "_rb"))
    return pearson(both, keys, "_ra", "_rb", "spearman")


def mean_absolute_error(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"))


def threshold_sweep(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1) in one pass over df; thresholds are inclusive."""
    t, s = F.col(truth), F.col(score)
    counted = df.agg(*(F.count_if(p).alias(f"{n}_{i}") for i, x in enumerate(thresholds) for n, p in (("tp", t & (s >= x)), ("fp", ~t & (s >= x)), ("fn", t & (s < x)), ("tn", ~t & (s < x)))))
    rows = counted.select(F.inline(F.array(*(F.struct(F.lit(x).alias("threshold"), *(F.col(f"{n}_{i}").alias(n) for n in ("tp", "fp", "fn", "tn"))) for i, x in enumerate(thresholds)))))
    c = F.col
    return rows.select("*", F.try_divide(c("tp"), c("tp") + c("fp")).alias("precision"), F.try_divide(c("tp"), c("tp") + c("fn")).alias("recall"), F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"))


def set_prf(predicted: DataFrame, gold: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, hits, precision, recall, f1) of each doc's predicted set against its gold set. Null is like no other item.

    Both sets are summed by item in one pass, with no join and no sort of either."""
    both = predicted.select(doc, item, F.lit(True).alias("_p"), F.lit(False).alias("_g")).union(gold.select(doc, item, F.lit(False), F.lit(True)))
    each = both.groupBy(doc, item).agg(F.bool_or("_p").alias("_p"), F.bool_or("_g").alias("_g"))
    met = F.col("_p") & F.col("_g") & F.col(doc).isNotNull() & F.col(item).isNotNull()
    n = each.groupBy(doc).agg(F.count_if("_p").alias("_np"), F.count_if("_g").alias("_ng"), F.count_if(met).alias("hits"))
    precision = F.when(F.col("_np") > 0, F.col("hits") / F.col("_np")).when(F.col("_ng") == 0, 1.0).otherwise(0.0)
    recall = F.when(F.col("_ng") > 0, F.col("hits") / F.col("_ng")).otherwise(1.0)
    return n.select(doc, "hits", precision.alias("precision"), recall.alias("recall")).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def extraction_errors(predicted: DataFrame, gold: DataFrame, doc: str, item: str) -> DataFrame:
    """(kind, item, n): false positives and false negatives by item."""
    p, g = predicted.select(doc, item).distinct(), gold.select(doc, item).distinct()
    wrong, missed = p.exceptAll(g).withColumn("kind", F.lit("false_positive")), g.exceptAll(p).withColumn("kind", F.lit("false_negative"))
    return wrong.unionByName(missed).groupBy("kind", item).agg(F.count("*").alias("n"))


def length_baseline(df: DataFrame, keys: list[str], item: str, length: str, mark: str) -> DataFrame:
    """df with guess: the k-th longest gets the k-th best mark; equal lengths share their marks' mean."""
    by_length = df.select(*keys, item, length, F.row_number().over(W.partitionBy(*keys).orderBy(length, item)).alias("_k"))
    by_mark = df.select(*keys, F.col(mark).alias("_m"), F.row_number().over(W.partitionBy(*keys).orderBy(mark, item)).alias("_k"))
    return by_length.join(by_mark, [*keys, "_k"]).select(*keys, item, F.avg("_m").over(W.partitionBy(*keys, length)).alias("guess"))


def constant_baseline(df: DataFrame, mark: str) -> DataFrame:
    mean = df.agg(F.avg(mark).alias("guess"))
    return df.crossJoin(mean)


def ablate(long: DataFrame, keys: list[str], item: str, dimension: str = "dimension", score: str = "score", weight: str = "weight") -> DataFrame:
    """(keys, item, dropped, score): the score without each dimension, the others' weights made to sum to 1."""
    sums = long.groupBy(*keys, item).agg(F.sum(F.col(score) * F.col(weight)).alias("_s"), F.sum(weight).alias("_w"))
    return long.join(sums, [*keys, item]).select(*keys, item, F.col(dimension).alias("dropped"), ((F.col("_s") - F.col(score) * F.col(weight)) / (F.col("_w") - F.col(weight))).alias("score"))


def ablation_ndcg(ablated: DataFrame, full: DataFrame, labels: DataFrame, keys: list[str], item: str, k: int = 10) -> DataFrame:
    """(dropped, ndcg, change): NDCG@k with each dimension left out, the mean over keys, and how it differs from that
    of the full score ("none"). ablated (keys, item, dropped, score) is ranked anew for each dimension; labels (keys or
    a part of them, item, label) judge the ranks."""
    scored = ablated.select(*keys, item, "dropped", "score").union(full.select(*keys, item, F.lit("none"), "score"))
    judged = scored.join(labels, [c for c in (*keys, item) if c in labels.columns])
    each = ndcg_at_k(ranked_labels(judged, [*keys, "dropped"], "score", item), [*keys, "dropped"], k, item)
    means = each.groupBy("dropped").agg(F.avg(f"ndcg_at_{k}").alias("ndcg"))
    whole = means.where("dropped = 'none'").select(F.lit(0).alias("_one"), F.col("ndcg").alias("_full"))
    return means.withColumn("_one", F.lit(0)).join(F.broadcast(whole), "_one", "left").select("dropped", "ndcg", (F.col("ndcg") - F.col("_full")).alias("change"))


def pair_digest(pairs: DataFrame, *keys: Column) -> DataFrame:
    """Twelve hex digits that name a set of pairs, whatever their order: their number and the exclusive or of their
    hashes, four lanes of 60 bits, so that nothing is gathered in one place."""
    hashed = pairs.select(F.sha2(F.concat_ws("|", *keys), 256).alias("h")).distinct()
    lanes = [F.bit_xor(F.conv(F.substring("h", at, 15), 16, 10).cast("long")).cast("string") for at in (1, 16, 31, 46)]
    summed = hashed.agg(F.concat_ws("|", F.count("*").cast("string"), *(F.coalesce(x, F.lit("")) for x in lanes)).alias("_s"))
    return summed.select(F.substring(F.sha2("_s", 256), 1, 12).alias("digest"))
