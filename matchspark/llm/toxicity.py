"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the byte n-grams (N_GRAMS long) of its lower-cased words with one blank on either side, hashed
to BUCKETS; a feature is there or not. From the training texts each bucket gets the smoothed log ratio of the share
of toxic texts that have it to the share of other texts that have it. Every bucket whose ratio is no chance find
(|z| >= MIN_Z) is a feature, however many these are; a logistic regression over presence times ratio gives the score.
With MIN_Z = 0 all buckets that any text has are features; a test on a small table, and only there, shows the same
verdicts for both.

The classifier is fitted on a bounded sample of labelled rows: about MAX_TRAIN_DOCS, chosen by a hash of the id.
Scoring reads every whole text.

Defined results: a null or empty text has no features and gets the score of the intercept; without labelled rows of
both classes every score is the smoothed base rate. Labels other than 0 and 1 are not used; of repeated labels of an
id the smallest counts, and a null id is never a training row. Rows with null or repeated ids are scored like others,
texts of any length whole; a score of exactly 0.5 is toxic. An empty table gives no rows; other columns are not looked
at, or kept where texts are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm.common import Chunk, chunks, cut, fold, table

N_GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 20
MAX_TRAIN_DOCS = 16_000
MIN_Z = 4.0
SMOOTH = 0.5

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[[c for c in range(128) if not chr(c).isalnum()]] = 32


def grams(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (places, buckets) of the n-grams that hold no blank but at their ends and cross no text's end."""
    # a blank before each text, so that its first word begins with one; runs of blanks need no folding, as n-grams
    # with a blank inside are left out
    n = len(chunk)
    data = np.full(len(chunk.data) + n + 1, 32, np.uint8)
    of = np.repeat(np.arange(n), chunk.ends - chunk.starts)
    data[np.arange(len(chunk.data)) + of + 1] = _CLASS[chunk.data]
    blank = data == 32
    blanks = np.concatenate([[0], np.cumsum(blank, dtype=np.int32)])
    code = data.astype(np.uint64)
    rolled = code.copy()
    for size in range(2, max(N_GRAMS) + 1):
        if len(data) < size:
            return
        rolled = rolled[:-1] << np.uint64(8) | code[size - 1 :]
        if size in N_GRAMS:
            inside = blanks[size - 1 : len(data)] - blanks[1 : len(data) - size + 2] if size > 2 else np.zeros(len(rolled), np.int32)
            at = np.flatnonzero(inside == 0)
            h = rolled[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            yield at, (h >> np.uint64(44)).astype(np.int32)


def present(chunk: Chunk, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) for each bucket that a text has; only buckets with chosen >= 0 if given."""
    found = []
    edges = chunk.starts + np.arange(len(chunk))  # where each text's leading blank lies
    for at, bucket in grams(chunk):
        if chosen is not None:
            keep = chosen[bucket] >= 0
            at, bucket = at[keep], bucket[keep]
        text = np.searchsorted(edges, at, side="right") - 1
        found.append(np.unique(text * np.int64(BUCKETS) + bucket))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // BUCKETS, pairs % BUCKETS


class ToxicityModel:
    def __init__(self, bucket: np.ndarray, weight: np.ndarray, intercept: float) -> None:
        """bucket: those that count; weight: regression weight times log-count ratio."""
        self.bucket, self.weight, self.intercept = bucket, weight, intercept

    def score(self, chunk: Chunk) -> np.ndarray:
        if getattr(self, "_chosen", None) is None:
            self._chosen = np.full(BUCKETS, -1, np.int32)
            self._chosen[self.bucket] = np.arange(len(self.bucket), dtype=np.int32)
        text, bucket = present(chunk, self._chosen)
        z = self.intercept + np.bincount(text, weights=self.weight[self._chosen[bucket]], minlength=len(chunk))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(rows: list[np.ndarray], label: np.ndarray, scale: np.ndarray, rounds: int = 400, ridge: float = 3e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; rows: the features that each text has."""
    n, k = len(rows), len(scale)
    col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    value = scale[col]
    v = np.ones(k + 1)
    for _ in range(20):  # the largest curvature, by power iteration; the last entry is the intercept
        v /= max(1e-12, np.linalg.norm(v))
        seen = v[-1] + np.bincount(of, weights=value * v[:-1][col], minlength=n)
        v = np.append(np.bincount(col, weights=value * seen[of], minlength=k), seen.sum()) / n
    step = 1 / (0.26 * np.linalg.norm(v) + ridge)
    base = float(np.log((label.sum() + 1) / (n - label.sum() + 1)))
    w, b = np.zeros(k), base
    look_w, look_b = w, b
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(look_b + np.bincount(of, weights=value * look_w[col], minlength=n), -40, 40)))
        gap = p - label
        new_w = look_w - step * (np.bincount(col, weights=value * gap[of], minlength=k) / n + ridge * look_w)
        new_b = look_b - step * gap.mean()
        m = (t - 1) / (t + 2)
        look_w, look_b = new_w + m * (new_w - w), new_b + m * (new_b - b)
        w, b = new_w, new_b
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", min_z: float = MIN_Z) -> ToxicityModel:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label"))
    share = min(1.0, max_docs / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000))
    # the ids picked are about max_docs, whatever the size of the corpus, so they are sent to where the texts are
    sample = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(picked), id_col).select(F.col(text_col).alias("text"), F.col("_label").alias("label"))
    sample = cut(sample.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
        for chunk in chunks(batches):
            label = chunk.batch.column(1).to_numpy()
            text, bucket = present(chunk)
            for y in (0, 1):
                held[y] += np.bincount(bucket[label[text] == y], minlength=BUCKETS).astype(np.int32)
                seen[y] += int((label == y).sum())
        some = np.flatnonzero(held.any(axis=0))
        # bucket -1: the texts of each class
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(held[0, some], seen[0]), pa.int64()), pa.array(np.append(held[1, some], seen[1]), pa.int64())], names=["bucket", "clean", "toxic"])

    t = sample.mapInArrow(count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    bucket, clean, toxic = (t.column(c).to_numpy() for c in ("bucket", "clean", "toxic"))
    n0, n1 = (int(x[bucket < 0].sum()) for x in (clean, toxic))
    if not n0 or not n1:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 1) / (n0 + 1))))
    clean, toxic, bucket = clean[bucket >= 0], toxic[bucket >= 0], bucket[bucket >= 0]
    ratio = np.log((toxic + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((clean + SMOOTH) / (n0 + 2 * SMOOTH))
    both = (clean + toxic) / (n0 + n1)
    z = (toxic / n1 - clean / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n0 + 1 / n1))
    keep = np.flatnonzero(np.abs(z) >= min_z)
    keep = keep[np.argsort(bucket[keep])]
    bucket, ratio = bucket[keep].astype(np.int64), ratio[keep]
    sent = docs.sparkSession.sparkContext.broadcast(bucket)

    def list_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.full(BUCKETS, -1, np.int32)
        own[sent.value] = np.arange(len(sent.value), dtype=np.int32)
        for chunk in chunks(batches):
            text, found = present(chunk, own)
            cuts = np.searchsorted(text, np.arange(len(chunk) + 1))
            which = own[found]
            yield pa.RecordBatch.from_arrays([pa.array([which[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), chunk.batch.column(1)], names=["features", "label"])

    rows = sample.mapInArrow(list_features, "features binary, label int").toArrow()
    # an order that does not depend on how the rows came in
    held = sorted(zip(rows.column("features").to_pylist(), rows.column("label").to_pylist(), strict=True))
    w, b = _fit([np.frombuffer(x, np.int32) for x, _ in held], np.array([y for _, y in held], np.float64), ratio)
    return ToxicityModel(bucket, w * ratio, b)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted for every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bucket, model.weight, model.intercept))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*sent.value)
        for chunk in chunks(batches, text_col):
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(own.score(chunk))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bucket, model.weight, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*sent.value)
        for chunk in chunks(batches, text_col):
            yield chunk.batch.filter(pa.array(own.score(chunk) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents; labels of held-out rows are not read."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    out = score(table(spark, sf_dir, "documents"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
