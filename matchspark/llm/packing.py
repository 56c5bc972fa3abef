"""Packing into optimal length buckets.

Each text is cut into sequences of at most MAX_TOKENS tokens, so no token is lost. Spark counts how many sequences
there are of each length: a histogram of at most MAX_TOKENS entries over all texts.
Dynamic programming over it chooses the BUCKETS boundaries that make the padding least. A batch holds sequences of one
bucket, padded to its boundary, and as many of them as fit into TOKEN_BUDGET.

Batches are filled without passing a bucket through one task: a bucket is dealt by a hash of the sequence into parts
of about PART_BATCHES batches (their number follows from the histogram), sequences are numbered within their part, and
each part's last batch may be short.

The pipeline's sequences carry their tokens into the batches; the query op3_packing shows the layout only.

Defined results: a null or empty text has no tokens and no sequences; a text of any length is packed whole. Rows with
equal ids are texts of their own; their sequences are told apart by row_key, a hash of id and text, and repeated rows
are packed as often as they are there, dealt into parts by their repetitions. A null id is packed like any other. Of equally good sets of
boundaries the one with the shorter first buckets is taken. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchspark.llm.common import chunks, cut, table, tokenizer_dir

MAX_TOKENS = 2048
BUCKETS = 16
TOKEN_BUDGET = 32_768
PART_BATCHES = 16

#: The split of a text before byte pairs are merged; a fixed part of this public vocabulary.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def sequences(docs: DataFrame, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, tokens: bool = False) -> DataFrame:
    """(id_col, part, first_token, n_tokens, row_key, salt): a row for each sequence of a text; row_key is a hash of id
    and text, salt one of row_key, part and how often its task met the row before, so that a row repeated very often is
    dealt into many parts. With tokens, the sequence's token ids besides."""
    kind = docs.schema[id_col].dataType.simpleString()
    path = vocabulary or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        met: Counter[int] = Counter()
        for chunk in chunks(batches, text_col):
            each = [enc.encode_ordinary(t.decode("utf-8", "replace")) for t in chunk.texts()]
            n = np.array([len(x) for x in each], np.int64)
            parts = -(-n // max_tokens)
            of = np.repeat(np.arange(len(n)), parts)
            before = np.zeros(len(n), np.int64)
            for i, key in enumerate(chunk.batch.column(2).to_pylist()):
                before[i] = met[key]
                met[key] += 1
            part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            first = part * max_tokens
            size = np.minimum(max_tokens, n[of] - first).astype(np.int32)
            out = [chunk.batch.column(0).take(pa.array(of)), pa.array(part.astype(np.int32)), pa.array(first), pa.array(size), chunk.batch.column(2).take(pa.array(of)), pa.array(before[of])]
            if tokens:
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(each), np.int32, int(n.sum())))))
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = [id_col, "part", "first_token", "n_tokens", "row_key", "_before", *(["tokens"] if tokens else [])]
    rows = docs.select(id_col, text_col, F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("row_key"))
    cut_up = rows.mapInArrow(run, f"{id_col} {kind}, part int, first_token long, n_tokens int, row_key long, _before long" + (", tokens array<int>" if tokens else ""))
    return cut_up.withColumn("salt", F.xxhash64("row_key", "part", "_before")).drop("_before")


def optimal_boundaries(length: np.ndarray, count: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The at most `buckets` boundaries, taken from the lengths (ascending), with the least padding in all."""
    m = len(length)
    if m <= buckets:
        return length
    n, tokens = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * length)])
    best, came = np.full(m + 1, np.inf), []
    best[0] = 0
    for _ in range(buckets):
        now, back = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):  # lengths i to j - 1 padded to length[j - 1]
            total = best[:j] + length[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])
            back[j] = total.argmin()
            now[j] = total[back[j]]
        best = now
        came.append(back)
    out, j = [], m
    for back in reversed(came):
        out.append(length[j - 1])
        j = back[j]
    return np.array(out[::-1])


def pack(seqs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, id_col: str = "doc_id") -> DataFrame:
    """seqs, with their tokens if they have them, with bucket, padded_length, batch_id ("bucket-part-number") and slot, the place in the batch."""
    counted = seqs.groupBy("n_tokens").count().orderBy("n_tokens").collect()
    length, count = (np.array([r[k] for r in counted], np.int64) for k in (0, 1))
    edges = optimal_boundaries(length, count, buckets)
    which = np.searchsorted(edges, length)
    held = np.bincount(which, weights=count, minlength=len(edges))
    plan = [(b, int(e), max(1, token_budget // int(e)), 0) for b, e in enumerate(edges)]
    plan = [(b, e, fits, max(1, -(-int(held[b]) // (fits * PART_BATCHES)))) for b, e, fits, _ in plan]
    spark: SparkSession = seqs.sparkSession
    # one row for each of at most `buckets` buckets
    rules = spark.createDataFrame(plan, "bucket int, padded_length int, _fits int, _parts int")
    bucket = F.lit(None).cast("int")
    for b, e, _, _ in reversed(plan):
        bucket = F.when(F.col("n_tokens") <= e, b).otherwise(bucket)
    dealt = seqs.withColumn("bucket", bucket).join(F.broadcast(rules), "bucket").withColumn("_part", F.pmod("salt", "_parts"))
    place = F.row_number().over(W.partitionBy("bucket", "_part").orderBy("salt", id_col, "part")) - 1
    return (
        dealt.withColumn("_place", place)
        .withColumn("batch_id", F.concat_ws("-", F.col("bucket"), F.col("_part"), F.floor(F.col("_place") / F.col("_fits"))))
        .withColumn("slot", (F.col("_place") % F.col("_fits")).cast("int"))
        .select(id_col, "part", "first_token", "n_tokens", "bucket", "padded_length", "batch_id", "slot", "row_key", *(c for c in ("tokens",) if c in seqs.columns))
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout of every sequence of documents: its bucket, batch and slot."""
    return pack(cut(sequences(table(spark, sf_dir, "documents"))))
