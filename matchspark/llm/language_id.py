"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of order 2 is learned: how often each byte followed each context of two,
one and no bytes. A text costs, under one language, the sum over its bytes of -log2 p(byte | context): the longest
known context is asked first; where the byte was never seen in it, the escape probability (method C: distinct
followers against all followers) is paid and the next shorter context is asked, at last the uniform byte. The
statistics are frozen: scoring changes nothing, so a text's code length does not depend on other texts. No symbols
are excluded after an escape.

The counts come from every training text. Contexts of two bytes and their followers are at most 2^24 trigrams a
language by construction, so the tree that is sent to the tasks has a bound that does not depend on the corpus
(in practice some ten thousand rows).

Defined results: null text or text without a letter gives ("und", 0.0); no training rows gives "und" for all; rows
with null or repeated ids and repeated rows are scored like any other (and counted as often as they are there); texts
of any length are read whole; ties go to the language first in sort order. An empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm.common import Chunk, chunks, fold, table

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def trigrams(chunk: Chunk) -> np.ndarray:
    """For each byte, (second last << 16 | last << 8 | byte); bytes before a text's start count as 0."""
    low = _LOWER[chunk.data]
    last, second = np.zeros_like(low), np.zeros_like(low)
    last[1:], second[2:] = low[:-1], low[:-2]
    some = chunk.ends > chunk.starts
    first = chunk.starts[some]
    last[first] = second[first] = 0
    second[(first + 1)[chunk.ends[some] > first + 1]] = 0
    return second << 16 | last << 8 | low


def count_trigrams(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows; each task sums what it has read before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return gram, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(gram)).astype(np.int64)

        for chunk in chunks(batches, text_col):
            grams = trigrams(chunk)
            langs = np.array(chunk.batch.column(1).to_pylist(), dtype=object)
            of = np.repeat(np.arange(len(chunk)), chunk.ends - chunk.starts)
            for lang in set(langs):
                parts = held.setdefault(lang, [])
                parts.append(np.unique(grams[(langs == lang)[of]], return_counts=True))
                if len(parts) >= 16:
                    held[lang] = [merged(parts)]
        for lang, parts in held.items():
            gram, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int32)), pa.array(n)], names=["lang", "gram", "n"])

    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """The frozen trees of all languages as cost tables: rows are contexts or trigrams, columns languages; bits."""

    def __init__(self, langs: list[str], gram: np.ndarray, n: np.ndarray) -> None:
        """n: counts, a row for each trigram of gram (sorted) and a column for each language."""
        self.langs, self.gram = langs, gram
        k = len(langs)
        self.cost2, self.escape2, self.cost1 = np.zeros((len(gram), k), np.float32), np.zeros((1 << 16, k), np.float32), np.zeros((1 << 16, k), np.float32)
        for j in range(k):
            c3 = n[:, j].astype(np.float64)
            c2 = np.bincount(gram & 0xFFFF, weights=c3, minlength=1 << 16)
            c1 = np.bincount(np.arange(1 << 16) & 0xFF, weights=c2, minlength=256)
            with np.errstate(divide="ignore", invalid="ignore"):
                total0, kinds0 = c1.sum(), (c1 > 0).sum()
                cost0 = np.where(c1 > 0, -np.log2(c1 / (total0 + kinds0)), 8 + np.log2((total0 + kinds0) / max(1, kinds0)))
                total1, kinds1 = c2.reshape(256, 256).sum(1), (c2.reshape(256, 256) > 0).sum(1)
                escape1 = np.where(total1 > 0, np.log2((total1 + kinds1) / kinds1), 0.0)
                c2s, at1 = c2, np.arange(1 << 16) >> 8
                cost1 = np.where(c2s > 0, -np.log2(c2s / (total1 + kinds1)[at1]), escape1[at1] + cost0[np.arange(1 << 16) & 0xFF])
                at2 = gram >> 8
                total2, kinds2 = np.bincount(at2, weights=c3, minlength=1 << 16), np.bincount(at2, weights=c3 > 0, minlength=1 << 16)
                escape2 = np.where(total2 > 0, np.log2((total2 + kinds2) / kinds2), 0.0)
                self.cost2[:, j] = np.where(c3 > 0, -np.log2(c3 / (total2 + kinds2)[at2]), escape2[at2] + cost1[gram & 0xFFFF])
            self.escape2[:, j], self.cost1[:, j] = escape2, cost1

    def row_of(self) -> np.ndarray:
        """Trigram to its row of cost2, -1 if no language has it; made once in each Python worker."""
        if getattr(self, "_rows", None) is None:
            self._rows = np.full(1 << 24, -1, np.int32)
            self._rows[self.gram] = np.arange(len(self.gram), dtype=np.int32)
        return self._rows

    def bits(self, chunk: Chunk) -> np.ndarray:
        """Exact code length of each text under each language."""
        grams = trigrams(chunk)
        row = self.row_of()[grams]
        cost = self.cost2[row]
        new = np.flatnonzero(row < 0)
        if len(new):
            cost[new] = self.escape2[grams[new] >> 8] + self.cost1[grams[new] & 0xFFFF]
        return chunk.sums(cost, np.float64)


def learn_trees(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> ContextTrees:
    t = count_trigrams(labelled, text_col, lang_col).toArrow()
    lang, gram, n = t.column("lang").to_pylist(), t.column("gram").to_numpy().astype(np.int64), t.column("n").to_numpy()
    langs = sorted(set(lang))
    col = {x: i for i, x in enumerate(langs)}
    grams, at = np.unique(gram, return_inverse=True)
    counts = np.zeros((len(grams), len(langs)), np.int64)
    counts[at, np.array([col[x] for x in lang], np.int64)] = n
    return ContextTrees(langs, grams, counts)


def _has_letter(chunk: Chunk) -> np.ndarray:
    some = chunk.sums(_ASCII_LETTER[chunk.data]) > 0
    for i in np.flatnonzero(~some & (chunk.ends > chunk.starts)):
        some[i] = any(c.isalpha() for c in chunk.data[chunk.starts[i] : chunk.ends[i]].tobytes().decode("utf-8", "replace"))
    return some


def identify(docs: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score: the posterior of the language with the shortest code, all languages alike before."""
    spark: SparkSession = docs.sparkSession
    sent: Broadcast = spark.sparkContext.broadcast(trees)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ContextTrees = sent.value
        for chunk in chunks(batches, text_col):
            named = _has_letter(chunk) & bool(model.langs)
            if model.langs:
                bits = model.bits(chunk)
                best = bits.argmin(1)
                score = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000.0)).sum(1)
                pred = np.array(model.langs, dtype=object)[best]
            else:
                pred, score = np.full(len(chunk), "und", object), np.zeros(len(chunk))
            pred[~named] = "und"
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(np.where(named, score, 0.0))], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of documents; held-out rows' languages are not read."""
    docs = table(spark, sf_dir, "documents")
    trees = learn_trees(docs.where(fold("doc_id", 4) != 2))
    out = identify(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
