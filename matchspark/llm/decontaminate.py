"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters is found in a text if some stretch of the text is within k = floor(ERROR_RATE * m) edits
of it. The item is cut into k + 1 pieces: a stretch within k edits holds one of them unchanged. One automaton finds
all pieces of all items in a single pass over a text; each hit says where the item would lie, hits of an item that
say about the same are taken together, and Myers' bit-parallel distance over that window decides.

Texts and items are compared in lower case with white space squeezed to single blanks. The items are sent to the
tasks in blocks of about BLOCK_CHARS characters, each block a pass of its own over the texts. One block at a time goes
through the driver, and its pass is written before the next begins, so what is sent and held has a bound whatever the
size of the benchmark.

Defined results: null or blank items match nothing, null or blank texts hold nothing; items with equal text match
alike; rows with null or repeated ids are compared like others; texts of any length are compared whole. Of equally
near stretches the first counts. Empty tables give no rows, or leave the texts as they are; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from matchspark.llm.common import chunks, cut, table

ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000

_WORD = re.compile(r"\S+")


def lowered(text: str) -> str:
    """Lower case, letter by letter where that would change the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def normal(text: str) -> str:
    return " ".join(lowered(text).split())


def places(text: str) -> list[int]:
    """For each character of normal(text), and its end, the place in text."""
    out: list[int] = []
    for m in _WORD.finditer(text):
        if out:
            out.append(m.start() - 1)
        out += range(m.start(), m.end())
    return [*out, out[-1] + 1 if out else 0]


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the stretch of text that is nearest to the pattern; the first of the nearest."""
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    def __init__(self, items: list[tuple[Any, str]], rate: float) -> None:
        by_text: dict[str, list[Any]] = {}
        for item, text in items:
            if t := normal(text or ""):
                by_text.setdefault(t, []).append(item)
        self.texts, self.items = list(by_text), list(by_text.values())
        self.budget = [int(rate * len(t)) for t in self.texts]
        self.forward, self.backward = [masks(t) for t in self.texts], [masks(t[::-1]) for t in self.texts]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (t, k) in enumerate(zip(self.texts, self.budget, strict=True)):
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(t[a:b], []).append((i, b))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[Any, int, int, int]]:
        """(item, edits, start, end in text) of each item's nearest stretch within its budget, the first of such."""
        if not self.texts:
            return []
        low = normal(text)
        begins: dict[int, list[int]] = {}
        for end, where in self.automaton.iter(low):
            for i, b in where:
                begins.setdefault(i, []).append(end + 1 - b)
        found, place = [], None
        for i in sorted(begins):
            hit = self._nearest(i, sorted(set(begins[i])), low)
            if hit:
                place = place or places(text)
                found += [(item, hit[0], place[hit[1]], place[hit[2] - 1] + 1) for item in self.items[i]]
        return found

    def _nearest(self, i: int, begins: list[int], low: str) -> tuple[int, int, int] | None:
        m, k = len(self.texts[i]), self.budget[i]
        best: tuple[int, int, int] | None = None
        a = 0
        while a < len(begins):
            b = a
            while b + 1 < len(begins) and begins[b + 1] - begins[b] <= 2 * k + 1:
                b += 1
            lo, hi = max(0, begins[a] - k), min(len(low), begins[b] + m + k)
            edits, end = myers(self.forward[i], m, low[lo:hi])
            if edits <= k and (best is None or edits < best[0]):
                # the start: the nearest stretch that ends there, read backwards
                _, back = myers(self.backward[i], m, low[max(lo, lo + end - m - k) : lo + end][::-1])
                best = (edits, lo + end - max(1, back), lo + end)
            a = b + 1
        return best


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[Broadcast, bool]]:
    """The items in blocks, one at a time, and whether there are several; a block is sent when it is asked for and
    given up when the next one is."""
    own = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    deal = F.pmod(F.xxhash64("text"), F.lit(n))
    for b in range(n):
        sent = items.sparkSession.sparkContext.broadcast([tuple(r) for r in own.where(deal == b).orderBy("item", "text").collect()])
        yield sent, n > 1
        if n > 1:
            sent.unpersist()


def _each(chunk, matcher: Matcher) -> Iterator[tuple[int, list[tuple[Any, int, int, int]]]]:  # noqa: ANN001
    for i, t in enumerate(chunk.texts()):
        if t and (got := matcher.matches(t.decode("utf-8", "replace"))):
            yield i, got


def find_matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, edits, start, end): a row for each item that a text holds; code points, end exclusive."""
    spark: SparkSession = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_col].dataType)
    schema = f"{id_col} {kind}, {item_col} {item_kind}, edits int, start long, end long"
    out = spark.createDataFrame([], schema)
    for sent, several in _blocks(items, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            matcher = Matcher(sent.value, rate)
            for chunk in chunks(batches, text_col):
                rows = [(i, *hit) for i, got in _each(chunk, matcher) for hit in got]
                if rows:
                    at, item, edits, start, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([chunk.batch.column(0).take(pa.array(at)), pa.array(item, item_type), pa.array(edits, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=[id_col, item_col, "edits", "start", "end"])

        found = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = out.unionAll(cut(found) if several else found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the texts that hold an item; nothing is shuffled."""
    for sent, several in _blocks(items, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            matcher = Matcher(sent.value, rate)
            for chunk in chunks(batches, text_col):
                keep = np.ones(len(chunk), bool)
                keep[[i for i, _ in _each(chunk, matcher)]] = False
                yield chunk.batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        docs = cut(docs) if several else docs
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, edits, start and end of every benchmark item that a text of documents holds."""
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
