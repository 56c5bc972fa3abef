"""Ranked lexical search by dense blocked multiplication.

A term's weight times its impact in a document, summed over the terms of an item, is a product of two matrices. Both
are cut into tiles: a tile of items holds the weights of the terms its items have, a tile of documents the impacts of
those of these terms that its documents have (other columns are left out), and BLAS multiplies them in 64-bit floats.
Weights and impacts are integers, and a tile has so few columns that no partial sum reaches 2^53, so every product is
exact; partial sums are added up as 64-bit integers. Of a tile of documents every item keeps its best k, and of those
of a task again its best k, equal scores by id, so ties at the edge are decided as over all documents.

The documents are read once: a posting list (terms, counts, length) of each goes into a table that holds only terms
that some item may have (told by 2^20 hash bits, a bitmap of fixed size). Document frequencies and lengths are sums
over it. Items go through the driver one block at a time, each of bounded size; a block is one pass over the posting
lists, not over the texts.

Defined results: null and empty texts have no terms, so they neither count as documents nor are found, and such items
find nothing. Texts are read whole, of whatever length. Rows are documents and items of their own, also where ids or
texts are repeated or null: a repeated document is found as often as it occurs, a repeated item gets its answers each
time, ranked alike. A null document id comes after all others of its score. Empty tables give no rows. Other columns
are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchspark.llm.common import chunks, cut, table

#: A term, in bytes of UTF-8: a run of letters, digits and whatever is not ASCII.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BITS = (1 << 20) - 1
#: Weights and items of a block, documents of a tile and columns that are multiplied at once. None changes a result.
BLOCK_TERMS = 1 << 18
BLOCK_ITEMS = 1024
DOCS = 512
COLUMNS = 2048
#: No impact is over this, as tf / (tf + ...) is under 1 and counted in millionths.
MOST_IMPACT = 1_000_000
EXACT = 1 << 53


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text; only A-Z is lower-cased."""
    return TERM.findall(text.lower())


def _bit(term: bytes) -> int:
    return zlib.crc32(term) & _BITS


def item_terms(items: DataFrame, text_col: str = "text") -> DataFrame:
    """(item, term) of distinct texts, each term once; item is a number of the text's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            each = [sorted(set(terms_of(t))) for t in chunk.texts()]
            item = np.repeat(chunk.batch.column(0).to_numpy(), [len(x) for x in each])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([t.decode() for x in each for t in x], pa.string())], names=["item", "term"])

    return items.select("item", F.col(text_col).alias("text")).mapInArrow(run, "item long, term string")


def posting_lists(docs: DataFrame, bits: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of documents with a term: n counts all terms with repeats, the lists hold those terms
    whose hash bit is among bits."""
    asked = bytearray(_BITS + 1)
    for b in bits:
        asked[b] = 1
    sent = docs.sparkSession.sparkContext.broadcast(bytes(asked))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[bytes, bool] = {}
        for chunk in chunks(batches):
            ns, sizes, terms, counts = [], [], [], []
            for text in chunk.texts():
                found = Counter(terms_of(text))
                k = len(terms)
                for term, tf in found.items():
                    yes = wanted.get(term)
                    if yes is None:
                        if len(wanted) > 1 << 18:
                            wanted.clear()
                        yes = wanted[term] = bool(sent.value[_bit(term)])
                    if yes:
                        terms.append(term.decode())
                        counts.append(tf)
                ns.append(found.total())
                sizes.append(len(terms) - k)
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(terms, pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
            out = pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(ns, pa.int64()), *lists], names=["id", "n", "terms", "counts"])
            yield out.filter(pc.greater(out.column(1), 0))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, terms array<string>, counts array<long>")


class Block:
    """Items with their terms' weights: what a task multiplies tiles of documents by."""

    def __init__(self, item: list[int], term: list[str], w: list[int]) -> None:
        self.items, row = np.unique(np.array(item, np.int64), return_inverse=True)
        vocabulary, column = np.unique(np.array(term, object), return_inverse=True)
        self.vocabulary = pa.array(vocabulary.tolist(), pa.string())
        order = np.argsort(column, kind="stable")
        self.row, self.column, self.w = row[order], column[order], np.array(w, np.int64)[order]
        self.begin = np.searchsorted(self.column, np.arange(len(vocabulary) + 1))
        self.wide = max(1, min(COLUMNS, (EXACT - 1) // max(1, MOST_IMPACT * int(self.w.max(initial=0)))))

    def weights(self, columns: np.ndarray) -> np.ndarray:
        """The dense tile (columns x items)."""
        out = np.zeros((len(columns), len(self.items)))
        n = self.begin[columns + 1] - self.begin[columns]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[columns], n)
        out[np.repeat(np.arange(len(columns)), n), self.row[at]] = self.w[at]
        return out

    def scores(self, batch: pa.RecordBatch, all_docs: int, all_terms: int) -> np.ndarray:
        """(documents x items): exact sums of weights times impacts."""
        terms, counts = batch.column(2), batch.column(3)
        size = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        column = pc.fill_null(pc.index_in(terms.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        row, tf = np.repeat(np.arange(len(size)), size), counts.flatten().to_numpy()
        known = column >= 0
        column, row, tf = column[known], row[known], tf[known]
        m = 100 - 90 + (90 * batch.column(1).to_numpy() * all_docs) // all_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        out = np.zeros((batch.num_rows, len(self.items)), np.int64)
        used, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column, impact = row[order], column[order], impact[order]
        for s in range(0, len(used), self.wide):
            a, b = np.searchsorted(column, [s, s + self.wide])
            tile = np.zeros((batch.num_rows, len(used[s : s + self.wide])))
            tile[row[a:b], column[a:b] - s] = impact[a:b]
            out += (tile @ self.weights(used[s : s + self.wide])).astype(np.int64)
        return out


class Best:
    """The best k of every item so far: by score, then id, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """score: (documents x items). What is under the tile's own k-th or the k-th so far cannot be among the best;
        what equals it can."""
        least = self.least
        if len(score) > self.k:
            least = np.maximum(least, np.partition(score, len(score) - self.k, axis=0)[len(score) - self.k])
        doc, item = np.nonzero(score >= least)
        self.parts.append((item, score[doc, item], ids[doc], null[doc]))
        self.rows += len(doc)
        if self.rows > 4 * self.k * len(self.least) + 4096:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        item, score, ids, null = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, null, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        kept = order[place < self.k]
        item, score, ids, null = item[kept], score[kept], ids[kept], null[kept]
        full = place[place < self.k] == self.k - 1
        self.least[item[full]] = score[full]
        self.parts, self.rows = [(item, score, ids, null)], len(kept)
        return self.parts[0]


def ranked(lists: DataFrame, block: Block, all_docs: int, all_terms: int, k: int) -> DataFrame:
    """(item, id, score, rank): the best k documents of every item of the block."""
    sent = lists.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_TERMS weights, or one item's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(sent.value.items), k)
        for batch in batches:
            for s in range(0, batch.num_rows, DOCS):
                tile = batch.slice(s, DOCS)
                ids = tile.column(0)
                best.add(sent.value.scores(tile, all_docs, all_terms), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False))
        item, score, ids, null = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(sent.value.items[item]), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(score)], names=["item", "id", "score"])

    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = lists.select("id", "n", "terms", "counts").mapInArrow(run, "item long, id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(weights: DataFrame) -> int:
    """Into how many blocks items are dealt by a hash, so that none is larger than it may be but for a single item."""
    sizes = weights.groupBy("item").agg(F.count("*").alias("n"))
    items, n = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_TERMS), -(-items // BLOCK_ITEMS))
    while blocks < items:
        each = sizes.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("items"))
        if not each.where((F.col("n") > 2 * BLOCK_TERMS) | (F.col("items") > 2 * BLOCK_ITEMS)).where("items > 1").limit(1).count():
            break
        blocks *= 2
    return blocks


def search(items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of every item."""
    named = items.select(F.col(item_id).alias("item_id"), F.col(text_col).alias("_text")).where("_text is not null")
    texts = cut(named.select("_text").distinct().withColumn("item", F.monotonically_increasing_id()))
    asked = cut(item_terms(texts, "_text"))
    bits = [r[0] for r in asked.select((F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(_BITS))).cast("int")).distinct().collect()]  # at most 2^20
    lists = cut(posting_lists(docs, bits, id_col, text_col))
    all_docs, all_terms = lists.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * all_docs) + 2) / (2 * F.col("df") + 1)))
    weights = cut(asked.join(df, "term").select("item", "term", weight.alias("w")).where("w > 0"))
    n = _blocks(weights)
    found = []
    for b in range(n):
        mine = weights.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b).collect()
        if mine:
            found.append(cut(ranked(lists, Block(*zip(*((r.item, r.term, r.w) for r in mine), strict=True)), all_docs, all_terms, k)))
    if not found:
        found = [texts.select("item", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)]
    answers = reduce(DataFrame.unionByName, found).join(texts, "item").join(named, "_text")
    return answers.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item; see the module's defined results for nulls, ties, repeated rows
    and empty tables."""
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The same by DuckDB, term by term.
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
full_ AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM full_),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, nn),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL)),
s AS (
  SELECT q.item_id, f.doc_id, f.r, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + ((90 * f.n * c.nn) // c.ll)))))::BIGINT AS score
  FROM q JOIN w ON w.term = q.term JOIN tf ON tf.term = q.term JOIN full_ f ON f.r = tf.r, corpus c GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
