"""SimHash near-dedup by a binary trie self-join.

A text's fingerprint has `bits` bits: word shingles are hashed, and a bit is set where more than half of the hashes
have it. The fingerprint is used in words of `word_bits`; two texts are candidates if some word differs in at most
`budget` bits, and are linked if, besides, the whole fingerprints differ in at most `limit` bits.

The join of one word: split the word into budget + 1 pieces; words within the budget agree in some piece, so each
word goes once to every piece's value, which deals the trie out over the cluster below its first levels. Parts that
are still crowded are dealt on by pieces of the bits that are left. In each part the words are sorted, which lays the
binary trie out as ranges, and pairs of nodes are traversed together, level by level: the children's pairs inherit the
bits that differ so far, pairs beyond the budget are pruned, and so are pairs whose leaves are all in one component
already, which keeps clouds of near copies from being compared all with all. A part emits a spanning forest of its
links, nearest first: always fewer links than leaves. Texts with equal fingerprints are one leaf from the start, so
copies cost nothing here.

Components of leaves come from alternating star steps in Spark; ids are looked up at the end.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is linked like any other; a text
with fewer words than a shingle is one shingle; very long texts are read whole. Ids may be of any type that has an
order. Rows with null id link, and are linked through, like any other; their component shows the smallest id that can
be reached, null if there is none. Repeated ids and rows are rows of their own with the same result. An empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm.common import Chunk, chunks, cut, table
from matchspark.llm.components import components

_SEED = 42
_PAIRS = 1 << 19
_LEAF_PAIRS = 32
#: Rows that a task takes up at once, and leaves of one part before it is dealt on by further bits. Neither changes
#: what is found.
_PART_ROWS = 1 << 17
CROWD = 1 << 17


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of `size` words joined by blanks; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), _SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], _SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def _further(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits drawn from a hash; the first are the hash itself."""
    if not k:
        return h
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints_of(each: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of bits/64 numbers for each text, known by its shingles' hashes."""
    counts = np.array([len(h) for h in each])
    out = np.zeros((len(each), bits // 64), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        h = np.concatenate(each)
        at = (np.cumsum(counts) - counts)[some]
        for k in range(bits // 64):
            ones = np.add.reduceat(np.unpackbits(_further(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), at, axis=0, dtype=np.int32)
            out[some, k] = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, size: int = 5, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): fp is the fingerprint's bytes, the highest of each 64 bits first."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text_col):
            fp = fingerprints_of([shingle_hashes(t.lower().split(), size) for t in chunk.texts()], bits)
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array([x.tobytes() for x in fp.astype(">u8")], pa.binary())], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp binary")


def shingle_sets(chunk: Chunk, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    return [np.unique(shingle_hashes(t.lower().split(), size)) for t in chunk.texts()]


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def text_key(text_col: str) -> Column:
    """What tells texts apart: a hash of the whole text, '' for none."""
    return F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))


def set_fingerprints(docs: DataFrame, size: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, shingle_set, fp): a row's id and text_key, a hash of its set of shingles, and the fingerprint in which
    each counts once."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            each = shingle_sets(chunk, size)
            fp = fingerprints_of(each, bits)
            yield pa.RecordBatch.from_arrays([*chunk.batch.columns[:2], pa.array([set_key(x) for x in each], pa.binary()), pa.array([x.tobytes() for x in fp.astype(">u8")], pa.binary())], names=["id", "key", "shingle_set", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, key string, shingle_set binary, fp binary")


class Forest:
    """Components of leaves 0 to n - 1; each is known by its first leaf."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self._changes: np.ndarray | None = None

    def join(self, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> None:
        """Connect each a with its b; of the links between two components the nearest is kept as an edge."""
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, far, la, lb = a[apart], b[apart], far[apart], la[apart], lb[apart]
            high, low = np.maximum(la, lb), np.minimum(la, lb)
            order = np.lexsort((low, far, high))
            one = order[np.append(True, high[order][1:] != high[order][:-1])]
            root = np.arange(len(self.label))
            root[high[one]] = low[one]
            self.edges.append((a[one], b[one]))
            while not np.array_equal(up := root[root], root):
                root = up
            self.label = root[self.label]
            self._changes = None

    def one(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the leaves lo to hi - 1 are all in one component."""
        if self._changes is None:
            self._changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        return self._changes[hi - 1] == self._changes[lo]


class Every(Forest):
    """All links between leaves of different labels; the labels stay as they are."""

    def __init__(self, label: np.ndarray) -> None:
        super().__init__(len(label))
        self.label = label

    def join(self, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> None:
        self.edges.append((a, b))


def trie_join(key: np.ndarray, low: np.ndarray, levels: int, whole: np.ndarray, budget: int, limit: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (pairs of places) of the links between leaves sorted by (key, low): within each key, leaves
    link if low differs in at most budget bits and whole in at most limit. With labels: all links between leaves of
    different labels."""
    n = len(key)
    forest = Forest(n) if label is None else Every(label)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    stop = np.append(begin[1:], n)
    many = stop - begin > 1
    roots = (begin[many], stop[many])
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((low >> np.uint64(levels - 1 - level)) & np.uint64(1), dtype=np.int32)])
        return hi - (ones[level][hi] - ones[level][lo])

    def leaves(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> None:
        """Compare leaf by leaf, so many pairs at a time."""
        rows = np.repeat(np.arange(len(al)), ah - al)
        i = np.arange(len(rows)) - np.repeat(np.cumsum(ah - al) - (ah - al), ah - al) + np.repeat(al, ah - al)
        first, last = np.where(bl[rows] == al[rows], i + 1, bl[rows]), bh[rows]
        width = np.maximum(last - first, 0)
        total = np.concatenate([[0], np.cumsum(width)])
        s = 0
        while s < len(i):
            e = max(s + 1, int(np.searchsorted(total, total[s] + _PAIRS, side="right")) - 1)
            w = width[s:e]
            a = np.repeat(i[s:e], w)
            b = np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[s:e], w)
            apart = forest.label[a] != forest.label[b]
            a, b = a[apart], b[apart]
            near = np.bitwise_count(low[a] ^ low[b]) <= budget
            a, b = a[near], b[near]
            far = np.bitwise_count(whole[a] ^ whole[b]).sum(axis=1, dtype=np.int32)
            near = far <= limit
            forest.join(a[near], b[near], far[near])
            s = e

    stack = [(0, roots[0], roots[1], roots[0], roots[1], np.zeros(len(roots[0]), np.int8))]
    while stack:
        level, al, ah, bl, bh, diff = stack.pop()
        done = forest.one(al, ah) & forest.one(bl, bh) & (forest.label[al] == forest.label[bl])
        live = ~done
        al, ah, bl, bh, diff = al[live], ah[live], bl[live], bh[live], diff[live]
        small = ((ah - al) * (bh - bl) <= _LEAF_PAIRS) | (level >= levels)
        if small.any():
            leaves(al[small], ah[small], bl[small], bh[small])
        al, ah, bl, bh, diff = (x[~small] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        am, bm = split(al, ah, level), split(bl, bh, level)
        same = al == bl
        parts = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1)]
        parts.append(tuple(x[~same] for x in (am, ah, bl, bm, diff + 1)))
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (diff <= budget) & (ah > al) & (bh > bl) & ~((al == bl) & (ah - al < 2))
        al, ah, bl, bh, diff = (x[keep] for x in (al, ah, bl, bh, diff))
        for s in range(0, len(al), _PAIRS):
            stack.append((level + 1, *(x[s : s + _PAIRS] for x in (al, ah, bl, bh, diff))))
    return tuple(np.concatenate([e[k] for e in forest.edges] or [np.zeros(0, np.int64)]) for k in (0, 1))


def _piece_masks(free: int, pieces: int) -> list[int]:
    """The set bits of free, low to high, cut into so many pieces of like size; the last takes what is left over."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    size = len(bits) // pieces
    return [sum(bits[k * size : (k + 1) * size if k < pieces - 1 else len(bits)]) for k in range(pieces)]


def _squeezed(word: np.ndarray, fixed: int, width: int) -> tuple[np.ndarray, int]:
    """The bits of the words that are not fixed, pushed together in their order; and how many these are."""
    out, n, at = np.zeros(len(word), np.uint64), 0, 0
    while at < width:
        if fixed >> at & 1:
            at += 1
            continue
        run = 1
        while at + run < width and not fixed >> (at + run) & 1:
            run += 1
        out |= (word >> np.uint64(at) & np.uint64((1 << run) - 1)) << np.uint64(n)
        n, at = n + run, at + run
    return out, n


def _words(fp: np.ndarray, w: int, word_bits: int) -> np.ndarray:
    at = w * word_bits
    return (fp[:, at // 64] >> np.uint64(at % 64)) & np.uint64((1 << word_bits) - 1)


def _as_words(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, bits // 64)


def _deal(leaves: DataFrame, bits: int, word_bits: int, budget: int) -> DataFrame:
    """A row for each leaf and each part that it belongs to: the word, which bits of it are fixed, and their value. Two
    words within the budget are alike in some piece, so they meet in a part. Parts that are crowded (over CROWD leaves)
    are dealt on by pieces of the bits not fixed yet, by the same rule, so that no part has to hold what many leaves
    have in common."""
    pieces = budget + 1
    columns = ["fp", "node", *(["comp"] if "comp" in leaves.columns else [])]
    dealt_as = "word int, fixed long, value long, fp binary, node long" + (", comp long" if "comp" in columns else "")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.schema.names[0] == "fp"  # leaves; else rows of crowded parts
            own = batch if first else batch.select(columns)
            fp = _as_words(own.column(0), bits)
            parts = [(w, 0, np.arange(len(fp))) for w in range(bits // word_bits)]
            if not first:
                word, fixed = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                parts = [(int(w), int(f) & 0xFFFFFFFFFFFFFFFF, np.flatnonzero((word == w) & (fixed == f))) for w, f in sorted(set(zip(word.tolist(), fixed.tolist(), strict=True)))]
            for w, fixed, at in parts:
                word = _words(fp[at], w, word_bits)
                rows = own if first else own.take(pa.array(at))
                for piece in _piece_masks(((1 << word_bits) - 1) & ~fixed, pieces):
                    mask = np.uint64(fixed | piece)
                    ids = [pa.array(np.full(len(at), x)) for x in (np.int32(w), mask.view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array((word & mask).view(np.int64)), *rows.columns], names=["word", "fixed", "value", *columns])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many leaves go to each part, summed over what is dealt at once."""
        for out in deal(batches):
            value, n = np.unique(out.column(2).to_numpy(), return_counts=True)
            ids = [pa.array(np.full(len(value), out.column(k)[0].as_py(), t)) for k, t in ((0, np.int32), (1, np.int64))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(value), pa.array(n)], names=["word", "fixed", "value", "size"])

    key = ["word", "fixed", "value"]
    rows, calm_parts = leaves.select(*columns), []
    while True:
        dealt = rows.mapInArrow(deal, dealt_as)
        size = rows.mapInArrow(sizes, "word int, fixed long, value long, size long").groupBy(*key).agg(F.sum("size").alias("size"))
        crowded = cut(size.where((F.col("size") > CROWD) & (F.bit_count("fixed") + pieces <= word_bits)).select(*key))
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, calm_parts, dealt)
        calm_parts.append(dealt.join(crowded, key, "left_anti"))
        rows = cut(dealt.join(crowded, key, "left_semi"))


def links(leaves: DataFrame, bits: int, word_bits: int, budget: int, limit: int) -> DataFrame:
    """leaves: (fp, node), one row for each fingerprint. (a, b), a > b: enough links to connect whatever is linked; where
    leaves have components (comp), all links between leaves of different ones."""
    labelled = "comp" in leaves.columns

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            # parts come sorted; those that are complete go as soon as there are enough of them
            for piece in (batch.slice(s, _PART_ROWS) for s in range(0, batch.num_rows, _PART_ROWS)):
                held.append(piece)
                rows += piece.num_rows
                if rows >= _PART_ROWS:
                    t = pa.Table.from_batches(held).combine_chunks()
                    keys = [t.column(k).to_numpy() for k in range(3)]
                    edge = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1]))
                    if len(edge):
                        upto = int(edge[-1]) + 1
                        yield from parts(t.slice(0, upto))
                        t = t.slice(upto)
                    held, rows = t.to_batches(), t.num_rows
        if rows:
            yield from parts(pa.Table.from_batches(held))

    def parts(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of whole parts: all that have the same word and fixed bits at once."""
        word, fixed = t.column("word").to_numpy(), t.column("fixed").to_numpy()
        edge = np.flatnonzero((word[1:] != word[:-1]) | (fixed[1:] != fixed[:-1])) + 1
        for a, b in itertools.pairwise([0, *edge.tolist(), len(word)]):
            if b - a > 1:
                yield joined(t.slice(a, b - a), int(word[a]), int(fixed[a]) & 0xFFFFFFFFFFFFFFFF)

    def first_meeting(differ: np.ndarray, w: int, fixed: int) -> np.ndarray:
        """Of pairs by the bits in which they differ, those that meet in no earlier word and, unless a part was dealt
        on, in no earlier piece of this one, so that a pair counts about once."""
        here = np.ones(len(differ), bool)
        for earlier in range(w):
            here &= np.bitwise_count(_words(differ, earlier, word_bits)) > budget
        masks = _piece_masks((1 << word_bits) - 1, budget + 1)
        if fixed in masks:
            for mask in masks[: masks.index(fixed)]:
                here &= (_words(differ, w, word_bits) & np.uint64(mask)) != 0
        return here

    def joined(t: pa.Table, w: int, fixed: int) -> pa.RecordBatch:
        value, node = (t.column(c).to_numpy() for c in ("value", "node"))
        whole = _as_words(t.column("fp"), bits)
        low, levels = _squeezed(_words(whole, w, word_bits), fixed, word_bits)
        order = np.lexsort((node, low, value))
        label = t.column("comp").to_numpy()[order] if labelled else None
        a, b = trie_join(value[order], low[order], levels, whole[order], budget, limit, label)
        if labelled:
            here = first_meeting(whole[order][a] ^ whole[order][b], w, fixed)
            a, b = a[here], b[here]
        a, b = node[order][a], node[order][b]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    key = ["word", "fixed", "value"]
    dealt = _deal(leaves, bits, word_bits, budget).repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(join, "a long, b long").distinct()


def leaves_of(fps: DataFrame, id_col: str) -> DataFrame:
    """One leaf for each fingerprint: node, a number of its own, and first, the smallest id that has it (null if none of
    its rows has one)."""
    return cut(fps.groupBy("fp").agg(F.min(id_col).alias("first")).withColumn("node", F.monotonically_increasing_id()))


def group(fps: DataFrame, bits: int = 64, word_bits: int = 64, budget: int = 3, limit: int = 3, id_col: str = "doc_id") -> DataFrame:
    """fps (id_col, fp) with component_id: the smallest id that can be reached over links, of whatever type ids are."""
    leaves = leaves_of(fps, id_col)
    roots = components(links(leaves, bits, word_bits, budget, limit))
    rooted = leaves.join(roots, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(least, "_root").select("fp", "component_id"), "fp")


#: Near copies: five-word shingles, similarity 0.8 or more. That makes fingerprints differ in 15.2 % of their bits on
#: average; candidates may differ in NEAR_LIMIT of NEAR_BITS (18.8 %), and the shingles themselves decide.
NEAR_BITS = 384
NEAR_WORD_BITS = 32
NEAR_LIMIT = 72
NEAR_BUDGET = 3
NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8


def sets_of(leaves: DataFrame, docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """(node, shingles) of leaves (node, shingle_set, key), read from one text of each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            each = shingle_sets(chunk, size)
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in each], pa.binary()), pa.array([x.tobytes() for x in each], pa.binary())], names=["shingle_set", "shingles"])

    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")).join(leaves.select("key").distinct(), "key", "left_semi")
    held = texts.select("text").mapInArrow(sets, "shingle_set binary, shingles binary").groupBy("shingle_set").agg(F.min("shingles").alias("shingles"))
    return leaves.select("node", "shingle_set").join(held, "shingle_set").select("node", "shingles")


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets of shingles have that similarity (Jaccard) at least."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def judge(found: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """found (a, b) with same: whether their sets of shingles have that similarity at least."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [alike(*(np.frombuffer(v.as_buffer(), np.uint64) for v in xy), least) for xy in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same, pa.bool_())], names=["a", "b", "same"])

    pairs = found.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(held.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long, same boolean")


def verified(leaves: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(node, root): components of leaves (node, fp, shingle_set, key) over candidates that the shingles confirm.

    The trie join gives a forest of candidates. Its links are judged; what passes makes components. Where a link fails,
    the forest may have left out candidates for it, so the trie join runs again over the leaves of such trees and gives
    all candidates between different components, which are judged too. Those are the pairs that look near and are not
    connected, not the pairs of a tree."""
    found = cut(links(leaves, NEAR_BITS, NEAR_WORD_BITS, NEAR_BUDGET, NEAR_LIMIT))
    ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    held = cut(sets_of(leaves.join(ends, "node", "left_semi"), docs, NEAR_SHINGLE, text_col))
    judged = cut(judge(found, held, NEAR_SIMILARITY))
    good, bad = judged.where("same").select("a", "b"), judged.where("not same").select("a", "b")
    roots = cut(components(good))
    if bad.isEmpty():
        return roots
    trees = components(found).withColumnRenamed("root", "tree")
    doubtful = trees.join(bad.select(F.col("a").alias("node")).distinct().join(trees, "node").select("tree").distinct(), "tree", "left_semi").select("node")
    labelled = cut(leaves.join(doubtful, "node", "left_semi").join(roots, "node", "left").select("fp", "node", F.coalesce("root", "node").alias("comp")))
    others = cut(links(labelled, NEAR_BITS, NEAR_WORD_BITS, NEAR_BUDGET, NEAR_LIMIT).join(bad, ["a", "b"], "left_anti"))
    more = cut(judge(others, held, NEAR_SIMILARITY).where("same").select("a", "b"))
    return roots if more.isEmpty() else components(good.union(more))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest id (rows without one come last), of
    rows that share it the one with the smallest text_key, and of rows that repeat both any one. Rows are told apart by
    id and text, so a row whose id another text has too is judged by its own text, and rows without id take part.

    Texts with one set of shingles are copies and one leaf. Fingerprints of NEAR_BITS, in which each distinct shingle
    counts once, are joined word by word (NEAR_WORD_BITS, 3 errors), and the shingles decide."""
    fps = set_fingerprints(docs, NEAR_SHINGLE, NEAR_BITS, id_col, text_col)
    row = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    leaves = cut(fps.groupBy("fp", "shingle_set").agg(F.min("key").alias("key"), F.min(row).alias("row")).withColumn("node", F.monotonically_increasing_id()))
    grouped = leaves.join(verified(leaves, docs, text_col), "node", "left").groupBy(F.coalesce("root", "node").alias("_root"))
    first = grouped.agg(F.min("row").alias("row")).select(F.col("row.id").alias("_first_id"), F.col("row.key").alias("_first_key"))
    name = next(c for c in ("_key", *(f"_key{i}" for i in range(len(docs.columns) + 1))) if c not in docs.columns)
    keyed = docs.withColumn(name, text_key(text_col))
    kept = keyed.join(first, (keyed[name] == first["_first_key"]) & keyed[id_col].eqNullSafe(first["_first_id"]), "left_semi")
    return kept.dropDuplicates([id_col, name]).drop(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of documents."""
    fps = cut(fingerprints(table(spark, sf_dir, "documents"), size=3, bits=64))
    return group(fps).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
