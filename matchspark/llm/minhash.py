"""MinHash near-dedup by a multi-index Hamming join.

A text is its set of distinct word shingles; texts with one set are one leaf from the start. A leaf's signature has
`chunks * width` places of b bits each: the lowest b bits of the least hash of the set under as many hash functions.
Two sets of similarity s differ in each place with probability 1 - s at most, so links are pairs whose signatures are
near in Hamming distance (places that differ).

The join: a signature is split into chunks. By the pigeonhole principle signatures that differ in fewer than
chunks * (errors + 1) places have a chunk with `errors` errors at most. The errors that a chunk may have are
enumerated: for each choice of so many places the others are a key, so such a pair is certain to share a key. Leaves
that share a key meet; they are candidates if, besides, their sizes allow the similarity and their whole signatures
are near. The sets themselves decide on every candidate.

Meetings are settled in rounds, so that groups of copies are not compared all with all: first each leaf of a key with
the first and the one before it in order of size, then, among what no link connects yet, forests of candidates between
components, nearest first, and at last all candidates between components that are left. In these rounds leaves that share a key are known by wider signatures, which tell more sharply which pairs can
link. A key that very many leaves share is met in tiles of bounded size, whatever their number. Components come from
alternating star steps in Spark.

Under the settings below, a pair at a similarity of exactly 0.85 shares no key with a probability of 5e-7 and differs
in more places of the wider signature than allowed with 3e-6; both fall fast above it.

Defined results: null and blank texts have no shingles, link with nothing and are their own component; a text with
fewer words than a shingle is one shingle; very long texts are read whole. Ids may be of any type that has an order.
Rows with null id link, and are linked through, like any other; the component shows the smallest id that can be
reached, null if there is none, and such a row is kept only if its component has no id at all. Repeated ids and rows
are rows of their own with the same result. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm.common import chunks, cut, table
from matchspark.llm.components import components
from matchspark.llm.simhash import Forest, set_key, shingle_sets

SHINGLE = 5
#: Sets link if 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85
CHUNKS, WIDTH, ERRORS = 8, 5, 1
PLACES = CHUNKS * WIDTH
#: Places in which the signatures of candidates may differ; and places of 8 bits of the wider ones, and the same there.
LIMIT = 18
WIDE, WIDE_LIMIT = 512, 116
#: Leaves of a side of a tile, of a block of neighbours, and pairs compared at once. None changes a result.
TILE = 2048
_ROWS = 1 << 16
_PAIRS = 1 << 15
#: Hash functions: the k-th place multiplies and mixes by the k-th of these, drawn from a fixed seed.
_DRAWN = np.random.default_rng(11).integers(1, 1 << 63, (PLACES + WIDE, 2), dtype=np.uint64)
_NARROW = slice(0, PLACES), np.uint16
_WIDER = slice(PLACES, PLACES + WIDE), np.uint8


def signatures(sets: list[np.ndarray], which: slice = _NARROW[0], bits: type = _NARROW[1]) -> np.ndarray:
    """(texts x places) of sets of hashes; zeros for empty ones."""
    counts = np.array([len(x) for x in sets])
    out = np.zeros((len(sets), len(_DRAWN[which])), bits)
    some = np.flatnonzero(counts)
    if len(some):
        h = np.concatenate(sets)
        at = (np.cumsum(counts) - counts)[some]
        for k, (flip, times) in enumerate(_DRAWN[which]):
            z = (h ^ flip) * (times | np.uint64(1))
            z ^= z >> np.uint64(32)
            z *= np.uint64(0xD6E8FEB86659FD93)
            out[some, k] = (np.minimum.reduceat(z, at) >> np.uint64(8)).astype(bits)
    return out


def keys_of(signature: np.ndarray) -> np.ndarray:
    """(leaves x keys): for each chunk and each choice of ERRORS of its places, what the other places hold."""
    out = []
    for c in range(CHUNKS):
        part = signature[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64)
        for kept in itertools.combinations(range(WIDTH), WIDTH - ERRORS):
            key = np.full(len(part), len(out) + 1, np.uint64)
            for p in kept:
                key = (key ^ part[:, p]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out.append(key)
    return np.stack(out, axis=1)


def linked(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Whether 100 * intersection >= least * union, for sets as sorted arrays."""
    if 100 * min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= least * (len(x) + len(y) - both)


def described(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set, signature) of every row: the size of its set, a 128-bit hash of it, and its signature."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            each = shingle_sets(chunk, size)
            columns = [pa.array([len(x) for x in each], pa.int64()), pa.array([set_key(x) for x in each], pa.binary()), pa.array([x.tobytes() for x in signatures(each)], pa.binary())]
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), *columns], names=["id", "n", "set", "signature"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, set binary, signature binary")


def shared_keys(leaves: DataFrame) -> DataFrame:
    """(key, node, size) of the keys that more than one leaf has, with how many have it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = keys_of(_matrix(batch.column(1)))
                node = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])

    dealt = leaves.select("node", "signature").mapInArrow(deal, "key long, node long")
    return dealt.join(dealt.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")


def _matrix(column: pa.Array, bits: type = _NARROW[1], places: int = PLACES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), bits).reshape(-1, places)


def _near(t: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, least: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of places those between components that can link, and how far they are apart."""
    n, comp, signature = t["n"], t["comp"], t["signature"]
    may = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]))
    a, b = a[may], b[may]
    far = (signature[a] != signature[b]).sum(axis=1)
    near = far <= limit
    return a[near], b[near], far[near]


def _once(t: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs that meet in a key those for which it is the first that they share, so that each pair counts once."""
    x, y = keys_of(t["narrow"][a]), keys_of(t["narrow"][b])
    first = x[np.arange(len(a)), (x == y).argmax(axis=1)] if len(a) else np.zeros(0, np.uint64)
    here = first.view(np.int64) == t["key"][a]
    return a[here], b[here], far[here]


def _runs(batches: Iterator[pa.RecordBatch], by: list[str], most: int = 1 << 14) -> Iterator[pa.Table]:
    """Rows that come sorted, in tables of whole runs of equal values."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            new = np.flatnonzero(_changes([t.column(c).to_numpy() for c in by]))
            if len(new) > 1:
                yield t.slice(0, int(new[-1]))
                t = t.slice(int(new[-1]))
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal values begins."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _pairs(a: np.ndarray, b: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    u, v = np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])


def neighbours(members: DataFrame, least: int) -> DataFrame:
    """members (key, node, n, signature, size). (a, b): candidates of each leaf with the first and with the one before it
    in its key's order of size; keys with many leaves are dealt into blocks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[str, np.ndarray] | None = None
        before: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = {c: batch.column(c).to_numpy() for c in ("key", "node", "n")} | {"signature": _matrix(batch.column("signature"))}
            kept = 0
            for held in (first, before):
                if held is not None:
                    t = {c: np.concatenate([held[c], t[c]]) for c in t}
                    kept += 1
            t["comp"] = t["node"]
            # the first of a key goes before the row held back from the last batch, both before this batch
            order = np.arange(len(t["key"])) if kept < 2 else np.concatenate([[1, 0], np.arange(2, len(t["key"]))])
            t = {c: v[order] for c, v in t.items()}
            new = _changes([t["key"]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            i = np.arange(kept, len(new))
            a = np.concatenate([i[i > start[i]], i[i - 1 > start[i]]])
            b = np.concatenate([start[i[i > start[i]]], i[i - 1 > start[i]] - 1])
            a, b, _ = _near(t, a, b, least, LIMIT)
            yield _pairs(a, b, t["node"])
            at = start[-1]
            first, before = {c: v[at : at + 1] for c, v in t.items() if c != "comp"}, {c: v[-1:] for c, v in t.items() if c != "comp"}

    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / _ROWS))
    held = members.withColumn("key", F.when(F.col("size") > _ROWS, F.xxhash64("key", block)).otherwise(F.col("key"))).repartition("key").sortWithinPartitions("key", "n", "signature", "node")
    return held.select("key", "node", "n", "signature").mapInArrow(run, "a long, b long").distinct()


def between(members: DataFrame, least: int, forest: bool) -> DataFrame:
    """members (key, node, n, narrow, signature, comp), with wider signatures. (a, b): candidates between components that meet in a key; all of them,
    or of each tile only a forest, nearest first. Keys with many leaves are dealt into tiles of pairs of blocks."""
    spread = members.groupBy("key").agg(F.count("*").alias("_n"), F.min("comp").alias("_c"), F.max("comp").alias("_d")).where("_c < _d")
    tiles = spread.select("key", F.greatest(F.ceil(F.col("_n") / TILE), F.lit(1)).cast("int").alias("_b"))
    dealt = members.join(tiles, "key").withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_j")
    dealt = dealt.select("key", "node", "n", "narrow", "signature", "comp", "_i", other).select("key", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), (F.col("_i") > F.col("_j")).cast("int").alias("side"), "node", "n", "narrow", "signature", "comp")
    by = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, by):
            t = {c: held.column(c).to_numpy() for c in (*by, "side", "node", "n", "comp")} | {"signature": _matrix(held.column("signature").combine_chunks(), _WIDER[1], WIDE), "narrow": _matrix(held.column("narrow").combine_chunks())}
            at = np.arange(len(held))
            begin = np.flatnonzero(_changes([t[c] for c in by]))
            run_of = np.cumsum(_changes([t[c] for c in by])) - 1
            stop = np.append(begin[1:], len(at))[run_of]
            # within a block every later row is a partner; between blocks those of the other side, which come last
            second = begin[run_of] + (np.add.reduceat(1 - t["side"], begin))[run_of]
            start = np.where(t["i"] == t["j"], at + 1, np.where(t["side"] == 0, second, stop))
            width = np.maximum(stop - start, 0)
            total = np.concatenate([[0], np.cumsum(width)])
            s, found = 0, []
            while s < len(at):
                e = max(s + 1, int(np.searchsorted(total, total[s] + _PAIRS, side="right")) - 1)
                a = np.repeat(at[s:e], width[s:e])
                b = np.arange(len(a)) - np.repeat(total[s:e] - total[s], width[s:e]) + np.repeat(start[s:e], width[s:e])
                found.append(_once(t, *_near(t, a, b, least, WIDE_LIMIT)))
                s = e
            a, b, far = (np.concatenate(x) for x in zip(*found, strict=True))
            if forest and len(a):
                names, label = np.unique(t["comp"], return_inverse=True)
                low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
                # of each pair of components the nearest, then a forest of the tile's components
                order = np.lexsort((far, high, low))
                one = order[_changes([low[order], high[order]])]
                a, b, far = a[one], b[one], far[one]
                tree = Forest(len(names))
                where: dict[tuple[int, int], int] = {(x, y): k for k, (x, y) in enumerate(zip(low[one].tolist(), high[one].tolist(), strict=True))}
                tree.join(high[one], low[one], far)
                kept = [where[min(x, y), max(x, y)] for u, v in tree.edges for x, y in zip(u.tolist(), v.tolist(), strict=True)]
                a, b = a[kept], b[kept]
            yield _pairs(a, b, t["node"])

    ordered = dealt.repartition(*by).sortWithinPartitions(*by, "side", "n", "node")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def sets_of(leaves: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles, signature) of leaves (node, set, first), read from the texts again; with wider signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            each = shingle_sets(chunk, size)
            columns = ([set_key(x) for x in each], [x.tobytes() for x in each], [x.tobytes() for x in signatures(each, *_WIDER)])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["set", "shingles", "signature"])

    wanted = leaves.select("first").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(wanted, F.col("_id").eqNullSafe(F.col("first")), "left_semi")
    held = texts.select("text").mapInArrow(run, "set binary, shingles binary, signature binary")
    once = held.groupBy("set").agg(F.first(F.struct("shingles", "signature")).alias("_h"))
    return leaves.select("node", "set").join(once, "set").select("node", "_h.shingles", "_h.signature")


def confirmed(pairs: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """Those of pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [linked(*(np.frombuffer(v.as_buffer(), np.uint64) for v in xy), least) for xy in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    met = pairs.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(held.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    return met.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def contracted(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b): only the components that these connect are worked out again."""
    name = lambda df, end: df.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    links = cut(name(name(more, "a"), "b"))
    merged = components(links).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node"))
    known = roots.union(ends.join(roots.select("node"), "node", "left_anti"))
    return known.join(merged, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))


def components_of(docs: DataFrame, size: int = SHINGLE, least: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component_id, kept) of every row of docs. The settings of the signature are for similarities of 85
    hundredths or more."""
    rows = cut(described(docs, size, id_col, text_col))
    leaves = cut(rows.groupBy("n", "set").agg(F.min("signature").alias("signature"), F.min("id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    met = cut(shared_keys(leaves.where("n > 0")))
    nodes = met.select("node").distinct()
    members = cut(met.join(leaves.select("node", "n", "signature"), "node"))
    held = cut(sets_of(leaves.join(nodes, "node", "left_semi"), docs, size, id_col, text_col))
    judged = cut(neighbours(members, least))
    links = cut(confirmed(judged, held, least))
    roots = cut(components(links))
    wider = members.select("key", "node", "n", F.col("signature").alias("narrow")).join(held.select("node", "signature"), "node")
    for forest in (True, False):
        labelled = wider.join(roots, "node", "left").select("key", "node", "n", "narrow", "signature", F.coalesce("root", "node").alias("comp"))
        pairs = cut(between(labelled, least, forest).join(judged, ["a", "b"], "left_anti"))
        judged = judged.union(pairs)
        more = cut(confirmed(pairs, held, least))
        if not more.isEmpty():
            roots = cut(contracted(roots, more))
    rooted = cut(leaves.join(roots, "node", "left").select("n", "set", "first", F.coalesce("root", "node").alias("_root")))
    smallest = rooted.groupBy("_root").agg(F.min("first").alias("component_id"))
    # a set without shingles is no link: each such row is its own component
    named = rows.join(rooted.join(smallest, "_root").select("n", "set", "component_id"), ["n", "set"]).withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return named.select("id", "n", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents; see the module's defined results for nulls,
    short texts, repeated rows and empty tables."""
    found = components_of(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "kept")
