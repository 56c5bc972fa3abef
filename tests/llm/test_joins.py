"""MinHash near copies, ranked search and hard negatives against brute force, and on odd rows and empty tables."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchspark.llm import hard_negatives, minhash, ranked_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 11 minhash ---------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_near(rows):
    """(n, component) of each row (id, text), row by row; the component is its smallest id, None if it has none."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def told(df):
    return sorted((str(r.id), r.n, str(r.component_id), r.kept) for r in df.collect())


def want(rows):
    return sorted((str(i), n, str(c), i == c) for i, n, c in slow_near(rows))


def test_op11_is_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = minhash.op11_minhash(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == sorted((i, n, c, i == c) for i, n, c in slow_near(rows))


@pytest.mark.parametrize("tile", [2048, 7])
def test_clouds_around_the_threshold(spark, monkeypatch, tile):
    """Families of copies of copies: most pairs fail the check; small tiles and blocks change nothing."""
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "_ROWS", 10 * tile)
    monkeypatch.setattr(minhash, "_PAIRS", 100 * tile)
    rng = random.Random(2)
    rows = []
    for cloud in range(4):
        base = [f"c{cloud}w{i}" for i in range(160)]
        for _ in range(45):
            w = list(base)
            for at in rng.sample(range(160), rng.choice((1, 2, 3, 4))):
                w[at] = f"new{rng.randrange(10**9)}"
            rows.append((rng.choice([None, len(rows)]), " ".join(w)))
    assert 4 < len({c for *_, c in slow_near(rows)}) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(minhash.components_of(df)) == want(rows)


def test_near_copies_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert told(minhash.components_of(odd)) == want(rows)
    assert minhash.components_of(odd.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "one two"), ("a", "ONE two"), (None, "one\ttwo"), (None, "other"), ("c", "")], "doc_id string, text string")
    assert told(minhash.components_of(named)) == sorted([("b", 1, "a", False), ("a", 1, "a", True), ("None", 1, "a", False), ("None", 1, "None", True), ("c", 0, "c", True)])


def test_signatures_within_the_budget_share_a_key():
    """The pigeonhole guarantee, for the most errors it covers."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (300, minhash.PLACES), dtype=np.uint16)
    b = a.copy()
    most = minhash.CHUNKS * (minhash.ERRORS + 1) - 1
    for row in b:
        at = rng.choice(minhash.PLACES, most, replace=False)
        row[at] ^= np.uint16(1)
    assert (minhash.keys_of(a) == minhash.keys_of(b)).any(axis=1).all()
    assert not (minhash.keys_of(a) == minhash.keys_of(a[::-1])).any(axis=1)[: len(a) // 2].any()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    x, y = np.unique(pool[:2000]), np.unique(pool[400:2400])
    s = minhash.signatures([x, y, x[:0]], *minhash._WIDER)
    assert abs((s[0] == s[1]).mean() - 1600 / 2400) < 0.08
    assert not s[2].any()


# --- 12 ranked search ---------------------------------------------------------------------------------------------


def slow_search(items, docs, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in held if t]
    n, total = len(held), sum(x for *_, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def made(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_search_is_brute_force(spark, monkeypatch, small):
    """Ties across tiles, rare and common terms; blocks, tiles and columns of any size give the same."""
    if small:
        for name, size in (("BLOCK_TERMS", 6), ("BLOCK_ITEMS", 2), ("DOCS", 3), ("COLUMNS", 2)):
            monkeypatch.setattr(ranked_search, name, size)
    rng = random.Random(3)
    words = ["Alpha", "beta", "gamma9", "día", "東京", "x", "zz", "KK", "foo"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights=range(9, 0, -1), k=n))
    docs = [(i, text(rng.randrange(1, 15))) for i in range(60)] + [(100 + i, "alpha alpha beta") for i in range(30)] + [(None, "zz ALPHA"), (None, None), (7, ""), (8, " .,")]
    items = [(i, text(rng.randrange(1, 6))) for i in range(9)] + [(20, "alpha beta"), (20, "alpha beta"), (21, None), (22, "?"), (23, "nowhere"), (None, "zz")]
    got = ranked_search.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert made(got) == slow_search(items, docs)


def test_search_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "short words"), (2, "WORDS tail"), (3, "東京 ßtraße")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert made(ranked_search.search(items, odd)) == slow_search([(r.item_id, r.text) for r in items.collect()], rows)
    assert ranked_search.search(items, odd.limit(0)).count() == 0
    assert ranked_search.search(items.limit(0), odd).count() == 0


def test_partial_sums_stay_exact():
    """So many columns at once that no sum of the largest weights and impacts reaches 2^53."""
    block = ranked_search.Block([1] * 3, ["a", "b", "c"], [44_000, 1 << 30, 5])
    assert block.wide * ranked_search.MOST_IMPACT * (1 << 30) < 1 << 53
    assert block.wide == 1 or (block.wide + 1) * ranked_search.MOST_IMPACT * (1 << 30) >= 1 << 53


# --- 13 hard negatives --------------------------------------------------------------------------------------------


def slow_negatives(rows, positives=5, negatives=10, low=30, high=90):
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and None not in v}, key=lambda r: (r[0], r[1], r[2]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in rows:
        if a[0] % 10:
            continue
        best = sorted(((-dot(a[2], r[2]), r[0]) for r in rows if r[1] == a[1] and r != a))[:positives]
        for ps, p in best:
            fits = sorted((-dot(a[2], r[2]), r[0]) for r in rows if r[1] != a[1] and low * -ps <= 100 * dot(a[2], r[2]) <= high * -ps)
            out += [(a[0], p, k, i, -ps, -s) for k, (s, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize(("small", "big"), [(False, 1), (True, 1), (False, 1 << 24)])
def test_negatives_are_brute_force(spark, monkeypatch, small, big):
    """Ties, windows that fill and windows that do not, a label with a third of all rows; small tiles and large numbers
    give the same."""
    if small:
        for name, size in (("ANCHORS", 3), ("ROWS", 11), ("_BLOCK", 2), ("_FEW", 1.1)):
            monkeypatch.setattr(hard_negatives, name, size)
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 0, 1, 2, 3]), [big * rng.randrange(-3, 6) for _ in range(6)]) for i in range(160)]
    rows += [(200 + i, 1, [big * x for x in (2, 2, 2, 2, 2, 2)]) for i in range(15)] + [rows[3], rows[10], (10, 2, [big] * 6), (300, 9, [big] * 6), (310, 1, [0] * 6), (None, 1, [1] * 6), (320, None, [1] * 6), (330, 1, None), (340, 1, [1, None]), (350, 2, [big * 4]), (360, 2, [])]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").withColumn("key", F.lit("clash")).repartition(4)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == slow_negatives(rows)


def test_threshold_join_finds_what_reaches():
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (500, 24)) * rng.integers(0, 5, 24)
    q = x[:40]
    index = hard_negatives.Index(x)
    for share in (0.9, 0.4, 0.0, -np.inf):
        least = np.full(40, share if share < 0 else share * np.square(q).sum(axis=1).mean())
        a, r, score = index.reach(q, least)
        full = q @ x.T
        assert set(zip(a.tolist(), r.tolist(), strict=True)) == set(zip(*(i.tolist() for i in np.nonzero(full >= least[:, None])), strict=True))
        assert (score == full[a, r]).all()


def test_vectors_become_integers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, [nan]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, None), (6, [])]
    got = spark.createDataFrame(rows, "i int, v array<float>").select("i", hard_negatives.integers("v").alias("x"))
    assert {r.i: r.x for r in got.collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
    empty = spark.createDataFrame([], "vec_id long, label long, v array<long>")
    assert hard_negatives.hard_negatives(empty, F.lit(True)).count() == 0
