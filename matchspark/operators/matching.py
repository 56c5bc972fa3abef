"""Vectors and matching: exact nearest neighbours, blocked near-duplicate pairs, skill buckets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchspark.functions import scoring as S
from matchspark.functions.scoring import skill_rarity
from matchspark.functions.text import trigram_similarity, trigrams
from matchspark.operators.demand import related_skills
from matchspark.operators.ranking import rank_page
from matchspark.session import on_workers, written

#: Rows of a side that one tile holds, about; and rows that are multiplied at once.
TILE = 8192
_STRIPE = 256
#: Tiles of near duplicates are dealt into so many parts at most.
MOST_PARTS = 4096


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays, in double; null if either is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows; a zero vector stays zero."""
    whole = column.combine_chunks()
    m = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _tiled(left: DataFrame, right: DataFrame, keys: list[str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, columns: tuple[str, ...] = ("_id", "_v"), parts: int | None = None) -> DataFrame:
    """run over tiles: within each key, left and right (keys, _id, _v) are dealt into blocks of about TILE rows by a hash
    of the id, and each block of one side meets each block of the other in a group of its own, so a task holds two
    blocks, whatever the size of a key. What is shuffled is each row once for each block it meets."""
    blocks = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    sizes = blocks(left, "_ni").join(blocks(right, "_nj"), keys)
    deal = lambda df, own, other, n_own, n_other: df.join(sizes, keys).withColumn(own, F.pmod(F.xxhash64("_id"), n_own).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
    by = [*keys, "_i", "_j"]
    l, r = deal(left, "_i", "_j", "_ni", "_nj").select(*by, *columns), deal(right, "_j", "_i", "_nj", "_ni").select(*by, *columns)
    if parts:
        return _met(l, r, by, run, schema, parts)
    r = r.select(*(F.col(c).alias(f"r{c}") for c in r.columns))  # names of its own, as both sides may be one table
    on_workers(left.sparkSession)
    return l.groupBy(*by).cogroup(r.groupBy(*(f"r{c}" for c in by))).applyInArrow(run, schema)


def top_k_similar(anchors: DataFrame, items: DataFrame, k: int, anchor: str, item: str, vector: str = "embedding", floor: float | None = None, not_self: bool = False) -> DataFrame:
    """(anchor, item, similarity, place): each anchor's k nearest items, exactly; ties go to the smaller item id.

    Anchors and items meet in tiles of bounded size; a tile keeps its k best of each anchor, so what is ranked at the
    end is at most k rows of an anchor and block of items. Nothing passes through the driver."""
    schema = f"{anchor} long, {item} long, similarity double"
    side = lambda df, key: df.where(F.col(vector).isNotNull()).select(F.lit(0).alias("_all"), F.col(key).cast("long").alias("_id"), F.col(vector).alias("_v"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = left.column("_id").to_numpy(), right.column("r_id").to_numpy()
        found: list[tuple[np.ndarray, ...]] = []
        if len(ids) and len(own):
            a, b = _matrix(left.column("_v")), _matrix(right.column("r_v")).T
            for s in range(0, len(ids), _STRIPE):
                sim = a[s : s + _STRIPE] @ b
                if not_self:
                    sim[ids[s : s + _STRIPE, None] == own[None, :]] = -np.inf
                least = np.full(len(sim), -np.inf if floor is None else floor)
                if k < sim.shape[1]:
                    least = np.maximum(least, np.partition(sim, -k, axis=1)[:, -k])
                i, j = np.nonzero((sim >= least[:, None]) & np.isfinite(sim))
                x, y, z = ids[s + i], own[j], sim[i, j]
                order = np.lexsort((y, -z, x))
                x, y, z = x[order], y[order], z[order]
                first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
                place = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
                found.append((x[place < k], y[place < k], z[place < k]))
        cols = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip((anchor, item, "similarity"), cols, strict=True)))

    best = _tiled(side(anchors, anchor), side(items, item), ["_all"], run, schema)
    place = F.row_number().over(W.partitionBy(anchor).orderBy(F.desc("similarity"), item))
    return best.withColumn("place", place).where(F.col("place") <= k)


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str = "embedding") -> DataFrame:
    """pairs with cosine; null where a side has no vector."""
    a, b = left.select(left_id, F.col(vector).alias("_a")), right.select(right_id, F.col(vector).alias("_b"))
    return pairs.join(a, left_id, "left").join(b, right_id, "left").withColumn("cosine", cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def copies(postings: DataFrame) -> DataFrame:
    """(job_id, class_id, alike): postings alike in company, title and vector are one class, known by its smallest id.
    alike: whether members of the class are near duplicates of each other, for which it takes a vector that is not zero
    and a company or a title with letters."""
    same = postings.groupBy("company_id", "title", "embedding").agg(F.min("job_id").alias("class_id"))
    near = F.col("embedding").isNotNull() & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)) & (F.col("company_id").isNotNull() | F.coalesce(F.size(trigrams(F.col("title"))) > 0, F.lit(False)))
    same = same.withColumn("alike", near)
    equal = lambda c: postings[c].eqNullSafe(same[c])
    return postings.join(same, equal("company_id") & equal("title") & equal("embedding")).select("job_id", "class_id", "alike")


def _self_tiled(df: DataFrame, keys: list[str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, parts: int) -> DataFrame:
    """run over tiles of one table (keys, _id, ...): as in _tiled, but each two blocks of a key meet once."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / TILE).cast("int").alias("_ni"))
    dealt = df.join(sizes, keys).withColumn("_own", F.pmod(F.xxhash64("_id"), "_ni").cast("int"))
    l = dealt.withColumn("_j", F.explode(F.sequence("_own", F.col("_ni") - 1))).withColumnRenamed("_own", "_i").drop("_ni")
    r = dealt.withColumn("_i", F.explode(F.sequence(F.lit(0), "_own"))).withColumnRenamed("_own", "_j").drop("_ni")
    return _met(l, r, [*keys, "_i", "_j"], run, schema, parts)


def _met(l: DataFrame, r: DataFrame, by: list[str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, parts: int) -> DataFrame:
    """run over the groups of both tables, dealt into `parts` parts: a part holds few groups, whatever their number."""
    on_workers(l.sparkSession)
    r = r.select(*(F.col(c).alias(f"r{c}") for c in r.columns))
    return l.repartition(parts, *by).groupBy(*by).cogroup(r.repartition(parts, *(f"r{c}" for c in by)).groupBy(*(f"r{c}" for c in by))).applyInArrow(run, schema)


def _codes(left: pa.Table, right: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, list]:
    """A column of both sides as places in the list of its values; -1 for null."""
    both = pa.chunked_array([*left.column(name).chunks, *right.column(f"r{name}").chunks], type=left.schema.field(name).type)
    told = both.combine_chunks().dictionary_encode()
    codes = told.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes[: len(left)], codes[len(left) :], told.dictionary.to_pylist()


#: So many titles on each side of a tile are held against each other before the vectors are.
_TITLES = 256


def _near(left: pa.Table, right: pa.Table, least: float, least_title: float, companies: bool) -> pa.Table:
    """Near pairs of two blocks of classes (_id, _v, _c: company, _t: trigrams, _n): of one company, or of similar titles
    and not of one company. A block that meets itself gives each pair once.

    Vectors are multiplied in single precision, and what may be near once more in double. With few titles only the
    vectors of similar ones are multiplied."""
    names = ("a", "b", "cosine", "shares_company", "similar_title", "n_a", "n_b")
    found: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, bool, bool, np.int64, np.int64))]
    if len(left) and len(right):
        x, y, n, m = left.column("_id").to_numpy(), right.column("r_id").to_numpy(), left.column("_n").to_numpy(), right.column("r_n").to_numpy()
        a, b = _matrix(left.column("_v")), _matrix(right.column("r_v"))
        a4, b4 = a.astype(np.float32), b.astype(np.float32)
        maybe = np.float32(least - (a.shape[1] + 8) * 2.4e-7)
        cx, cy, _ = _codes(left, right, "_c")
        tx, ty, told = _codes(left, right, "_t")
        grams = [frozenset(t.split("|")) if t else frozenset() for t in told]
        once = "_i" in left.column_names and left.column("_i")[0].as_py() == left.column("_j")[0].as_py()

        def alike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            """Whether titles by code are similar, each two looked at once."""
            both, at = np.unique(p.astype(np.int64) * (len(grams) + 1) + q, return_inverse=True)
            said = np.zeros(len(both), bool)
            for k, (i, j) in enumerate(zip(*np.divmod(both, len(grams) + 1), strict=True)):
                g, h = grams[i], grams[j]
                shared = len(g & h)
                whole = len(g) + len(h) - shared
                said[k] = (shared / whole if whole else 0.0) >= least_title
            return said[at]

        def candidates() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            rows, titles = np.unique(tx), np.unique(ty)
            titles = titles[titles >= 0]
            if companies or len(rows) > _TITLES or len(titles) > _TITLES:
                blocks = [(np.arange(len(x)), np.arange(len(y)))]
            else:
                blocks = [(np.flatnonzero(tx == t), np.flatnonzero(np.isin(ty, titles[alike(np.full(len(titles), t), titles)]))) for t in rows if t >= 0 and len(titles)]
            for own, other in blocks:
                whole = len(own) == len(x) and len(other) == len(y)
                met = (b4 if whole else b4[other]).T
                for s in range(0, len(own) if len(other) else 0, _STRIPE):
                    some = own[s : s + _STRIPE]
                    i, j = np.divmod(np.flatnonzero(a4[some] @ met >= maybe), len(other))
                    yield some[i], other[j]

        for i, j in candidates():
            if once:
                i, j = i[x[i] < y[j]], j[x[i] < y[j]]
            same = (cx[i] == cy[j]) & (cx[i] >= 0)
            if not companies:
                i, j, same = i[~same], j[~same], same[~same]
            sim = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[i[s : s + TILE]], b[j[s : s + TILE]]) for s in range(0, len(i), TILE))])
            held = sim >= least
            i, j, sim, same = i[held], j[held], sim[held], same[held]
            titled = (tx[i] >= 0) & (ty[j] >= 0)
            titled[titled] = alike(tx[i[titled]], ty[j[titled]])
            if not companies:
                i, j, sim, same, titled = i[titled], j[titled], sim[titled], same[titled], titled[titled]
            low = x[i] < y[j]
            found.append((np.where(low, x[i], y[j]), np.where(low, y[j], x[i]), sim, same, titled, np.where(low, n[i], m[j]), np.where(low, m[j], n[i])))
    return pa.table({name: np.concatenate([f[c] for f in found]) for c, name in enumerate(names)})


def near_duplicate_pairs(postings: DataFrame, least: float = 0.97, least_title: float = 0.3) -> DataFrame:
    """postings: (job_id, company_id, title, embedding). (a, b, cosine, shares_company, similar_title, n_a, n_b), a < b,
    between classes of alike postings (see copies), each known by its smallest id; n_a and n_b are their postings.

    Classes meet if they share the company, or if their titles may be similar (see title_tiles): in tiles of bounded
    size, which many titles share. Each two meet once as a company and once as titles at most, which leaves out those
    of one company; only near pairs leave a tile, with all that is said of them, so nothing is joined to them."""
    grams = F.array_join(trigrams(F.col("title")), "|")
    classes = postings.where("embedding is not null").groupBy("company_id", "title", "embedding").agg(F.min("job_id").cast("long").alias("_id"), F.count("*").alias("_n"))
    own = written(classes.select("_id", F.col("embedding").alias("_v"), F.col("company_id").alias("_c"), grams.alias("_t"), "_n", "title"))
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(own.count() / TILE) ** 2, MOST_PARTS))
    columns = ("_id", "_v", "_c", "_t", "_n")
    schema = "a long, b long, cosine double, shares_company boolean, similar_title boolean, n_a long, n_b long"
    of_company = lambda l, r: _near(l, r, least, least_title, True)
    of_titles = lambda l, r: _near(l, r, least, least_title, False)
    tiles, met = (written(t) for t in title_tiles(own.select("title"), least_title))
    away = met.join(tiles.withColumnRenamed("tile", "_home"), "title").where("tile <> _home").drop("_home")
    deal = lambda t: own.join(t, "title").select("tile", *columns)
    named = own.where("_c is not null").select(F.col("_c").alias("_k"), *columns)
    by_company = _self_tiled(named, ["_k"], of_company, schema, parts)
    at_home = _self_tiled(deal(tiles), ["tile"], of_titles, schema, parts)
    abroad = _tiled(deal(tiles), deal(away), ["tile"], lambda l, r: of_titles(l.drop_columns(["_i", "_j"]), r), schema, columns, parts)
    return by_company.union(at_home).union(abroad)


def _both_ways(pairs: DataFrame, *columns: str) -> DataFrame:
    """(class_id, other, n_other, columns): pairs as each side sees them; what makes the pairs runs once."""
    sides = F.array(F.struct(F.col("a").alias("class_id"), F.col("b").alias("other"), F.col("n_b").alias("n_other")), F.struct(F.col("b").alias("class_id"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    return pairs.select(F.inline(sides), *columns)


def near_duplicate_classes(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(job_id, class_id, n_links): how many other postings each is a near duplicate of, its own copies included, from
    the pairs between classes; pairs of copies are counted, never made."""
    members = copies(postings)
    sizes = members.groupBy("class_id").agg(F.count("*").alias("_n"))
    far = _both_ways(pairs).groupBy("class_id").agg(F.sum("n_other").alias("_far"))
    own = F.when(F.col("alike"), F.col("_n") - 1).otherwise(F.lit(0))
    return members.join(sizes, "class_id").join(far, "class_id", "left").select("job_id", "class_id", (own + F.coalesce("_far", F.lit(0))).alias("n_links"))


def near_duplicates_of(postings: DataFrame, pairs: DataFrame, most: int = 10) -> DataFrame:
    """(job_id, other_id, cosine, place): each posting's nearest duplicates, copies of it and of the others included;
    ties go to the smaller id. pairs: near_duplicate_pairs, between classes.

    A class is expanded only as far as it can matter: no posting has more than `most` hits, so a class needs its
    `most` + 1 nearest classes (by cosine, then by the smallest id), the first `most` + 1 ids of a class stand for it, and
    the hits are chosen once for each class; its members differ only in leaving out
    themselves."""
    members = copies(postings)
    nth = F.row_number().over(W.partitionBy("class_id").orderBy("job_id"))
    first = members.withColumn("_n", nth).where(F.col("_n") <= most + 1).select("class_id", F.col("job_id").alias("other_id"), "alike")
    own = first.where("alike").select("class_id", "other_id", F.lit(1.0).alias("cosine"))
    nearest = F.row_number().over(W.partitionBy("class_id").orderBy(F.desc("cosine"), "other"))
    both = _both_ways(pairs, "cosine").withColumn("_n", nearest).where(F.col("_n") <= most + 1)
    far = both.join(first.select(F.col("class_id").alias("other"), "other_id"), "other").select("class_id", "other_id", "cosine")
    best = F.row_number().over(W.partitionBy("class_id").orderBy(F.desc("cosine"), "other_id"))
    hits = own.union(far).withColumn("_n", best).where(F.col("_n") <= most + 1).drop("_n")
    place = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("cosine"), "other_id"))
    met = members.select("job_id", "class_id").join(hits, "class_id").where("job_id <> other_id")
    return met.select("job_id", "other_id", "cosine", place.alias("place")).where(F.col("place") <= most)


def title_tiles(titles: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Two tables (title, tile): each title's own tile, and the tiles that hold a title which may be similar to it: all
    pairs of titles with that trigram similarity at least meet in the own tile of one of them.

    A set-similarity join over a prefix index. Trigrams are in order of rarity; of two similar titles with n and m of
    them one shares a trigram within the first floor((1 - least) n) + 1 of each. For every shared one there are two
    filters: n and m are within `least` of each other, and the trigrams from there on are enough for the overlap that
    the similarity takes. The index holds tiles in place of titles: about TILE titles of like length each, with the
    bounds of n and of what is left. So a trigram that very many titles share gives rows by tiles, not by pairs."""
    each = titles.where("title is not null").distinct().withColumn("grams", trigrams(F.col("title"))).withColumn("n", F.size("grams")).where("n > 0")
    band = F.floor(F.log("n") / F.log(F.lit(1.5)))
    counts = each.groupBy(band.alias("band")).agg(F.ceil(F.count("*") / TILE).alias("_parts"))
    own = each.select("title", band.alias("band")).join(counts, "band").select("title", (F.col("band") * (1 << 32) + F.pmod(F.xxhash64("title"), F.col("_parts"))).alias("tile"))
    grams = each.select("title", "n", F.explode("grams").alias("gram"))
    rarity = grams.groupBy("gram").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("title").orderBy("df", "gram"))
    ranked = grams.join(rarity, "gram").withColumn("place", place).where(F.col("place") <= F.floor((1 - least) * F.col("n")) + 1)
    prefix = ranked.join(own, "title").select("title", "tile", "gram", "n", (F.col("n") - F.col("place")).alias("rest"))
    index = prefix.groupBy("gram", F.col("tile").alias("_tile")).agg(F.min("n").alias("_least"), F.max("n").alias("_most"), F.max("rest").alias("_rest"))
    slack = 1e-9
    long_enough = (F.col("_most") >= least * F.col("n") - slack) & (F.col("_least") * least <= F.col("n") + slack)
    enough = 1 + F.least("_rest", "rest") >= least / (1 + least) * (F.col("_least") + F.col("n")) - slack
    met = prefix.join(index, "gram").where((F.col("_tile") <= F.col("tile")) & long_enough & enough)
    return own, met.select("title", F.col("_tile").alias("tile")).distinct()


def match_partition(pairs: DataFrame, job_skills: DataFrame, held: DataFrame, skills: DataFrame) -> DataFrame:
    """(user_id, job_id, skill_id, requirement, bucket): every requirement of a pair is MATCHED, PARTIAL or MISSING."""
    own, near = held.select("user_id", "skill_id").withColumn("_held", F.lit(True)), related_skills(held, skills).withColumn("_near", F.lit(True))
    bucket = F.when(F.col("_held"), "MATCHED").when(F.col("_near"), "PARTIAL").otherwise("MISSING")
    asked = pairs.select("user_id", "job_id").join(job_skills, "job_id")
    return asked.join(own, ["user_id", "skill_id"], "left").join(near, ["user_id", "skill_id"], "left").select("user_id", "job_id", "skill_id", "requirement", bucket.alias("bucket"))


def skill_score(buckets: DataFrame, demand: DataFrame) -> DataFrame:
    """(user_id, job_id, skill): weighted share of what is asked that is held, rarer skills counting more; null if the
    weights come to nothing."""
    weight = F.when(F.col("requirement") == "REQUIRED", 1.0).otherwise(0.5) * skill_rarity(F.col("demand_score"))
    quality = F.when(F.col("bucket") == "MATCHED", 1.0).when(F.col("bucket") == "PARTIAL", 0.5).otherwise(0.0)
    return buckets.join(demand, "skill_id", "left").groupBy("user_id", "job_id").agg(
        F.try_divide(F.sum(weight * quality), F.sum(weight)).alias("skill"),
        *(F.count_if(F.col("bucket") == b).alias(f"n_{b.lower()}") for b in ("MATCHED", "PARTIAL", "MISSING")),
    )


def match_lists(buckets: DataFrame, skills: DataFrame) -> DataFrame:
    """(user_id, job_id, matched, partial, missing): the names in each bucket, required ones first, then by name. A
    pair's lists are as long as what its posting asks for."""
    named = buckets.join(skills.select("skill_id", "name"), "skill_id")
    entry = F.struct((F.col("requirement") != "REQUIRED").alias("later"), "name", "skill_id")
    of = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, entry))), lambda x: x["name"]).alias(b.lower())
    return named.groupBy("user_id", "job_id").agg(*map(of, ("MATCHED", "PARTIAL", "MISSING")))


#: What this way to score is called; results of different ways are not to be compared.
RANKING_VERSION = "v1"


def match(pairs: DataFrame, candidates: DataFrame, jobs: DataFrame, job_skills: DataFrame, held: DataFrame, skills: DataFrame, demand: DataFrame, span: tuple[float, float], at: Column, lists: bool = True) -> DataFrame:
    """Every pair (user_id, job_id, similarity; one row each) scored in the six dimensions, from tables:

    candidates (user_id, years, education_rank, wants_remote, will_relocate, home, floor, floor_currency; and, if there
    are such columns, places and preferred: arrays of words of places), jobs (job_id, min_years, max_years,
    min_education, country_code, work_mode, salary_min, salary_max, salary_currency, salary_period; place_words like
    places), job_skills (job_id, skill_id, requirement), held (user_id, skill_id), skills (skill_id, name,
    parent_skill_id), demand (skill_id, demand_score).

    Gives, besides the pair: each dimension and its status, overall, scored_weight, the numbers of skills in each bucket
    and, with lists, their names (matched, partial, missing), ranking_version and computed_at (at). A posting that lists
    no skills NEEDS_DATA, a candidate without any NEEDS_PROFILE, and where the skills weigh nothing
    it NEEDS_DATA: these count as neutral and not as scored. What is joined is cut down to the pairs first: postings and skills that no pair
    has take no part."""
    none, c = F.array().cast("array<string>"), F.col
    asked = job_skills.join(pairs.select("job_id").distinct(), "job_id", "left_semi")
    buckets = match_partition(pairs, asked, held, skills)
    scored = skill_score(buckets, demand)
    if lists:
        scored = scored.join(match_lists(buckets, skills), ["user_id", "job_id"], "left")
    words = lambda df, name: df if name in df.columns else df.withColumn(name, none)
    people = words(words(candidates, "places"), "preferred").join(held.select("user_id").distinct().withColumn("_has", F.lit(True)), "user_id", "left")
    postings = words(jobs, "place_words")
    postings = postings if "salary_min" in jobs.columns else postings.withColumn("salary_min", F.lit(None).cast("double"))
    people = people.select("user_id", "years", "education_rank", "wants_remote", "will_relocate", "home", "floor", "floor_currency", "places", "preferred", "_has")
    postings = postings.select("job_id", "min_years", "max_years", "min_education", "country_code", "work_mode", "salary_min", "salary_max", "salary_currency", "salary_period", "place_words")
    wide = pairs.join(people, "user_id").join(postings, "job_id").join(scored, ["user_id", "job_id"], "left")
    dims = {
        "semantic": S.semantic(c("similarity"), span),
        "experience": S.experience(c("years"), c("min_years"), c("max_years")),
        "education": S.education(c("education_rank"), S.education_rank(c("min_education"))),
        "location": S.location(c("preferred"), c("wants_remote"), c("home"), c("will_relocate"), c("place_words"), c("country_code"), c("work_mode")),
        "salary": S.salary(c("salary_min"), c("salary_max"), c("salary_currency"), c("salary_period"), c("floor"), c("floor_currency")),
    }
    for name, (score, status) in dims.items():
        wide = wide.withColumn(name, score).withColumn(f"{name}_status", status)
    lists_none = c("n_matched").isNull()
    wide = wide.withColumn("skill_status", F.when(lists_none, "NEEDS_DATA").when(c("_has").isNull(), "NEEDS_PROFILE").when(c("skill").isNull(), "NEEDS_DATA").otherwise("SCORED"))
    wide = wide.withColumn("skill", F.when(c("skill_status") == "SCORED", S.half_even(c("skill"), 4)).otherwise(F.lit(S.NEUTRAL)))
    wide = wide.withColumn("overall", S.overall()).withColumn("scored_weight", S.scored_weight())
    return wide.withColumn("ranking_version", F.lit(RANKING_VERSION)).withColumn("computed_at", at).drop("_has", "places", "preferred", "place_words")


def recommend(matches: DataFrame, seen: DataFrame, first: int = 1, size: int = 20) -> DataFrame:
    """(user_id, job_id, overall, scored_weight, rank, total): a page of each user's matches, best first, without what
    is in seen (user_id, job_id)."""
    fresh = matches.select("user_id", "job_id", "overall", "scored_weight").join(seen.select("user_id", "job_id").distinct(), ["user_id", "job_id"], "left_anti")
    return rank_page(fresh, "user_id", "overall", "job_id", first, size)
