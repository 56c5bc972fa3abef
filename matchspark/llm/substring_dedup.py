"""Exact substring dedup: every byte covered by a LENGTH-byte string that also starts anywhere else is removed.

The method is a sparse suffix array built by a distributed merge sort that knows common prefixes.

1. Suffixes. Every window of LENGTH bytes is represented by one suffix that starts in it: at the place, among the
   first SPREAD places of the window, whose 8 bytes have the lowest hash (of 56 bits, always), the leftmost of such.
   The choice depends on nothing but the window, so equal windows are represented by suffixes at the
   same place in them, and about 2 in SPREAD suffixes are enough. A suffix stands for a run of windows; its context is
   the bytes of all of them.
2. Pruning. Equal windows share their suffix's first KEY = LENGTH - SPREAD bytes. Suffixes whose key is found once in
   the corpus are dropped, by a sum by the key's hash that is combined before it is shuffled; two keys with one hash
   only send more to the merge, which compares bytes. Suffixes with one context (128-bit hash) are one entry with a
   count, so a passage or text that a third of all rows share is one entry from here on, whatever its copies.
3. Merge sort. Entries that share their key with other entries go on: each task sorts its own into a run, front-coded
   (what a suffix shares with the one before is left out), and sends the runs to the tasks that own the keys. There a
   loser tree merges them as they are read; it compares suffixes from their known common prefix on, so no byte is
   compared twice, and hands out each suffix with the prefix it shares with the one before.
4. Cover. Within a key, two suffixes that share r bytes forwards and l bytes backwards share the windows that start
   between 200 - r and l bytes before them. Forward prefixes come from the merge, backward ones from sorting the left
   contexts; the union over all partners says which of a suffix's windows repeat. All windows of an entry that stands
   for two or more suffixes repeat.
   A key with more than CROWD entries (the edge of a passage that very many texts share) is split by more of its
   bytes: windows at a distance of lo to hi - 1 before the suffix need lo bytes alike before it and 200 - hi + 1 from
   it on, so the entries are dealt by the hash of these bytes (128 bits), for the lower and the upper half of the
   distances each, and so on while a part is crowded. What is no longer crowded is merged like any other key. At a
   single distance these bytes are the whole window: then whoever shares a part shares it.
5. Removal. Covers go back to their texts by row.

Defined results: a null or empty text has no bytes; texts shorter than LENGTH lose nothing; texts of any length are
read whole, in overlapping segments. Rows that are alike in id and text are separate documents with the same result,
null ids are ids like others. Windows never cross texts. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm.common import CHUNK_BYTES, Chunk, chunks, cut, table

LENGTH = 200
SPREAD = 144
KEY = LENGTH - SPREAD
_SEGMENT = 1 << 20
_RUN_ENTRIES = 1 << 15
_OUT_ROWS = 1 << 13
_SMALL_GROUP = 12
_SLAB = 1 << 17
#: Entries of one key that are merged together; a key with more is split by further bytes. No result depends on it.
CROWD = 20_000
_OWNER_ENTRIES = 1 << 18

_rng = np.random.default_rng(20)
#: Three polynomial hashes: of keys, and two of contexts.
_VALUES = _rng.integers(0, 1 << 64, (3, 256), dtype=np.uint64)
_BASES = [int(x) * 8 + 5 for x in _rng.integers(1 << 50, 1 << 60, 3)]


_HELD: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers; those of chunks of the usual size are made once in each Python worker."""
    held = _HELD.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 2 * CHUNK_BYTES:
            _HELD[base] = held
    return held[:n]


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


class Suffixes:
    """The representative suffixes of texts laid end to end: row, at (in data), before and after (how many bytes of
    context stand before at and from it on) and key, a hash."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        n = len(data)
        self.data = data
        windows = np.maximum(0, ends - starts - LENGTH + 1)
        if not windows.sum():
            self.row = self.at = self.before = self.after = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.int64)
            return
        of = np.repeat(np.arange(len(starts)), windows)
        first = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)

        grams = np.full(-(-(n + SPREAD) // SPREAD) * SPREAD, 0xFFFFFFFFFFFFFFFF, np.uint64)
        word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64)[:, 0]
        h = word * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        grams[: len(h)] = h
        chosen = leftmost_least(grams, first)

        begin = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])))
        last = np.append(begin[1:], len(chosen)) - 1
        self.row, self.at = of[begin], chosen[begin]
        lo, hi = first[begin], first[last] + LENGTH
        self.before, self.after = self.at - lo, hi - self.at

        self.key = self.hashed(0, self.at, self.at + KEY)

    def hashed(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The k-th 64-bit hash of each data[a:b]."""
        n = len(self.data)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[k][self.data] * _powers(_BASES[k], n), dtype=np.uint64)])
        return _mix((total[b] - total[a]) * _powers(pow(_BASES[k], -1, 1 << 64), n)[a]).view(np.int64)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each suffix's context and of where in it the suffix starts."""
        where = (self.before * 1024 + self.after).astype(np.uint64)
        lo, hi = self.at - self.before, self.at + self.after
        return tuple(self.hashed(k, lo, hi) ^ _mix(where + np.uint64(k)).view(np.int64) for k in (1, 2))


def leftmost_least(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each i of first, the leftmost place of the least of grams[i : i + SPREAD] by their upper 56 bits. grams is
    whole blocks of SPREAD, and loses its lower 8 bits to places within the block."""
    grams &= np.uint64(0xFFFFFFFFFFFFFF00)
    block = grams.reshape(-1, SPREAD)
    block |= np.arange(SPREAD, dtype=np.uint64)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    last = first + SPREAD - 1
    left, right = behind[first], ahead[last]
    here = left >> np.uint64(8) <= right >> np.uint64(8)
    low = np.where(here, left, right) & np.uint64(0xFF)
    return np.where(here, first, last) // SPREAD * SPREAD + low.astype(np.int64)


def suffixes(chunk: Chunk) -> Iterator[tuple[Suffixes, int]]:
    """Of a chunk's texts, with the place of their data in the chunk; long texts in overlapping segments, which
    only cuts some suffixes' runs of windows in two."""
    if len(chunk.data) <= 2 * _SEGMENT:
        yield Suffixes(chunk.data, chunk.starts, chunk.ends), 0
        return
    for row, (a, b) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True)):
        for s in range(a, max(a + 1, b - LENGTH + 1), _SEGMENT):
            part = Suffixes(chunk.data[s : min(b, s + _SEGMENT + LENGTH - 1)], np.array([0]), np.array([min(b, s + _SEGMENT + LENGTH - 1) - s]))
            part.row = part.row + row
            yield part, s


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, row): row names a document by 128 bits of its id and text."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    named = F.concat(F.coalesce(F.col("doc").cast("string"), F.lit("")).cast("binary"), F.lit("\n").cast("binary"), F.col("text"))
    return docs.select(F.col(id_col).alias("doc"), text.alias("text")).withColumn("row", F.unhex(F.md5(named)))


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, body): texts compressed for the shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for chunk in chunks(batches):
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), chunk.batch.column(2), pa.array([squeeze.compress(t) for t in chunk.texts()], pa.binary())], names=["doc", "row", "body"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"doc {kind}, row binary, body binary")


def _body(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


# --- front-coded runs ---------------------------------------------------------------------------------------------

Entry = tuple[bytes, bytes, int, int]  # suffix, what stands before it, the context's two hashes


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """How many bytes a and b share at their starts, of which so many are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def encode_run(entries: list[Entry]) -> bytes:
    """Sorted entries, each suffix without what it shares with the one before."""
    prefix, last = [], b""
    for e in entries:
        prefix.append(shared(last, e[0]))
        last = e[0]
    rest = [e[0][p:] for e, p in zip(entries, prefix, strict=True)]
    head = np.array([[p, len(r), len(e[1])] for e, p, r in zip(entries, prefix, rest, strict=True)], np.uint16)
    ids = np.array([e[2:] for e in entries], np.int64)
    return b"".join([np.int64(len(entries)).tobytes(), head.tobytes(), ids.tobytes(), *(x for e, r in zip(entries, rest, strict=True) for x in (r, e[1]))])


def decode_run(blob: bytes) -> Iterator[tuple[int, Entry]]:
    """(bytes shared with the one before, entry) in order."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.uint16, 3 * n, 8).reshape(n, 3).tolist()
    ids = np.frombuffer(blob, np.uint8, 16 * n, 8 + 6 * n).view(np.int64).reshape(n, 2).tolist()
    at, last = 8 + 22 * n, b""
    for (p, r, b), (c1, c2) in zip(head, ids, strict=True):
        last = last[:p] + blob[at : at + r]
        yield p, (last, blob[at + r : at + r + b], c1, c2)
        at += r + b


def merge_runs(runs: list[Iterator[tuple[int, Entry]]]) -> Iterator[tuple[int, Entry]]:
    """Merge sorted runs with a loser tree. Each contender carries how much it shares with the last suffix handed out:
    of two, the one that shares more is smaller; only if they share alike are bytes compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    current: list[Entry | None] = [None] * k
    known = [0] * k
    for i, r in enumerate(runs):
        if nxt := next(r, None):
            current[i] = nxt[1]
    losers = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether a's suffix comes first; the loser learns what it shares with the winner."""
        x, y = current[a], current[b]
        if y is None or x is None:
            return x is not None
        if known[a] != known[b]:
            return known[a] > known[b]
        h = shared(x[0], y[0], known[a])
        first = x[0][h:] <= y[0][h:]
        known[b if first else a] = h
        return first

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    champion = winners[1] if k > 1 else 0
    while (entry := current[champion]) is not None:
        yield known[champion], entry
        nxt = next(runs[champion], None)
        known[champion], current[champion] = nxt if nxt else (0, None)
        node = (champion + k) // 2
        while node:
            if not beats(champion, losers[node]):
                champion, losers[node] = losers[node], champion
            node //= 2


# --- cover --------------------------------------------------------------------------------------------------------


def cover(group: list[Entry], forward: list[int]) -> list[list[tuple[int, int]]]:
    """For suffixes of one key in order, forward[i] being what i shares with i - 1: the (least, most) distances before
    each suffix at which a window that some other suffix of the group has too may start."""
    n = len(group)
    least = [LENGTH - len(e[0]) for e in group]
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    if n <= _SMALL_GROUP:
        backwards = [e[1][::-1] for e in group]
        for i in range(n):
            r = LENGTH
            for j in range(i + 1, n):
                r = min(r, forward[j])
                if r < KEY:
                    break
                left = shared(backwards[i], backwards[j])
                if LENGTH - r <= left:
                    out[i].append((LENGTH - r, left))
                    out[j].append((LENGTH - r, left))
        return out
    order = sorted(range(n), key=lambda i: group[i][1][::-1])
    back = np.zeros(n, np.int64)
    for a in range(1, n):
        back[a] = shared(group[order[a - 1]][1][::-1], group[order[a]][1][::-1])
    ahead, place = np.array(forward), np.array(order)
    size, room = np.array(least), np.array([len(e[1]) for e in group])
    hit = np.zeros((SPREAD, n), bool)
    step = max(1, _SLAB // n)
    for low in range(0, SPREAD, step):  # many distances at once
        d = np.arange(low, min(SPREAD, low + step))[:, None]
        left = np.empty((len(d), n), np.int64)
        left[:, place] = np.cumsum(back < d, axis=1)
        both = np.cumsum(ahead < LENGTH - d, axis=1) * np.int64(n + 1) + left
        # those without such a window are alike to nobody
        both = np.where((size <= d) & (room >= d), both, -1 - np.arange(n))
        rank = np.argsort(both, axis=1)
        ranked = np.take_along_axis(both, rank, axis=1)
        same = ranked[:, 1:] == ranked[:, :-1]
        twin = np.zeros(both.shape, bool)
        twin[:, 1:] |= same
        twin[:, :-1] |= same
        np.put_along_axis(hit[low : low + len(d)], rank, twin, axis=1)
    edge = np.diff(np.pad(hit, ((1, 1), (0, 0))).astype(np.int8), axis=0)
    for d, i in zip(*np.nonzero(edge.T == 1), strict=True):
        out[d].append((int(i), -1))
    ends = [np.flatnonzero(edge[:, i] == -1) - 1 for i in range(n)]
    return [[(a, int(e)) for (a, _), e in zip(spans, ends[i], strict=True)] for i, spans in enumerate(out)]


def _resolve(merged: Iterator[tuple[int, Entry]], lead: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(context hashes, cover as pairs of int16) of the suffixes that share windows with others. Each suffix comes
    after `lead` bytes that say which part it is in."""
    group: list[Entry] = []
    forward: list[int] = []

    def done() -> Iterator[tuple[int, int, bytes]]:
        if len(group) > 1:
            for e, spans in zip(group, cover(group, forward), strict=True):
                if spans:
                    yield e[2], e[3], np.array(spans, np.int16).tobytes()

    for lcp, (suffix, before, c1, c2) in merged:
        if group and lcp < lead + KEY:
            yield from done()
            group, forward = [], []
        group.append((suffix[lead:], before, c1, c2))
        forward.append(lcp - lead)
    yield from done()


# --- the operator -------------------------------------------------------------------------------------------------


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, ranges): for each document with repeated windows, its suffixes' places and covers (null: all windows)."""
    keyed = _keyed(docs, id_col, text_col).where(F.length("text") >= LENGTH)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            for s, _ in suffixes(chunk):
                yield pa.RecordBatch.from_arrays([pa.array(s.key)], names=["key"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            row = chunk.batch.column(1)
            for s, base in suffixes(chunk):
                if len(s.at):
                    at = s.at + base - chunk.starts[s.row]
                    c1, c2 = s.contexts()
                    yield pa.RecordBatch.from_arrays([pa.array(s.key), pa.array(c1), pa.array(c2), row.take(pa.array(s.row)), pa.array((at << 16) | (s.before << 8) | s.after)], names=["key", "c1", "c2", "row", "place"])

    # written before it is joined, so that the join deals out both sides itself and can split a hot key
    twice = cut(keyed.select("text").mapInArrow(keys, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    # place: where the suffix starts << 16 | bytes before it << 8 | bytes from it on
    found = keyed.select("text", "row").mapInArrow(places, "key long, c1 long, c2 long, row binary, place long")
    found = cut(found.join(twice, "key", "left_semi"))

    contexts = cut(found.groupBy("key", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one")))
    kinds = cut(contexts.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    calm = kinds.where(F.col("kinds") <= CROWD)
    packed = lambda: _packed(docs, id_col, text_col)
    entries = calm.agg(F.sum("kinds")).first()[0] or 0
    merged = _merge(_with_texts(contexts, calm, packed()), 0, entries, _entries)
    crowded = kinds.where(F.col("kinds") > CROWD)
    if not crowded.isEmpty():
        merged = merged.unionByName(_split(cut(_with_texts(contexts, crowded, packed()).mapInArrow(_entry_batches, _ENTRY).drop("part"))))

    whole = contexts.where("n > 1").select("c1", "c2", F.lit(None).cast("binary").alias("cover"))
    # an entry that stands for two suffixes has all its windows repeated, whatever the merge says of it
    some = merged.join(whole.select("c1", "c2"), ["c1", "c2"], "left_anti")
    placed = found.join(whole.unionByName(some), ["c1", "c2"]).select("row", "place", "cover")
    return placed.groupBy("row").agg(F.collect_set(F.struct("place", "cover")).alias("ranges"))


def _with_texts(contexts: DataFrame, keys: DataFrame, packed: DataFrame) -> DataFrame:
    """(body, wanted): one suffix of each context of the keys, beside its text."""
    wanted = contexts.join(keys.select("key"), "key", "left_semi").select("key", "c1", "c2", "one.row", "one.place")
    return packed.join(wanted.groupBy("row").agg(F.collect_list(F.struct("key", "c1", "c2", "place")).alias("wanted")), "row").select("body", "wanted")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, bytes, int, int]]:
    """(part, suffix, before, c1, c2) of the wanted suffixes, as far as their contexts go; part is the key's bytes."""
    for batch in batches:
        for packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            body = _body(packed)
            for w in wanted:
                place = w["place"]
                at = place >> 16
                yield (w["key"] & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big"), body[at : at + (place & 255)], body[at - (place >> 8 & 255) : at], w["c1"], w["c2"]


def _entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _entries(batches)
    while some := list(itertools.islice(rows, _OUT_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), [pa.binary()] * 3 + [pa.int64()] * 2, strict=True)], names=["part", "suffix", "before", "c1", "c2"])


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, bytes, int, int]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_ENTRY = "part binary, suffix binary, before binary, c1 long, c2 long"


def _split(entries: DataFrame) -> DataFrame:
    """(c1, c2, cover) of entries (suffix, before, c1, c2) of crowded keys, which are split by more of their bytes."""
    todo, out = entries.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(SPREAD)), None
    while True:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = todo.withColumn("_half", F.explode(F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi")))).select("suffix", "before", "c1", "c2", "_half.lo", "_half.hi")
        # those that have a window at one of the distances
        halves = halves.where(F.greatest("lo", F.lit(LENGTH) - F.length("suffix")) <= F.least(F.col("hi") - 1, F.length("before")))
        shared_bytes = F.concat(F.concat_ws(":", "lo", "hi", F.lit("")).cast("binary"), F.expr("substring(before, length(before) - lo + 1, lo)"), F.expr(f"substring(suffix, 1, {LENGTH + 1} - hi)"))
        halves = cut(halves.withColumn("part", F.unhex(F.md5(shared_bytes))))
        size = halves.groupBy("part").agg(F.count("*").alias("size")).where("size > 1")
        sized = halves.join(size, "part")
        # the whole window is alike: a cover of that distance alone, as two int16 (least byte first)
        one = F.unhex(F.concat(F.lpad(F.hex("lo"), 2, "0"), F.lit("00")))
        alone = sized.where("hi - lo = 1").select("c1", "c2", F.concat(one, one).alias("cover"))
        calm = sized.where((F.col("hi") - F.col("lo") > 1) & (F.col("size") <= CROWD))
        n = calm.count()
        merged = _merge(calm.select("part", "suffix", "before", "c1", "c2"), 16, n)
        got = alone.unionByName(merged) if n else alone
        out = got if out is None else out.unionByName(got)
        todo = sized.where((F.col("hi") - F.col("lo") > 1) & (F.col("size") > CROWD)).drop("part", "size")
        if todo.isEmpty():
            return out


def _merge(entries: DataFrame, lead: int, n: int, read: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]] = _entry_rows) -> DataFrame:
    """entries: (part, suffix, before, c1, c2), n of them, or what read makes these of. (c1, c2, cover) of those that share windows with others of
    their part; a part is known by `lead` bytes that are set before the suffix, or by the suffix's own first KEY."""
    owners = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // _OWNER_ENTRIES))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Entry]] = {}
        count = 0

        def flush() -> pa.RecordBatch:
            owner = list(held)
            blobs = [encode_run(sorted(held[i])) for i in owner]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), pa.array(blobs, pa.binary())], names=["owner", "run"])

        for part, suffix, before, c1, c2 in read(batches):
            held.setdefault(int.from_bytes(part[:8], "big") % owners, []).append((part[:lead] + suffix, before, c1, c2))
            count += 1
            if count >= _RUN_ENTRIES:
                yield flush()
                count = 0
        if count:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for owner, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(owner, []).append(blob)
        for owner in list(by):
            rows = _resolve(merge_runs([decode_run(b) for b in by.pop(owner)]), lead)
            while some := list(itertools.islice(rows, _OUT_ROWS)):
                c1, c2, spans = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(spans, pa.binary())], names=["c1", "c2", "cover"])

    return entries.mapInArrow(runs, "owner int, run binary").repartition(owners, "owner").mapInArrow(merge, "c1 long, c2 long, cover binary")


def _removed(size: int, ranges: list[dict]) -> np.ndarray:
    """Which bytes go."""
    edge = np.zeros(size + 1, np.int32)
    for r in ranges:
        at, before, after = r["place"] >> 16, r["place"] >> 8 & 255, r["place"] & 255
        spans = [(LENGTH - after, before)] if r["cover"] is None else np.frombuffer(r["cover"], np.int16).reshape(-1, 2).tolist()
        for least, most in spans:
            edge[at - most] += 1
            edge[at - least + LENGTH] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept): kept is the bytes that stay."""
    return _finish(docs, id_col, text_col, False)


def _finish(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    last = "kept_sha256 string" if digest else "kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for body, ranges in zip(batch.column(1), batch.column(2), strict=True):
                text, n, spans = _body(body.as_py()), 0, 0
                size = len(text)
                if ranges.is_valid:
                    gone = _removed(size, ranges.as_py())
                    n, spans = int(gone.sum()), int(np.count_nonzero(np.diff(np.append(False, gone).astype(np.int8)) == 1))
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((size, n, spans, hashlib.sha256(text).hexdigest() if digest else text))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string() if digest else pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", last.split()[0]])

    joined = _packed(docs, id_col, text_col).join(repeated_ranges(docs, id_col, text_col), "row", "left")
    return joined.select(F.col("doc").alias(id_col), "body", "ranges").mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, {last}")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of documents."""
    return _finish(table(spark, sf_dir, "documents"), "doc_id", "text", True)
