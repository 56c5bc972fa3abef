"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what is said again in other ways.

Base spans come from the four patterns of KINDS, each leftmost and non-overlapping within its kind; matches that fail
their check (address parts, Luhn sum, digit count) are dropped without another try. They always stay.

The field's nodes are, in the order of the text, the base spans (their labels are given) and the other words that
hold a digit or an @. All other words can only be "none", so they need no nodes, but they are part of the chain: words
that stand next to each other share a chain potential, and a node beside such a word shares it with the label "none".
Nodes whose forms are alike wherever they stand in the text
(same last digits, same letters and digits, same part before the @) share a skip potential, each with the one before
and the one after it of that form, and free words also with the nearest base span of that form on either side, however
many stand between. Loopy belief propagation over this graph gives each free word its marginals, and a
word whose likeliest label is a kind of personal data becomes a span of that kind.

The weights maximise the pseudo-likelihood: over all texts Spark counts how often each label came with each look of a
node and each labels of its neighbours (the looks are a fixed, finite set, so the counts are a small table however
large the corpus is), and a multinomial regression is fitted to that table. Free words count as "none", except those
like a base span: whether they are one is what the field is asked.

Defined results: a null text counts as empty and has no spans; spans are code points with the end exclusive. Equal
marginals go to the kind first in KINDS. Rows are judged one by one, so null or repeated ids and repeated rows change
nothing (but count in the weights); texts of any length are read whole, with messages in memory that grows with the
text's nodes. An empty table gives no rows; other columns are not looked at, or kept where texts are masked.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm.common import chunks, table

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)  # the label of what is no personal data
N_LABELS = NONE + 1
#: Messages are passed until they stand still; at the most so many rounds, and two more for each node of the longest
#: run of alike nodes. A round works out only messages whose senders have heard something new, and a text's messages are
#: worked out UPDATES times each on average at the most, so that the work grows in line with the text.
ROUNDS = 48
UPDATES = 256
#: What the skip potential of equal labels is taken to be until the counts say otherwise.
ALIKE = 2.0
_MESSAGES = 1 << 16

_MARKS = np.zeros(256, bool)
_MARKS[[*range(48, 58), 64]] = True
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is taken whole or not at all, which gives the same matches and never goes back
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = "\"'`.,;:!?()[]{}<>|*#$%&="
_BESIDE = _TRIM + " \t\n\v\f\r"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ can end one local part at most: the run of its letters back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = m.end()
                yield start, done
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind."""
    out: list[Span] = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


class Graph:
    """The nodes of one text: spans, given labels (-1 for free words), looks, and skip links (a, b)."""

    def __init__(self, text: str, base: list[Span]) -> None:
        nodes = [(a, b, k) for a, b, k in base]
        stops, upto = sorted((a, b) for a, b, _ in base), 0
        i = 0
        for m in _WORD.finditer(text):
            if not any("0" <= c <= "9" or c == "@" for c in m[0]):
                continue
            a, b = m.start(), m.end()
            while a < b and text[a] in _TRIM:
                a += 1
            while a < b and text[b - 1] in _TRIM:
                b -= 1
            if a == b:
                continue
            while i < len(stops) and stops[i][0] < b:
                upto = max(upto, stops[i][1])
                i += 1
            if upto <= a:
                nodes.append((a, b, -1))
        nodes.sort(key=lambda s: (s[0], s[1], s[2]))
        self.nodes = nodes
        #: whether each node and the next stand side by side, and whether a plain word is before and after each node
        between = [text[p[1] : q[0]].strip(_BESIDE) for p, q in itertools.pairwise(nodes)]
        self.adjacent = [not x for x in between]
        edges = [text[: nodes[0][0]].strip(_BESIDE), *between, text[max(n[1] for n in nodes) :].strip(_BESIDE)] if nodes else []
        self.plain_before, self.plain_after = [bool(x) for x in edges[:-1]], [bool(x) for x in edges[1:]]
        forms = [text[a:b] for a, b, _ in nodes]
        self.looks = [look(f) for f in forms]
        self.links: list[tuple[int, int]] = []
        last: dict[str, int] = {}
        named = [keys(f) for f in forms]
        for j, own in enumerate(named):
            for key in own:
                if key in last:
                    self.links.append((last[key], j))
                last[key] = j
        self.longest = max(Counter(key for own in named for key in own).values(), default=0)
        linked = set(self.links)
        for way in (range(len(nodes)), range(len(nodes) - 1, -1, -1)):
            said: dict[str, int] = {}
            for j in way:
                for key in named[j]:
                    if nodes[j][2] >= 0:
                        said[key] = j
                    elif key in said and (pair := (min(said[key], j), max(said[key], j))) not in linked:
                        linked.add(pair)
                        self.links.append(pair)


def look(form: str) -> int:
    """A number for how a word looks; there are fewer than 3,000. A card's check sum is part of its looks: without it
    any long number would look like one."""
    figures = "".join(c for c in form if "0" <= c <= "9")
    digits = len(figures)
    letters = sum(c.isalpha() for c in form)
    dots = min(4, form.count("."))
    size = 0 if digits == 0 else 1 if digits <= 3 else 2 if digits <= 6 else 3 if digits <= 8 else 4 if digits <= 11 else 5 if digits <= 19 else 6
    marks = min(2, form.count("-") + form.count(" "))
    summed = size == 5 and luhn(figures)
    return (((((size * 5 + dots) * 3 + min(2, letters)) * 2 + ("@" in form)) * 2 + form.startswith("+")) * 3 + marks) * 2 + summed


N_LOOKS = 7 * 5 * 3 * 2 * 2 * 3 * 2


def keys(form: str) -> list[str]:
    """Forms with a common key are alike."""
    digits = "".join(c for c in form if "0" <= c <= "9")
    bare = "".join(c for c in form.lower() if c.isalnum())
    out = [f"a{bare}"] if len(bare) >= 6 else []
    if len(digits) >= 7 and len(digits) * 2 >= len(bare):
        out.append(f"d{digits[-7:]}")
    if "@" in form and len(form.partition("@")[0]) >= 3:
        out.append(f"l{form.partition('@')[0].lower()}")
    return out


def examples(text: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(look, label before, label after, label of a node alike, own label) of each node; NONE where there is none, and
    N_LABELS for no such neighbour."""
    g = Graph(text, base_spans(text))
    given = [k if k >= 0 else NONE for _, _, k in g.nodes]
    alike: dict[int, set[int]] = {}
    for a, b in g.links:
        alike.setdefault(a, set()).add(given[b])
        alike.setdefault(b, set()).add(given[a])
    for j, (_, _, k) in enumerate(g.nodes):
        near = alike.get(j, set())
        if k < 0 and near - {NONE}:
            continue
        before = NONE if g.plain_before[j] else given[j - 1] if j else N_LABELS
        after = NONE if g.plain_after[j] else given[j + 1] if j + 1 < len(given) else N_LABELS
        yield g.looks[j], before, after, min(near) if near else N_LABELS, given[j]


class SkipChain:
    """Log potentials: emit[look, label], chain[label, next label], skip[label, label]. The last row and column of
    chain stand for a text's ends, those of skip for no word alike."""

    def __init__(self, emit: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.emit, self.chain, self.skip = emit, chain, skip

    def added(self, text: str, base: list[Span]) -> list[Span]:
        g = Graph(text, base)
        if all(k >= 0 for _, _, k in g.nodes):
            return []
        label = self.marginals(g).argmax(1)
        return [(a, b, int(y)) for (a, b, k), y in zip(g.nodes, label, strict=True) if k < 0 and y != NONE]

    def marginals(self, g: Graph) -> np.ndarray:
        """Sum-product messages along chain and skip links, averaged with the last round's; those at rest are left alone."""
        n = len(g.nodes)
        if not n:
            return np.zeros((0, N_LABELS))
        unary = self.emit[g.looks].copy()
        for side, table_ in ((g.plain_before, self.chain[:, :N_LABELS]), (g.plain_after, self.chain.T[:, :N_LABELS])):
            unary[np.array(side, bool)] += table_[NONE]
        for end, plain, table_ in ((0, g.plain_before, self.chain[:, :N_LABELS]), (n - 1, g.plain_after, self.chain.T[:, :N_LABELS])):
            if not plain[end]:
                unary[end] += table_[N_LABELS]
        given = np.array([k for _, _, k in g.nodes])
        alone = np.ones(n, bool)
        alone[[j for pair in g.links for j in pair]] = False
        unary[alone] += self.skip[N_LABELS, :N_LABELS]
        unary[given >= 0] = -np.inf
        unary[given >= 0, given[given >= 0]] = 0.0
        pairs = [(j, j + 1) for j in range(n - 1) if g.adjacent[j]]
        chained = len(pairs)
        pairs += g.links
        if not pairs:
            return _softmax(unary)
        m = len(pairs)
        a, b = (np.array(x) for x in zip(*pairs, strict=True))
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        # runs of messages with one potential: forwards and backwards, along the chain and along skip links
        chain, skip = np.exp(self.chain[:N_LABELS, :N_LABELS]), np.exp(self.skip[:N_LABELS, :N_LABELS])
        runs = [(0, chained, chain), (chained, m, skip), (m, m + chained, chain.T), (m + chained, 2 * m, skip.T)]
        runs = [(s, min(e, s + _MESSAGES), pot) for a, e, pot in runs for s in range(a, e, _MESSAGES)]
        msg = np.zeros((2 * m, N_LABELS))
        belief = unary.copy()
        # what a given node is told changes nothing, as its label stands
        told = given[dst] < 0
        leaving = np.argsort(src, kind="stable")
        begin = np.searchsorted(src[leaving], np.arange(n + 1))
        active, left = np.flatnonzero(told), UPDATES * 2 * m
        for _ in range(ROUNDS + 2 * g.longest):
            if not len(active) or left <= 0:
                break
            moved = []
            for s, e, pot in runs:
                at = active[np.searchsorted(active, s) : np.searchsorted(active, e)]
                if not len(at):
                    continue
                cavity = belief[src[at]] - msg[np.where(at < m, at + m, at - m)]
                cavity -= cavity.max(1, keepdims=True)
                out = np.log(np.maximum(1e-300, np.exp(cavity) @ pot))
                step = out - out.max(1, keepdims=True) - msg[at]
                some = np.abs(step).max(1) >= 1e-4
                moved.append((at[some], 0.5 * step[some]))
            at, step = (np.concatenate(x) for x in zip(*moved, strict=True))
            left -= len(active)
            msg[at] += step
            np.add.at(belief, dst[at], step)
            # next: what has just moved, and what leaves the nodes that were told something new
            heard = np.unique(dst[at])
            size = begin[heard + 1] - begin[heard]
            place = np.arange(size.sum()) + np.repeat(begin[heard] - np.cumsum(size) + size, size)
            after = leaving[place]
            active = np.union1d(at, after[told[after]])
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(t: np.ndarray, n: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> SkipChain:
    """Multinomial regression on the counted table t (look, before, after, alike, label), n its counts."""
    emit, chain = np.zeros((N_LOOKS, N_LABELS)), np.zeros((N_LABELS + 1, N_LABELS + 1))
    skip = prior = np.diag([ALIKE] * N_LABELS + [0.0])
    if not len(t):
        emit[:, NONE] = 1.0
        return SkipChain(emit, chain, skip)
    lk, before, after, alike, y = t.T
    weight = n / n.sum()
    onehot = np.eye(N_LABELS)[y]
    own = np.arange(N_LABELS)
    state = [emit, chain, skip]
    last = [x.copy() for x in state]
    for r in range(1, rounds + 1):
        emit, chain, skip = state
        p = _softmax(emit[lk] + chain[before][:, own] + chain[:, after].T[:, own] + skip[alike][:, own])
        gap = (onehot - p) * weight[:, None]
        g_emit, g_chain, g_skip = np.zeros_like(emit), np.zeros_like(chain), np.zeros_like(skip)
        np.add.at(g_emit, lk, gap)
        np.add.at(g_chain[:, :N_LABELS], before, gap)
        np.add.at(g_chain.T[:, :N_LABELS], after, gap)
        np.add.at(g_skip[:, :N_LABELS], alike, gap)
        g_skip = (g_skip + g_skip.T) / 2
        now = [x + 1.0 * (g - ridge * (x - mean)) for x, g, mean in zip(state, (g_emit, g_chain, g_skip), (0.0, 0.0, prior), strict=True)]
        ahead = (r - 1) / (r + 2)
        state = [x + ahead * (x - z) for x, z in zip(now, last, strict=True)]
        last = now
    emit, chain, skip = last
    emit[np.bincount(lk, weights=n, minlength=N_LOOKS) == 0, NONE] += 1.0  # a look never met is nothing, unless others say so
    return SkipChain(emit, chain, skip)


def learn_field(docs: DataFrame, text_col: str = "text") -> SkipChain:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, int, int, int, int]] = Counter()
        for chunk in chunks(batches, text_col):
            for i in np.flatnonzero(chunk.sums(_MARKS[chunk.data]) > 0):
                seen.update(examples(chunk.data[chunk.starts[i] : chunk.ends[i]].tobytes().decode("utf-8", "replace")))
        cols = list(zip(*seen, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols), pa.array(list(seen.values()), pa.int64())], names=[*names, "n"])

    names = ["look", "before", "after", "alike", "label"]
    t = docs.select(text_col).mapInArrow(run, "look int, before int, after int, alike int, label int, n long").groupBy(*names).agg(F.sum("n").alias("n")).toArrow()
    counted = np.stack([t.column(c).to_numpy() for c in names], axis=1).astype(np.int64).reshape(-1, 5)
    order = np.lexsort(counted.T)
    return _fit(counted[order], t.column("n").to_numpy()[order].astype(np.float64))


def _text_of(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _masked(text: str, spans: list[Span]) -> str:
    out, upto = [], 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if a >= upto:
            out += [text[upto:a], f"<{KINDS[k].upper()}>"]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])


def find(docs: DataFrame, field: SkipChain, id_col: str | None = "doc_id", text_col: str = "text", mask: bool = False) -> DataFrame:
    """A row for each text: counts of its base spans by kind, which follow from the text alone, and all spans, those that
    the field adds included; with mask, all columns of docs and the text with its spans replaced by <KIND> instead."""
    sent = docs.sparkSession.sparkContext.broadcast((field.emit, field.chain, field.skip))

    def spans_of(chunk) -> Iterator[tuple[int, str, list[Span], list[Span]]]:  # noqa: ANN001
        own = SkipChain(*sent.value)
        for i in np.flatnonzero(chunk.sums(_MARKS[chunk.data]) > 0):
            text = chunk.data[chunk.starts[i] : chunk.ends[i]].tobytes().decode("utf-8", "replace")
            base = base_spans(text)
            yield int(i), text, base, own.added(text, base)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for chunk in chunks(batches, text_col):
            n = len(chunk)
            counts = np.zeros((4, n), np.int64)
            sha, spans = [nothing] * n, [""] * n
            for i, _, base, more in spans_of(chunk):
                every = sorted(base + more, key=lambda s: (s[0], s[2], s[1]))
                for _, _, k in base:
                    counts[k, i] += 1
                sha[i] = hashlib.sha256(_text_of(base).encode()).hexdigest()
                spans[i] = _text_of(every)
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), *(pa.array(c) for c in counts), pa.array(sha), pa.array(spans, pa.string())], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    def masking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text_col):
            at = chunk.batch.schema.get_field_index(text_col)
            new = chunk.batch.column(at).to_pylist()
            for i, text, base, more in spans_of(chunk):
                if base or more:
                    new[i] = _masked(text, base + more)
            yield chunk.batch.set_column(at, chunk.batch.schema.field(at), pa.array(new, chunk.batch.schema.field(at).type))

    if mask:
        return docs.mapInArrow(masking, docs.schema)
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(id_col, text_col).mapInArrow(digest, f"{id_col} {kind}, {counts}, base_sha256 string, spans string")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts of base spans by kind, base_sha256 and all spans of every row of documents."""
    docs = table(spark, sf_dir, "documents")
    return find(docs, learn_field(docs))
