"""Quality rules and line labelling.

Base rules count words, symbols, repeated lines and repeated five-word windows of each whole text. What they pass is
judged by a linear-chain conditional random field over the text's lines: Viterbi decoding marks each line as content
or boilerplate, and the share of words in content lines decides whether the text stays.

Labels say of whole texts whether they are good, not which of their lines are boilerplate, and most texts have both.
So line labels are latent: training starts from lines on their own, then alternates between the labels that the field
expects of each text's lines, given that at least GOOD_SHARE of a good text's words and at most BAD_SHARE of a bad
text's words lie in content (the smallest change to the field's own view that meets this), and the field that makes
these labels and their neighbourhoods likeliest. A text's lines may so differ from the text's label and from each
other, and the chain learns how often they switch.

The field is fitted on a bounded sample of labelled rows (about MAX_TRAIN_DOCS texts, chosen by a hash of the id),
each read whole; lines are taken in runs of TRAIN_RUN, all of them.

Defined results: a null text has no words, so the base rules reject it, as they reject empty texts. Without labelled
rows of both classes the field has no weights and keeps what the base rules keep. Texts of any length are judged
whole. A share of exactly the bound is kept; equal scores of two labels go to content; of repeated labels of an id the
smallest counts. Rows with null or repeated ids are judged like others, a null id is never a training row. An empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm.common import Chunk, chunks, segment_sums, table

MAX_TRAIN_DOCS = 3000
TRAIN_RUN = 256
GOOD_SHARE = 0.8
BAD_SHARE = 0.2
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_CONTENT_SHARE = 0.5
WINDOW = 5
_TURNS = 4
_MOST_LEAN = 30.0
_LEAN_STEPS = 7

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_CONTINUATION = (np.arange(256) & 0xC0) != 0x80
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_PIPE, _BANG = np.zeros(256, bool), np.zeros(256, bool)
_PIPE[124] = _BANG[33] = True
_POWERS = np.random.default_rng(7).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Buckets of each measure; a line has one feature of each measure.
_EDGES = {
    "words": [1, 2, 4, 8, 16, 32],
    "symbols": [0.001, 0.02, 0.05, 0.1, 0.2, 0.4],
    "pipes": [0.001, 0.02, 0.05, 0.1, 0.2],
    "upper": [0.02, 0.05, 0.1, 0.3, 0.6],
    "digits": [0.001, 0.05, 0.15, 0.4],
    "bangs": [0.001, 0.02, 0.05, 0.1],
    "word_length": [2, 4, 6, 9, 14, 25],
    "repeat": [0.5],
    "ends": [0.5],
}
_BASE = np.cumsum([0, *(len(e) + 1 for e in _EDGES.values())])
N_FEATURES = int(_BASE[-1])


class Lines:
    """The \\n-split lines of a chunk: of (their text's row), words, features (an index for each measure)."""

    def __init__(self, chunk: Chunk) -> None:
        data = chunk.data
        n = len(chunk)
        breaks = np.flatnonzero(data == 10)
        of_break = np.searchsorted(chunk.ends, breaks, side="right")
        counts = np.bincount(of_break, minlength=n) + 1
        self.of = np.repeat(np.arange(n), counts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        self.starts, self.ends = np.zeros(len(self.of), np.int64), np.zeros(len(self.of), np.int64)
        rank = np.arange(len(breaks)) - np.searchsorted(of_break, of_break, side="left")
        self.ends[first[of_break] + rank], self.starts[first[of_break] + rank + 1] = breaks, breaks + 1
        self.starts[first], self.ends[first + counts - 1] = chunk.starts, chunk.ends
        self.counts = counts

        space = _SPACE[data]
        word_start = ~space
        word_start[1:] &= space[:-1]
        some = chunk.ends > chunk.starts
        word_start[chunk.starts[some]] = ~space[chunk.starts[some]]
        self.word_start, self.space = word_start, space
        total = lambda mask: _between(mask, self.starts, self.ends)
        self.words = total(word_start)
        points = np.maximum(1, total(_NOT_CONTINUATION[data] & ~space))
        letters = np.maximum(1, total(_UPPER[data]) + total(_LOWER[data]))
        last = np.zeros(len(self.of), bool)
        full = self.ends > self.starts
        last[full] = np.isin(data[self.ends[full] - 1], list(b".!?;:,"))
        measures = {
            "words": self.words,
            "symbols": total(_SYMBOL[data]) / points,
            "pipes": total(_PIPE[data]) / points,
            "upper": total(_UPPER[data]) / letters,
            "digits": total(_DIGIT[data]) / points,
            "bangs": total(_BANG[data]) / points,
            "word_length": points / np.maximum(1, self.words),
            "repeat": self._repeats(data),
            "ends": last,
        }
        self.features = np.stack([_BASE[j] + np.digitize(measures[m], e) for j, (m, e) in enumerate(_EDGES.items())], axis=1)

    def _repeats(self, data: np.ndarray) -> np.ndarray:
        """The share of the line's words that are equal to the word before, a sign of stuttering."""
        at = np.flatnonzero(self.word_start)
        if len(at) < 2:
            return np.zeros(len(self.of))
        line = np.searchsorted(self.ends, at, side="right")
        inside = ~self.space
        within = np.arange(len(data)) - np.repeat(np.append(0, at), np.diff(np.concatenate([[0], at, [len(data)]])))
        code = np.where(inside, data.astype(np.uint64) + np.uint64(1), np.uint64(0)) * _POWERS[within % len(_POWERS)]
        word = np.add.reduceat(code, at)
        same = np.zeros(len(at))
        same[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
        out = np.bincount(np.minimum(line, len(self.of) - 1), weights=same, minlength=len(self.of))
        return out / np.maximum(1, self.words - 1)


def _between(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[ends] - total[starts]


def base_counts(chunk: Chunk, lines: Lines) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(chunk)
    out = {
        "n_words": chunk.sums(lines.word_start),
        "word_chars": chunk.sums(_NOT_CONTINUATION[chunk.data] & ~lines.space),
        "n_symbols": chunk.sums(_SYMBOL[chunk.data]),
        "n_dup_lines": np.zeros(n, np.int64),
        "n_repeat_words": np.zeros(n, np.int64),
    }
    worded = np.bincount(lines.of, weights=lines.words > 0, minlength=n)
    for i, text in enumerate(chunk.texts()):
        if worded[i] > 1:
            kept = [x for x in text.split(b"\n") if x and not x.isspace()]
            out["n_dup_lines"][i] = len(kept) - len(set(kept))
        if out["n_words"][i] > WINDOW:
            out["n_repeat_words"][i] = repeated_words(text.split())
    return out


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a five-word window that is found twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


class LineField:
    """A linear-chain conditional random field with the labels 0 (boilerplate) and 1 (content)."""

    def __init__(self) -> None:
        self.emit = np.zeros((N_FEATURES, 2))
        self.step = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.trained = False

    def unary(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(axis=1)

    def fit(self, features: np.ndarray, first: np.ndarray, node_target: np.ndarray, pair_target: np.ndarray | None, rounds: int = 40, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Accelerated gradient ascent on the expected log likelihood. node_target: P(label) of each line; pair_target:
        how often each label follows each, or None to leave lines without neighbours."""
        n = len(features)
        chained = pair_target is not None
        starts = first if chained else np.arange(n)
        before = [x.copy() for x in (self.emit, self.step, self.start)]
        for t in range(1, rounds + 1):
            node, pair = self.marginals(features, starts)
            gap = node_target - node
            grad = np.stack([np.bincount(features.ravel(), weights=np.repeat(gap[:, y], features.shape[1]), minlength=N_FEATURES) for y in (0, 1)], axis=1)
            now = [self.emit + rate * (grad / n - decay * self.emit), self.step, self.start]
            if chained:
                now[1] = self.step + rate * ((pair_target - pair.sum(0)) / n - decay * self.step)
                now[2] = self.start + rate * (gap[first].sum(0) / n - decay * self.start)
            ahead = (t - 1) / (t + 2)
            self.emit, self.step, self.start = (x + ahead * (x - y) for x, y in zip(now, before, strict=True))
            before = now
        self.emit, self.step, self.start = before
        self.trained = True

    def expected(self, features: np.ndarray, first: np.ndarray, text: np.ndarray, weight: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label) of each line and the sum of P(label, next label), each text's content leant on until its share of
        the weight meets the text's label. text: the text of each line; weight: its share of that text's words."""
        lines = np.bincount(text, minlength=len(good))
        reach = (weight * lines[text])[:, None] * np.where(good, 1.0, -1.0)[text][:, None] * np.array([0.0, 1.0])

        def at(lean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            node, pair = self.marginals(features, first, reach * lean[text][:, None])
            share = np.bincount(text, weights=node[:, 1] * weight, minlength=len(good))
            return node, pair, np.where(good, share >= GOOD_SHARE, share <= BAD_SHARE)

        low, high = np.zeros(len(good)), np.full(len(good), _MOST_LEAN)
        high[at(low)[2]] = 0.0
        for _ in range(_LEAN_STEPS):
            mid = (low + high) / 2
            met = at(mid)[2]
            low, high = np.where(met, low, mid), np.where(met, mid, high)
        node, pair, _ = at(high)
        return node, pair.sum(0)

    def marginals(self, features: np.ndarray, first: np.ndarray, more: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """P(label) of each line and P(last, label) of each step, by forward and backward sums over all sequences. more:
        what is added to the lines' own scores."""
        u = self.unary(features) + more
        n = len(u)
        size = np.diff(np.append(first, n))
        order = np.argsort(-size, kind="stable")
        begin, size = first[order], size[order]
        alpha, beta, pair = u.copy(), np.zeros((n, 2)), np.zeros((n, 2, 2))
        alpha[first] += self.start
        for t in range(1, int(size[0]) if len(size) else 0):
            at = begin[: np.searchsorted(-size, -t, side="left")] + t
            alpha[at] += np.logaddexp(alpha[at - 1, 0, None] + self.step[0], alpha[at - 1, 1, None] + self.step[1])
        for t in range(int(size[0]) - 1 if len(size) else 0, 0, -1):
            at = begin[: np.searchsorted(-size, -t, side="left")] + t
            ahead = u[at] + beta[at]
            beta[at - 1] = np.logaddexp(self.step[:, 0] + ahead[:, 0, None], self.step[:, 1] + ahead[:, 1, None])
            joint = alpha[at - 1][:, :, None] + self.step + ahead[:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            pair[at] = joint / joint.sum(axis=(1, 2), keepdims=True)
        node = alpha + beta
        node = np.exp(node - node.max(1, keepdims=True))
        return node / node.sum(1, keepdims=True), pair

    def learn(self, features: np.ndarray, text: np.ndarray, words: np.ndarray, good: np.ndarray) -> None:
        """Fit to texts that are good or not. text: the text of each line, ascending; words: how many each line has."""
        if good.all() or not good.any():
            return
        counts = np.bincount(text, minlength=len(good))
        within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = np.flatnonzero(within % TRAIN_RUN == 0)
        weight = words / np.maximum(1, np.bincount(text, weights=words, minlength=len(good)))[text]
        content = np.where(good[text], GOOD_SHARE, BAD_SHARE)
        self.fit(features, first, np.stack([1 - content, content], axis=1), None)
        for _ in range(_TURNS):
            node, pair = self.expected(features, first, text, weight, good)
            self.fit(features, first, node, pair)

    def viterbi(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label sequence of each run of lines that begins at first; equal scores go to content."""
        u = self.unary(features)
        n = len(u)
        size = np.diff(np.append(first, n))
        order = np.argsort(-size, kind="stable")
        begin, size = first[order], size[order]
        best, back = u.copy(), np.zeros((n, 2), np.int8)
        best[first] += self.start
        for t in range(1, int(size[0]) if len(size) else 0):
            at = begin[: np.searchsorted(-size, -t, side="left")] + t
            from0, from1 = best[at - 1, 0, None] + self.step[0], best[at - 1, 1, None] + self.step[1]
            back[at] = from1 >= from0
            best[at] += np.maximum(from0, from1)
        label = np.zeros(n, np.int8)
        last = begin + size - 1
        label[last] = best[last, 1] >= best[last, 0]
        for t in range(int(size[0]) - 1 if len(size) else 0, 0, -1):
            at = begin[: np.searchsorted(-size, -t, side="left")] + t
            label[at - 1] = back[at, label[at]]
        return label


def sample_share(total: int, most: int) -> float:
    return min(1.0, most / max(1, total))


def train_field(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField:
    """Fit on about max_docs labelled texts, chosen by a hash of the id; an id's first label in sort order counts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label"))
    share = sample_share(known.count(), max_docs)
    picked = known.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text_col):
            lines = Lines(chunk)
            cuts = np.cumsum(np.append(0, lines.counts)).tolist()
            looks, words = lines.features.astype(np.uint8), lines.words.astype(np.int64)
            each = [[x[a:b].tobytes() for a, b in itertools.pairwise(cuts)] for x in (looks, words)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()) for x in each), chunk.batch.column(1)], names=["features", "words", "label"])

    rows = docs.select(id_col, text_col).join(picked, id_col).select(F.col(text_col), F.col("_label").alias("label")).mapInArrow(run, "features binary, words binary, label int").toArrow()
    field = LineField()
    if rows.num_rows:
        features, words = ([np.frombuffer(x, t) for x in rows.column(c).to_pylist()] for c, t in (("features", np.uint8), ("words", np.int64)))
        # an order that does not depend on how the rows came in
        order = sorted(range(len(words)), key=lambda i: (features[i].tobytes(), words[i].tobytes()))
        features, words = [features[i].reshape(-1, len(_EDGES)) for i in order], [words[i] for i in order]
        text = np.repeat(np.arange(len(words)), [len(w) for w in words])
        field.learn(np.concatenate(features).astype(np.int64), text, np.concatenate(words), rows.column("label").to_numpy()[order] == 1)
    return field


def judge(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """A row for each text: the base counts, base_failed, content_share and kept."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text_col):
            lines = Lines(chunk)
            c = base_counts(chunk, lines)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            if field.trained:
                label = field.viterbi(lines.features, np.cumsum(lines.counts) - lines.counts)
                share = segment_sums(lines.words * label, np.cumsum(lines.counts) - lines.counts, np.cumsum(lines.counts)) / np.maximum(1, c["n_words"])
            else:
                share = np.ones(len(chunk))
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), *(pa.array(v, pa.int64()) for v in c.values()), pa.array(failed), pa.array(share, pa.float64()), pa.array(~failed & (share >= min_share))], names=[id_col, *c, "base_failed", "content_share", "kept"])

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {counts}, base_failed boolean, content_share double, kept boolean")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share and kept of every row of documents."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train_field(docs, table(spark, sf_dir, "labels")))
