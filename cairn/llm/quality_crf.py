"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are binned shape statistics of itself and of the lines
before and after it; two weights tie neighbouring labels. Training lines take the label of their
document, and the exact conditional likelihood is maximised by gradient steps (Adam) over forward-backward marginals.
A document's score is the mean of its lines' marginals for "good", weighted by line length in bytes.

The model is fitted on at most ``SAMPLE_DOCS`` labelled documents with at most ``SAMPLE_LINES`` lines (and one document at least), those with the least hash of their
id, documents of more than a ``LONG_SHARE``-th of the lines after all others; their features are computed on the executors, and the driver gets 16 numbers a line.

Defined cases: a null or empty text is one empty line of weight 1; without usable labels every score is
the neutral 0.5; a document with labels on both sides counts once for each; rows repeat their score;
null labels or ids are not learned from; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import lookup_table, materialise, mix, prefix_hash, range_hash, text_slices, words_of

SAMPLE_DOCS = 3000
SAMPLE_LINES = 1 << 20
LONG_SHARE = 64
BINS = 8
STEPS = 200
RATE = 0.08
#: Lines from which a text's chain is summed in stretches.
STRETCH = 2048
PENALTY = 1e-3
_WORDS = lookup_table("nonspace")


def _class(test) -> np.ndarray:
    return np.array([test(i) for i in range(256)])


_CLASSES = np.stack(
    [
        _class(lambda i: chr(i).isalpha() if i < 128 else True),
        _class(lambda i: 65 <= i <= 90),
        _class(lambda i: 48 <= i <= 57),
        _class(lambda i: i in b" \t\r\x0b\x0c"),
        _class(lambda i: i in b".,;:'\"-()"),
        _class(lambda i: i in b"!?"),
        _class(lambda i: i in b"#$%&*+/<=>@[\\]^_`{}~"),
        _class(lambda i: i in b"|"),
    ]
).astype(np.int32)
N_FEATURES = 15


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, line offsets of the texts, line lengths); every text has a line at least."""
    breaks = np.flatnonzero(data == 10)
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    at = np.concatenate([[0], np.cumsum(per_text)])
    owner = np.repeat(np.arange(len(per_text)), per_text)
    start, end = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
    first, last = at[:-1], at[1:] - 1
    inner = np.ones(len(owner), bool)
    inner[first] = False
    start[inner], start[first] = breaks + 1, offsets[:-1]
    inner = np.ones(len(owner), bool)
    inner[last] = False
    end[inner], end[last] = breaks, offsets[1:]
    size = end - start
    n = np.maximum(size, 1)
    share = []
    for table in _CLASSES:
        total = np.concatenate([[0], np.cumsum(table[data])])
        share.append((total[end] - total[start]) / n)
    word, word_start, word_end, _ = words_of(data, offsets, _WORDS)
    lo, hi = np.searchsorted(word_start, start), np.searchsorted(word_start, end)
    words = hi - lo
    m = np.maximum(words, 1)
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], word[1:] == word[:-1]]))]) if len(word) else np.zeros(1, np.int64)
    repeated = np.where(words > 1, same[hi] - same[np.minimum(lo + 1, hi)], 0) / m
    line_of = np.repeat(np.arange(len(owner)), words)
    distinct = np.bincount(_distinct_lines(line_of, word), minlength=len(owner))
    long_word = (word_end - word_start).astype(np.float64)
    long_total = np.concatenate([[0.0], np.cumsum(long_word)])
    prefix = prefix_hash(data)
    key = mix(range_hash(prefix, start, end) + size.astype(np.uint64)) ^ mix(owner.astype(np.uint64) + np.uint64(1))
    _, back, copies = np.unique(key, return_inverse=True, return_counts=True)
    final = np.where(size > 0, data[np.minimum(np.maximum(end - 1, 0), max(len(data) - 1, 0))] if len(data) else 0, 0)
    ends_well = np.isin(final, np.frombuffer(b'.!?"', np.uint8)).astype(float)
    features = np.stack([*share, repeated, distinct / m, (long_total[hi] - long_total[lo]) / m, np.log1p(size), np.log1p(words), np.log(copies[back]), ends_well], 1)
    return features.astype(np.float32), at, size


def _distinct_lines(line_of: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The line of every (line, word) pair, each pair once."""
    _, first = np.unique(mix(line_of.astype(np.uint64) + np.uint64(1)) ^ word, return_index=True)
    return line_of[first]


class LineCrf:
    """Weights of the chain: ``emit`` by position (own, before, after), feature and bin; ``turn`` for keeping the label, by label; ``bias``."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges
        self.emit = np.zeros((3, len(edges), BINS + 1))
        self.turn = np.zeros(2)
        self.bias = 0.0

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, features[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def emissions(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log odds of "good" of each line before its neighbours' labels are known; beyond a text's ends counts as the bin BINS."""
        f = np.arange(bins.shape[1])
        before, after = neighbours(bins, at)
        return self.bias + self.emit[0][f, bins].sum(1) + self.emit[1][f, before].sum(1) + self.emit[2][f, after].sum(1)

    def marginals(self, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good) of each line, P(both good) and P(both bad) of each line and the one before it)."""
        forward = _messages(s, at, self.turn)
        backward = _messages(s[::-1], len(s) - at[::-1], self.turn)[::-1].copy()
        backward[:, 1] -= s  # a line's own evidence is in the forward message
        both = forward + backward
        z = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - z)
        later = np.ones(len(s), bool)
        later[at[:-1]] = False
        i = np.flatnonzero(later)
        p11, p00 = np.zeros(len(s)), np.zeros(len(s))
        p11[i] = np.exp(forward[i - 1, 1] + self.turn[1] + s[i] + backward[i, 1] - z[i])
        p00[i] = np.exp(forward[i - 1, 0] + self.turn[0] + backward[i, 0] - z[i])
        return good, p11, p00

    def fit(self, bins: np.ndarray, at: np.ndarray, label: np.ndarray) -> LineCrf:
        """``label`` is of each line. Each document weighs 1, whatever its number of lines."""
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        w = 1.0 / np.diff(at)[owner]
        later = np.ones(len(label), bool)
        later[at[:-1]] = False
        around = (bins, *neighbours(bins, at))
        flat = [x + np.arange(bins.shape[1]) * (BINS + 1) for x in around]
        stay1 = later & (label == 1)
        theta = [self.emit, self.turn, np.array([self.bias])]
        m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
        docs = len(at) - 1
        for step in range(1, STEPS + 1):
            self.bias = float(theta[2][0])
            good, p11, p00 = self.marginals(self.emissions(bins, at), at)
            error = (label - good) * w / docs
            g_emit = np.stack([np.bincount(x.ravel(), np.repeat(error, bins.shape[1]), bins.shape[1] * (BINS + 1)).reshape(bins.shape[1], BINS + 1) for x in flat])
            g_turn = np.array([((later & (label == 0)) - p00) @ w, (stay1 - p11) @ w]) / docs
            for k, g in enumerate((g_emit, g_turn, np.array([error.sum()]))):
                g = g - PENALTY * theta[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                theta[k] += RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        self.bias = float(theta[2][0])
        return self

    def scores(self, features: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        good, _, _ = self.marginals(self.emissions(self.bins(features), at), at)
        weight = np.where(np.repeat(np.add.reduceat(size, at[:-1]) == 0, np.diff(at)), 1, size) if len(size) else size
        return np.add.reduceat(good * weight, at[:-1]) / np.add.reduceat(weight, at[:-1])


def _messages(s: np.ndarray, at: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Log sums over the labels of all lines before, for each line and its label, its own evidence ``s`` (of "good") included.

    Texts of up to ``STRETCH`` lines go forward together, a line of each at a time. Longer texts are cut into stretches: every stretch is
    summed under both labels of the line before it, all stretches together; then the sums pass from stretch to stretch.
    """
    size = np.diff(at)
    pieces = -(-size // STRETCH)
    text = np.repeat(np.arange(len(size)), pieces)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = at[:-1][text] + inner * STRETCH
    length = np.minimum(size[text] - inner * STRETCH, STRETCH)
    m = np.zeros((2, len(s), 2))
    order = np.argsort(-length, kind="stable")
    for k in range(2):  # the label of the line before; a text's first line has none, so is summed once
        some = order if k == 0 else order[inner[order] > 0]
        begins, sizes, later = first[some], length[some], inner[some] > 0
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(steps), "left")  # stretches longer than t
        for t in range(steps):
            i = begins[: active[t]] + t
            if t:
                p = m[k, i - 1]
                m[k, i, 0] = np.logaddexp(p[:, 0] + turn[0], p[:, 1])
                m[k, i, 1] = np.logaddexp(p[:, 0], p[:, 1] + turn[1])
            else:
                m[k, i, k] = np.where(later, turn[k], 0.0)
            m[k, i, 1] += s[i]
    out = m[0].copy()
    for j in np.flatnonzero(inner > 0):  # few: a stretch is long
        before = out[first[j] - 1]
        here = slice(first[j], first[j] + length[j])
        out[here] = np.logaddexp(before[0] + m[0, here], before[1] + m[1, here])
    return out


def neighbours(bins: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.full_like(bins, BINS), np.full_like(bins, BINS)
    before[1:], after[:-1] = bins[:-1], bins[1:]
    before[at[:-1]] = BINS
    after[at[1:] - 1] = BINS
    return before, after


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> LineCrf | None:
    """Fit on the labelled documents for which ``learn_from`` holds (an expression over the id column)."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if learn_from is not None:
        usable = usable.filter(learn_from)
    few = usable.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("_label_id"), "_label_id", "_label").limit(sample_docs)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), F.col("_id") == F.col("_label_id")).select("_id", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column(2)):
                x, at, _ = line_features(data, offsets)
                blobs = [x[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["_id", "_label", "x"])

    kind = base.schema["_id"].dataType.simpleString()
    found = materialise(base.mapInArrow(run, f"_id {kind}, _label int, x binary"), "line-features")
    by = Window.orderBy(F.col("n") > sample_lines // LONG_SHARE, F.xxhash64("_id"), "_id", "_label", "h")  # at most two rows a sampled document
    sizes = found.select("_id", "_label", F.xxhash64("x").alias("h"), (F.octet_length("x") / (4 * N_FEATURES)).alias("n")).withColumns({"r": F.row_number().over(by), "s": F.sum("n").over(by)})
    taken = sizes.filter((F.col("s") <= sample_lines) | (F.col("r") == 1)).select("_id", "_label", "h").distinct()
    rows = found.withColumn("h", F.xxhash64("x")).join(taken, ["_id", "_label", "h"], "left_semi").drop("h").toPandas()
    if rows["_label"].nunique() < 2:
        return None
    rows = rows.assign(x=[bytes(v) for v in rows["x"]]).sort_values(["_id", "_label", "x"])
    parts = [np.frombuffer(v, np.float32).reshape(-1, N_FEATURES) for v in rows["x"]]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    x = np.concatenate(parts)
    edges = np.stack([_edges(x[:, f]) for f in range(N_FEATURES)])
    crf = LineCrf(edges)
    return crf.fit(crf.bins(x), at, np.repeat(rows["_label"].to_numpy(), np.diff(at)))


def _edges(x: np.ndarray) -> np.ndarray:
    """BINS - 1 cuts: a line's values are very uneven, so the cuts are quantiles of the distinct values."""
    return np.quantile(np.unique(x), np.linspace(0, 1, BINS + 1)[1:-1])


def score(docs: DataFrame, crf: LineCrf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, n_lines."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    model = docs.sparkSession.sparkContext.broadcast(crf)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column(1)):
                x, at, size = line_features(data, offsets)
                p = np.full(hi - lo, 0.5) if model.value is None else model.value.scores(x, at, size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.clip(p, 0.0, 1.0)), pa.array(np.diff(at))], ["_id", "score", "n_lines"])

    kind = base.schema["_id"].dataType.simpleString()
    return base.mapInArrow(run, f"_id {kind}, score double, n_lines long").withColumnRenamed("_id", id_col)


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, **columns) -> DataFrame:
    """Fit and score: id, score, n_lines, predicted."""
    crf = train(docs, labels, learn_from, **columns)
    columns = {k: v for k, v in columns.items() if k in ("id_col", "text_col")}
    return score(docs, crf, **columns).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
