"""Language ID by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts, up to ``ORDER`` bytes deep, with the counts of
the bytes seen after each context. A byte is coded in the longest context that the tree holds; a byte
not seen there costs an escape (method C: distinct symbols / (count + distinct symbols)) and is coded in
the next shorter context, where the symbols of the longer one are excluded. Below the empty context lies
a uniform choice among the bytes left. With frozen counts the cost of a byte depends on its ``ORDER``
predecessors alone, so the exact code length of a text is a sum over its (ORDER + 1)-grams. The costs of
all grams of the trees are tabulated once per worker; grams of no tree are evaluated by the same code.

The trees are learned from a bounded sample: at most ``SAMPLE_DOCS`` different texts and ``SAMPLE_BYTES`` bytes a language, those
with the least hash (and one text at least); a text of more than a ``LONG_SHARE``-th of the bytes comes after all others, so that one long text does not crowd them out. Counting runs on the executors; the driver receives the summed counts of the sample.

Normalisation before counting and coding: Latin-1 letters are lower-cased, every run of ASCII bytes that
are no letters becomes one space. ``score`` is the posterior of the winner under equal priors, with
the evidence scaled to at most ``EVIDENCE`` bytes, so that a long text does not always score 1.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text when
nothing could be learned; equal code lengths go to the first language by name; rows repeat their
verdict; rows with a null label are not learned from; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import kept_rows, text_slices

ORDER = 4
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 32 << 20
LONG_SHARE = 64
EVIDENCE = 64
UNDETERMINED = "und"
_SLOT_BITS = 21
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PAD = 0


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[0x80:] = np.arange(0x80, 256)
    for c in range(ord("a"), ord("z") + 1):
        table[c] = table[c - 32] = c
    return table


_LETTERS = _letters()


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, each after ORDER pad bytes, and the offsets of the texts (pads included)."""
    b = _LETTERS[data]
    after = np.zeros(len(b), bool)
    after[1:] = data[:-1] == 0xC3
    upper = after & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
    b = np.where(upper, b + 0x20, b).astype(np.uint8)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[starts] = True
    sizes = np.add.reduceat(np.append(keep, 0).astype(np.int64), offsets[:-1]) if len(offsets) > 1 else np.zeros(0, np.int64)
    sizes[offsets[:-1] == offsets[1:]] = 0
    ends = np.cumsum(sizes + ORDER)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    body = np.ones(len(out), bool)
    begins = ends - sizes - ORDER
    for k in range(ORDER):
        body[begins + k] = False
    out[body] = b[keep]
    return out, np.concatenate([[0], ends]).astype(np.int64)


def grams(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte that is no pad, as one number, and the gram offsets of the texts."""
    code = np.zeros(max(0, len(b) - ORDER), np.uint64)
    for k in range(ORDER + 1):
        code = (code << np.uint64(8)) | b[k : len(b) - ORDER + k]
    pads = np.arange(1, len(offsets) - 1)
    real = np.ones(len(code), bool)
    if len(pads):
        for k in range(ORDER):
            real[offsets[1:-1] - ORDER + k] = False
    return code[real], offsets - ORDER * np.arange(len(offsets))


class Trees:
    """The context trees of all languages, and the cost in bits of any gram in each."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.levels = [self._levels(*counts[lang]) for lang in self.langs]
        every = np.unique(np.concatenate([counts[lang][0] for lang in self.langs]))
        weight = np.zeros(len(every))
        for lang in self.langs:
            weight[np.searchsorted(every, counts[lang][0])] += counts[lang][1]
        every = every[np.argsort(weight, kind="stable")]  # a slot goes to the most frequent of its grams
        self.keys = np.full(1 << _SLOT_BITS, np.iinfo(np.uint64).max, np.uint64)
        self.rows = np.zeros(1 << _SLOT_BITS, np.int32)
        slot = self._slot(every)
        self.keys[slot], self.rows[slot] = every, np.arange(len(every), dtype=np.int32)
        self.costs = self.evaluate(every)

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * _GOLD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    @staticmethod
    def _levels(code: np.ndarray, n: np.ndarray) -> list[dict[str, np.ndarray]]:
        """By order k: sorted grams of k + 1 bytes with counts; sorted contexts with total, distinct and, of what a longer context excludes, the total here."""
        levels = []
        for k in range(ORDER + 1):
            g, inverse = np.unique(code & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(inverse, n).astype(np.int64)
            context, at = np.unique(g >> np.uint64(8), return_inverse=True)
            levels.append({"gram": g, "count": count, "context": context, "total": np.bincount(at, count).astype(np.int64), "distinct": np.bincount(at)})
        for k in range(1, ORDER + 1):
            shorter, level = levels[k - 1], levels[k]
            here = shorter["count"][np.searchsorted(shorter["gram"], level["gram"] & np.uint64((1 << 8 * k) - 1))]
            level["excluded"] = np.bincount(np.searchsorted(level["context"], level["gram"] >> np.uint64(8)), here).astype(np.int64)
        return levels

    def evaluate(self, code: np.ndarray) -> np.ndarray:
        return np.stack([self._bits(code, levels) for levels in self.levels], 1).astype(np.float32) if len(code) else np.zeros((0, len(self.langs)), np.float32)

    @staticmethod
    def _bits(code: np.ndarray, levels: list[dict[str, np.ndarray]]) -> np.ndarray:
        bits = np.zeros(len(code))
        open_ = np.ones(len(code), bool)
        gone = np.zeros(len(code), np.int64)  # symbols excluded so far
        lost = np.zeros(len(code), np.int64)  # and their total in the context at hand
        for k in range(ORDER, -1, -1):
            level = levels[k]
            gram = code & np.uint64((1 << 8 * (k + 1)) - 1)
            context = gram >> np.uint64(8)
            c = np.minimum(np.searchsorted(level["context"], context), len(level["context"]) - 1)
            known = open_ & (level["context"][c] == context)
            total, distinct = level["total"][c] - lost, level["distinct"][c] - gone
            live = known & (distinct > 0)
            g = np.minimum(np.searchsorted(level["gram"], gram), len(level["gram"]) - 1)
            seen = live & (level["gram"][g] == gram)
            whole = np.maximum(total + distinct, 1)
            bits[seen] -= np.log2(level["count"][g][seen] / whole[seen])
            escaped = live & ~seen
            bits[escaped] -= np.log2(distinct[escaped] / whole[escaped])
            open_ &= ~seen
            gone = np.where(known, level["distinct"][c], gone)
            if k:
                lost = np.where(known, level["excluded"][c], 0)
        bits[open_] += np.log2(np.maximum(256 - gone[open_], 1))
        return bits

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each text under each language, its normalised bytes)."""
        code, at = grams(*normalise(data, offsets))
        size = np.diff(at)
        if not len(code):
            return np.zeros((len(size), len(self.langs))), size
        slot = self._slot(code)
        row = self.rows[slot]
        missed = np.flatnonzero(self.keys[slot] != code)
        row[missed] = 0
        cost = self.costs[row]
        if len(missed):
            rare, inverse = np.unique(code[missed], return_inverse=True)
            cost[missed] = self.evaluate(rare)[inverse]
        out = np.zeros((len(size), len(self.langs)))
        full = size > 0
        out[full] = np.add.reduceat(cost, at[:-1][full], axis=0, dtype=np.float64)
        return out, size


def verdicts(bits: np.ndarray, size: np.ndarray, langs: list[str]) -> tuple[list[str | None], np.ndarray]:
    best = bits.argmin(1)
    scale = np.minimum(size, EVIDENCE) / np.maximum(size, 1)
    behind = (bits - bits.min(1, keepdims=True)) * scale[:, None]
    return [langs[i] for i in best], 1 / np.exp2(-np.minimum(behind, 1000)).sum(1)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Gram counts by language, from at most ``sample_docs`` different texts each."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").withColumn("h", F.xxhash64("text"))
    # a threshold on the hash leaves about twice the sample before any sort; copies share a hash, so different hashes are counted
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return {}
    limit: Column = F.lit(None).cast("double")
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, min(1.0, 2 * sample_docs / n)).otherwise(limit)
    near = rows.filter((F.col("h").cast("double") / float(2**64) + 0.5) <= limit).dropDuplicates(["lang", "h"])
    size = near.select("lang", "h", F.octet_length("text").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.col("n") > sample_bytes // LONG_SHARE, "h")  # about twice the sample; overlong texts only after all others
    taken = size.withColumns({"r": F.row_number().over(by), "s": F.sum("n").over(by)}).filter((F.col("r") <= sample_docs) & ((F.col("s") <= sample_bytes) | (F.col("r") == 1)))
    sample = near.join(F.broadcast(taken.select("lang", "h")), ["lang", "h"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lo, hi, data, offsets in text_slices(b.column(1)):
                code, at = grams(*normalise(data, offsets))
                owner = np.repeat(langs[lo:hi], np.diff(at))
                for lang in sorted(set(langs[lo:hi])):
                    g, n = np.unique(code[owner == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    total = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return {lang: (x["gram"].to_numpy(np.uint64), x["n"].to_numpy(np.int64)) for lang, x in total.sort_values(["lang", "gram"]).groupby("lang")}


_worker_trees: dict[str, Trees] = {}


def _trees(key: str, model) -> Trees:
    """The trees of a broadcast model, built once per worker."""
    if key not in _worker_trees:
        _worker_trees.clear()
        _worker_trees[key] = Trees(model.value)
    return _worker_trees[key]


def _has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def _verdicts(text: pa.Array, letter: pa.Array, trees: Trees) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """(first row, end row, languages, scores, bits per byte) of slices of a batch."""
    ok = letter.to_numpy(zero_copy_only=False).astype(bool)
    for lo, hi, data, offsets in text_slices(text, 1 << 19):
        bits, size = trees.code_lengths(data, offsets)
        lang, p = verdicts(bits, size, trees.langs)
        yield lo, hi, [x if k else UNDETERMINED for x, k in zip(lang, ok[lo:hi])], np.where(ok[lo:hi], p, 0.0), bits.min(1) / np.maximum(size, 1)


def predict(docs: DataFrame, counts: dict[str, tuple[np.ndarray, np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, bits_per_byte under the winner."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _has_letter(text_col).alias("_letter"))
    schema = f"_id {base.schema['_id'].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double"
    if not counts:
        return base.select(F.col("_id").alias(id_col), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    model, key = docs.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(key, model)
        for b in batches:
            for lo, hi, lang, p, bits in _verdicts(b.column(1), b.column(2), trees):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(p), pa.array(bits)], ["_id", "lang_pred", "score", "bits_per_byte"])

    return base.mapInArrow(score, schema).withColumnRenamed("_id", id_col)


def known_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows whose language is determined, with all their columns. Every row is judged by its own text, in the pass that reads it."""
    counts = learn(docs, text_col, lang_col, sample_docs)
    if not counts:
        return docs.filter(F.lit(False))
    model, key, text_at, n = docs.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex, docs.columns.index(text_col), len(docs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        trees = _trees(key, model)
        for b in batches:
            for lo, hi, lang, _, _ in _verdicts(b.column(text_at), b.column(n), trees):
                yield b.slice(lo, hi - lo), np.array([x != UNDETERMINED for x in lang], bool)

    return kept_rows(docs, keep, _has_letter(text_col))


def identify(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the labelled rows that are not held out, and predict every row."""
    labelled = docs if held_out is None else docs.filter(~held_out)
    return predict(docs, learn(labelled, text_col, lang_col, sample_docs), id_col, text_col)
