"""Document fingerprints by order MinHash: sketches that follow the edit distance of texts, not only their sets of k-mers.

A text's k-mers (``K`` code points) are numbered by their occurrence from the left, so that repeats count. For each of ``SIZE`` hash functions the
``LENGTH`` numbered k-mers of least hash are selected and put back in the order in which they stand in the text; the hash of that tuple of
k-mers is one component of the fingerprint. Two fingerprints are alike in as many components as select the same k-mers in the same order: moving a
passage changes the order and so the likeness, which a plain MinHash would not see.

Selecting takes no sort of the text: a hash of at most a bound that some 6 * (``LENGTH`` + 1) k-mers pass is a candidate, and only candidates are ordered; too few of them, and all are.

``fingerprints`` is one pass without a shuffle. ``with_next`` compares every document with the next one in order of the ids and with a text edited from
the two: documents are cut into ranges of ids and each range is sorted in its task. The ranges' first keys, one a range, are found from ids and
hashes alone; the document that begins a range is sent to the range before as well, so no task waits for another, and texts are shuffled once.

Defined cases: a null text is empty and has a null-free fingerprint of empty tuples, like only to that of other empty texts; a text shorter than a k-mer is
one k-mer, and with fewer k-mers than ``LENGTH`` the tuples are shorter; equal texts have equal fingerprints. In ``with_next`` a null id comes after all others, rows
that repeat an id are in order of their texts' hash, a lone document is its own next one. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import mix

K, LENGTH, SIZE, SEED = 8, 2, 64, 42
#: Bytes of text of a range of documents, about.
RANGE_BYTES = 128 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 2048
_ROWS = 256


class Sketcher:
    """Fingerprints of texts; a fingerprint is an array of ``size`` 32-bit numbers."""

    def __init__(self, k: int = K, length: int = LENGTH, size: int = SIZE, seed: int = SEED):
        self.k, self.length, self.size = k, length, size
        draws = mix(np.arange(1, size + 1, dtype=np.uint64) * _BASE + np.uint64(seed))
        self.factor = ((draws >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)
        self.shift = draws.astype(np.uint32)
        self.space, self.mask = np.zeros(size * _BLOCK, np.uint32), np.zeros(size * _BLOCK, bool)

    def kmers(self, text: str) -> np.ndarray:
        """64-bit hashes of the k-mers, from the left."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        k = min(self.k, len(points))
        if not k:
            return np.zeros(0, np.uint64)
        code = np.full(len(points) - k + 1, k, np.uint64)
        for j in range(k):
            code = code * _BASE + points[j : len(points) - k + 1 + j]
        return mix(code)

    @staticmethod
    def occurrences(kmers: np.ndarray) -> np.ndarray:
        """How many equal k-mers stand to the left of each. Places share a number with the hash, so long texts compare fewer of its bits (44 for a million k-mers)."""
        n = len(kmers)
        bits = np.uint64(n.bit_length())
        place = np.arange(n, dtype=np.uint64)
        keys = np.sort(kmers >> bits << bits | place)
        group = keys >> bits
        first = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
        out = np.zeros(n, np.uint64)
        out[(keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = place - np.maximum.accumulate(np.where(first, place, np.uint64(0)))
        return out

    def numbered(self, kmers: np.ndarray, start: int = 0) -> np.ndarray:
        """64-bit hashes of the k-mers with their occurrence numbers, from the k-mer ``start`` on."""
        return mix(kmers[start:] + (self.occurrences(kmers)[start:] + np.uint64(1)) * _BASE)

    def _candidates(self, x: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash function and hash as one number, place) of the hashes of at most ``bound``."""
        low = np.zeros(-(-len(x) // 8) * 8, np.uint32)
        low[: len(x)] = x >> np.uint64(32)
        keys, places = [], []
        for at in range(0, len(low), _BLOCK):
            part = low[at : at + _BLOCK]
            n = len(part)
            hashes = np.bitwise_xor(part, self.shift[:, None], out=self.space[: self.size * n].reshape(self.size, n))
            hashes *= self.factor[:, None]
            below = np.less_equal(hashes, np.uint32(bound), out=self.mask[: self.size * n].reshape(self.size, n)).ravel()
            eights = np.flatnonzero(below.view(np.uint64))  # eight hashes at a look
            hit = (eights[:, None] * 8 + np.arange(8))[below.reshape(-1, 8)[eights]]
            place = hit % n + at
            hit, place = hit[place < len(x)], place[place < len(x)]
            keys.append((hit // n).astype(np.uint64) << np.uint64(32) | hashes.ravel()[hit])
            places.append(place)
        return (np.concatenate(keys), np.concatenate(places)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def _select(self, keys: np.ndarray, places: np.ndarray, x: np.ndarray, kmers: np.ndarray, n: int) -> np.ndarray | None:
        """The fingerprint from candidates of a text of ``n`` k-mers, or None if they are too few. ``places`` count in the text, ``x`` and ``kmers`` belong to the candidates."""
        order = np.argsort(keys)
        if (keys[order[1:]] == keys[order[:-1]]).any():
            order = np.lexsort((x, keys))
        own = keys[order] >> np.uint64(32)
        start = np.searchsorted(own, np.arange(self.size + 1, dtype=np.uint64))
        take = min(self.length, n)
        if take and (np.diff(start) < take).any():
            return None
        out = np.zeros(self.size, np.uint64)
        if take:
            chosen = order[start[:-1, None] + np.arange(take)]
            chosen = np.take_along_axis(chosen, np.argsort(places[chosen], axis=1), axis=1)
            for i in range(take):
                out = mix(out * _BASE + kmers[chosen[:, i]])
        return (out >> np.uint64(32)).astype(np.uint32)

    def pair(self, text: str, keep: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of a text and of its first ``keep`` code points followed by ``tail``; what they share is hashed once."""
        a = self.kmers(text)
        shared = max(0, keep - self.k + 1)  # k-mers that stand in both
        b = np.concatenate([a[:shared], self.kmers(text[shared:keep] + tail)]) if len(text[shared:keep]) + len(tail) >= self.k or not shared else a[:shared]
        x, kmers = np.concatenate([self.numbered(a), self.numbered(b, shared)]), np.concatenate([a, b[shared:]])
        least = max(1, min(len(a) or len(b), len(b) or len(a)))
        for bound in (min((1 << 32) - 1, (6 * (self.length + 1) << 32) // least), (1 << 32) - 1):
            keys, places = self._candidates(x, bound)
            new = places >= len(a)
            old = ~new
            both = new | (places < shared)
            here = np.where(new, places - len(a) + shared, places)
            one = self._select(keys[old], places[old], x[places[old]], kmers[places[old]], len(a))
            two = self._select(keys[both], here[both], x[places[both]], kmers[places[both]], len(b))
            if one is not None and two is not None:
                break
        return one, two

    def of(self, text: str) -> np.ndarray:
        """The fingerprint of a text."""
        return self.pair(text, len(text), "")[0]


def as_hex(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: Column, b: Column) -> Column:
    """The share of components in which two fingerprints, in hex, are equal."""
    parts = lambda c: F.regexp_extract_all(c, F.lit(".{8}"), 0)
    same = F.filter(F.zip_with(parts(a), parts(b), lambda x, y: x == y), lambda x: x)
    return F.size(same) / (F.length(a) / 8)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, length: int = LENGTH, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """One row per document: id, n_chars, fingerprint (8 hex digits a component)."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sketcher = Sketcher(k, length, size, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                texts = [t.as_py() or "" for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([as_hex(sketcher.of(t)) for t in texts], pa.string())], ["_id", "n_chars", "fingerprint"])

    kind = base.schema["_id"].dataType.simpleString()
    return base.mapInArrow(run, f"_id {kind}, n_chars long, fingerprint string").withColumnRenamed("_id", id_col)


def ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows (_id, _text) with _none, _hash, _range and _guest, dealt into ranges of ids of about ``range_bytes``, sorted. The first row of a range is in the range before as well, as its guest, at the end; that of the first is the last one's."""
    keys = ["_none", "_id", "_hash"]
    rows = docs.withColumns({"_none": F.col("_id").isNull(), "_hash": F.xxhash64("_text")})
    size = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    firsts = rows.select(*keys).repartitionByRange(n, *keys).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*keys)).alias("f"))
    bounds = sorted((tuple(r["f"]) for r in firsts.collect()), key=lambda k: (k[0], k[1:] if not k[0] else k[2]))  # a key a range

    @F.arrow_udf("long")
    def place(none: pa.Array, id_: pa.Array, hash_: pa.Array) -> pa.Array:
        out = []
        for key in zip(none.to_pylist(), id_.to_pylist(), hash_.to_pylist()):
            at = max(0, bisect_right(bounds, key) - 1)
            out.append(2 * at + (bounds[at] == key))
        return pa.array(out, pa.int64())

    p = max(1, len(bounds))
    at = F.shiftright("_place", 1).cast("int")
    homes = F.when(F.col("_place") % 2 == 1, F.array(at, F.pmod(at - 1, F.lit(p)))).otherwise(F.array(at))
    dealt = rows.withColumn("_place", place(*keys)).select("*", F.posexplode(homes).alias("_guest", "_range")).drop("_place")
    return dealt.repartitionById(p, "_range").sortWithinPartitions("_guest", *keys)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4, k: int = K, length: int = LENGTH, size: int = SIZE, seed: int = SEED, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its last n_chars // ``share`` code points replaced by as many from the start of the next document.
    """
    dealt = ranges(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), range_bytes)
    sketcher = Sketcher(k, length, size, seed)
    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = pa.schema([(n, t) for n, t in zip(names[1:], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, str]]:
        """(id, text) of the range's own rows and of one guest."""
        for b in batches:
            for id_, text, guest in zip(b.column(0), b.column(1), b.column(2)):
                yield id_, text.as_py() or ""
                if guest.as_py():
                    return

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, before = None, None  # a row whose next one is not known, and the row before it, which waits for its fingerprint
        for id_, text in rows_of(batches):
            if held is not None:
                done, before = before, _edited(sketcher, *held, text, share)
                if done is not None:
                    yield (*done[:-1], float((done[-1] == before[-1]).mean()))
            held = (id_, text)
        if before is not None:
            yield (*before[:-1], float((before[-1] == sketcher.of(held[1])).mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in results(batches):
            out.append(row)
            if len(out) == _ROWS:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        ids = pa.array([r[0].as_py() for r in out], out[0][0].type)
        return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema, 1))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = dealt.select("_id", "_text", "_guest").mapInArrow(run, f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("_id", id_col)


def _edited(sketcher: Sketcher, id_: pa.Scalar, text: str, following: str, share: int) -> tuple:
    """The results of a row but its likeness to the next one, for which the fingerprint stands at the end."""
    cut = len(text) // share
    keep, tail = len(text) - cut, following[:cut]
    own, edited = sketcher.pair(text, keep, tail)
    digest = hashlib.sha256((text[:keep] + tail).encode()).hexdigest()
    return id_, len(text), digest, as_hex(own), as_hex(edited), float((own == edited).mean()), own
