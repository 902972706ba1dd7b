"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds its distinct shingles of ``WORDS`` consecutive words. Documents with
``100 * intersection >= threshold * union`` are linked, and the components of the links are the groups.

1. The rows are written once under a number of their own, so that every later step names a row by it. One pass makes of
   every text its number of shingles, a digest of its set and a MinHash signature. Documents with equal sets
   are one class from there on, under the number of its least row: copies are never paired.
2. Banding: classes that agree on all rows of a band share a bucket. With 40 bands of 4 rows a pair at similarity
   0.75 meets in no bucket once in four million times.
3. Stars: every bucket proposes pairs of its members with one centre, so as many pairs as members. Later
   rounds take other centres, a different one in every bucket, and look only at buckets that still hold different components; the last round
   proposes every pair of one bucket that is in different components and was never compared, so no
   candidate is lost; a large bucket is dealt to several tasks. Sizes and parity bitmaps that prove too large a difference rule
   pairs out within the join. Pairs within a component prove nothing and are never looked at.
4. Sequential verification: a pair's signatures are compared ``BATCH`` values at a time, one byte each, and the
   pair leaves as soon as the posterior probability of a similarity at the threshold or above, under a uniform prior,
   is below ``MISS``.
5. Survivors are verified on the full shingle sets, and the next round looks only at what their components leave apart. A centre's text is sent once for
   ``PARTNERS`` of its partners, which follow it in a sorted stream. Shingles are equal if two independent 64-bit families of hashes
   agree, of words and of sets alike.

Defined cases: a null or empty text, or one of white space, has no shingles and is linked with nothing; fewer than
``WORDS`` words make one shingle of the whole sequence; rows with equal sets are one group whatever their
number; rows that repeat id and text share their verdict in ``near_groups``, and ``drop_near_copies`` leaves exactly one row of a group; other rows of the
same id, or without one, are documents of their own; a null id sorts after every other id, and equal ids by the digest of
their texts; a group is named by its least id, null if all its ids are; extra columns are ignored by ``near_groups`` and kept by ``drop_near_copies``; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import lookup_table, materialise, mix, numbered, text_digest, text_slices, words_of
from cairn.operators.components import connected_components

WORDS = 5
THRESHOLD = 75
BANDS, ROWS = 40, 4
BATCH = 32
MISS = 1e-6
STARS = 2
#: Bits of a parity bitmap.
PARITY = 1024
#: Partners that share one copy of their centre's text.
PARTNERS = 64
#: Members of a bucket that one task of the last round compares with the outsiders.
MEMBERS = 4096
_NONSPACE = lookup_table("nonspace")
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, offsets, hashes of the same shingles in a second, independent family) of the texts."""
    first, _, _, at = words_of(data, offsets, _NONSPACE)
    second = words_of(data, offsets, _NONSPACE, 1)[0]
    size = np.diff(at)
    n = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    bound = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    start = at[:-1][owner] + np.arange(bound[-1]) - bound[:-1][owner]
    length = np.minimum(size, words)[owner]
    families = []
    for w in (first, second):
        h = length.astype(np.uint64)
        for k in range(words if len(w) else 0):
            live = length > k
            h = np.where(live, mix(h * _STEP + w[np.minimum(start + k, len(w) - 1)]), h)
        families.append(h)
    h, other = families
    order = np.lexsort((h, owner))
    h, owner, other = h[order], owner[order], other[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(n)))]), other[new]


def _permutations(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def min_hashes(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n least values of every set that is not empty; zeros for the empty ones."""
    out = np.zeros((len(at) - 1, n), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for i, a in enumerate(_permutations(n)):
            out[full, i] = np.minimum.reduceat(h * a, at[:-1][full])
    return out


def parity_bitmaps(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set, PARITY bits as longs: bit i is the parity of the shingles that hash to i."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.zeros((len(at) - 1, PARITY // 64), np.uint64)
    place = (mix(h) % np.uint64(PARITY)).astype(np.int64)
    np.bitwise_xor.at(out, (owner, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return out.view(np.int64)


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(mins), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    parts = mins[:, : bands * rows].reshape(-1, bands, rows)
    for k in range(rows):
        key = mix(key * _STEP + parts[:, :, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """_row, _id, _sha (digest of the text), n_shingles, set_digest, signature (one byte a value), keys (one a band), parity (a bitmap) of the rows (_row, _id, _text)."""
    base = docs.select("_row", "_id", text_digest(F.col("_text")).alias("_sha"), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column(3)):
                h, at, other = shingle_sets(data, offsets, words)
                mins = min_hashes(h, at, bands * rows)
                digest = [hashlib.sha256(h[at[i] : at[i + 1]].tobytes() + other[at[i] : at[i + 1]].tobytes()).digest() for i in range(hi - lo)]
                signature = [x.tobytes() for x in ((mins >> np.uint64(24)) & np.uint64(0xFF)).astype(np.uint8)]
                keys = band_keys(mins, bands, rows)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (keys, parity_bitmaps(h, at))]
                own = [b.column(k).slice(lo, hi - lo) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at)), pa.array(digest, pa.binary()), pa.array(signature, pa.binary()), *lists], ["_row", "_id", "_sha", "n_shingles", "set_digest", "signature", "keys", "parity"])

    return base.mapInArrow(run, f"_row long, _id {base.schema['_id'].dataType.simpleString()}, _sha binary, n_shingles long, set_digest binary, signature binary, keys array<long>, parity array<long>")


def least_matches(n: int, threshold: int, miss: float) -> int:
    """The fewest equal values of n by which a pair may stay.

    One-byte values agree with probability p = J + (1 - J) / 256. Under a uniform prior the posterior of p
    after m of n is Beta(m + 1, n - m + 1), so P(p >= p0) is the probability of at most m successes of n + 1 at p0.
    """
    p0 = threshold / 100 + (1 - threshold / 100) / 256
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * p0**m * (1 - p0) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def sequential(pairs: DataFrame, classes: DataFrame, threshold: int, values: int, miss: float) -> DataFrame:
    """Pairs (x, c) that neither bitmaps nor a batch of signature values ruled out."""
    bounds = [(n, least_matches(n, threshold, miss)) for n in range(BATCH, values + 1, BATCH)]
    side = lambda name: classes.select(F.col("x").alias(name), F.col("n").alias(f"n_{name}"), F.col("parity").alias(f"p_{name}"), F.col("signature").alias(f"s_{name}"))
    joined = pairs.join(side("x"), "x").join(side("c"), "c").filter(_near("n_x", "p_x", "n_c", "p_c", threshold)).select("x", "c", "s_x", "s_c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grids = [np.frombuffer(b"".join(v.as_buffer().to_pybytes() for v in b.column(k)), np.uint8).reshape(-1, values) for k in (2, 3)]
            live, matches = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for n, least in bounds:
                matches[live] += (grids[0][live, n - BATCH : n] == grids[1][live, n - BATCH : n]).sum(1)
                live = live[matches[live] >= least]
            at = pa.array(live)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["x", "c"])

    return joined.mapInArrow(run, "x long, c long")


def linked(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], threshold: int) -> bool:
    """Do two sets (sorted hashes, hashes of the second family) reach the threshold? Shingles are equal if both their hashes are."""
    a, b = x[0], y[0]
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int((x[1][i] == y[1][j]).sum())
    return both > 0 and 100 * both >= threshold * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (x, c) that are linked on their full sets.

    Rows are sorted so that a centre's text comes before those of its partners; a centre of many partners comes
    once for every ``PARTNERS`` of them, in several tasks.
    """
    hot = materialise(pairs.groupBy("c").agg(F.count("*").alias("n")).filter(F.col("n") > PARTNERS), "hot-centres")  # counts are combined before the shuffle
    deal = F.coalesce(F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / PARTNERS)), F.lit(0).cast("long"))
    dealt = pairs.join(hot, "c", "left").select("x", "c", deal.alias("deal"))
    partners = dealt.join(texts, dealt["x"] == texts["_row"]).select("c", "deal", F.lit(1).alias("partner"), "x", "_text")
    centres = dealt.select("c", "deal").distinct().join(texts, F.col("c") == texts["_row"]).select("c", "deal", F.lit(0).alias("partner"), F.col("c").alias("x"), "_text")
    stream = centres.unionByName(partners).repartition("c", "deal").sortWithinPartitions("c", "deal", "partner", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for b in batches:
            partner = b.column(2).to_numpy()
            found = []
            for lo, hi, data, offsets in text_slices(b.column(4)):
                h, at, other = shingle_sets(data, offsets, words)
                for i in range(hi - lo):
                    own = h[at[i] : at[i + 1]], other[at[i] : at[i + 1]]
                    if not partner[lo + i]:
                        centre = tuple(x.copy() for x in own)
                    elif linked(own, centre, threshold):
                        found.append(lo + i)
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(3).take(at), b.column(0).take(at)], ["x", "c"])

    return stream.mapInArrow(run, "x long, c long").distinct()


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("component", F.col("x"))
    return members.join(labels.withColumnRenamed("id", "x"), "x", "left").withColumn("component", F.coalesce("component", "x"))


def _sizes_near(n: str, m: str, threshold: int) -> Column:
    """False if the sizes of two sets prove that they can't be linked."""
    return 100 * F.least(n, m) >= threshold * F.greatest(n, m)


def _near(n: str, parity: str, m: str, other: str, threshold: int) -> Column:
    """False if sizes or parity bitmaps of two sets (of n and m shingles) prove that they can't be linked.

    A bitmap holds for each bit the parity of the shingles that hash to it, so two sets differ in at least as
    many shingles as their bitmaps in bits.
    """
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(parity)[k].bitwiseXOR(F.col(other)[k])) for k in range(PARITY // 64)))
    return _sizes_near(n, m, threshold) & ((100 + threshold) * differ <= (100 - threshold) * (F.col(n) + F.col(m)))


def _stars(rows: DataFrame, seed: int, threshold: int) -> DataFrame:
    """Pairs of every member of a bucket that holds different components with the bucket's centre."""
    # at first, buckets of the same members have the same centre, so most pairs repeat; later every bucket has a centre of its own
    rank = F.col("x") if seed == 0 else F.xxhash64(F.lit(seed), F.col("key"), F.col("x"))
    centre = rows.groupBy("key").agg(F.min(F.struct(rank.alias("r"), F.col("x").alias("c"), F.col("component").alias("cc"), F.col("n").alias("m"))).alias("best"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    return rows.join(centre.select("key", "best.c", "best.cc", "best.m"), "key").filter((F.col("component") != F.col("cc")) & _sizes_near("n", "m", threshold)).select("x", "c")


def _rest(rows: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Every pair of one bucket that is in different components: members outside its largest component with all others, dealt out by ``MEMBERS`` of the others.

    A pair that shares several buckets is proposed in the one of least key alone; buckets of two members were compared as stars.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("size"), F.count("*").alias("k"), F.max_by("component", F.struct("m", "component")).alias("main"))
    unsettled = sizes.filter("size > 2 AND k > 1").select("key", "main", F.ceil(F.col("size") / MEMBERS).cast("int").alias("deals"))
    live = materialise(rows.join(unsettled, "key").join(classes.select("x", "parity", "keys"), "x"), "unsettled")
    outside = live.filter("component <> main").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("key", "deal", "x", "component", "n", "parity", "keys")
    other = live.select("key", F.pmod(F.xxhash64("x"), F.col("deals")).cast("int").alias("deal"), F.col("x").alias("c"), F.col("component").alias("cc"), F.col("n").alias("m"), F.col("parity").alias("other"), F.col("keys").alias("others"))
    first = F.array_min(F.array_intersect("keys", "others")) == F.col("key")
    return outside.join(other, ["key", "deal"]).filter((F.col("component") != F.col("cc")) & _near("n", "parity", "m", "other", threshold) & first).select("x", "c")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"x": F.greatest("x", "c"), "c": F.least("x", "c")})


def links(rows: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, bands: int = BANDS, band_rows: int = ROWS, miss: float = MISS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Of the written rows (_row, _id, _text): (signature rows, classes by set digest with their least row, components of the linked classes)."""
    if bands * band_rows % BATCH:
        raise ValueError(f"bands * band_rows must be a multiple of {BATCH}")
    signed = materialise(signatures(rows, words, bands, band_rows), "signatures")
    least = F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_sha").alias("s"), F.col("_row").alias("r")))
    some = signed.filter("n_shingles > 0").groupBy("set_digest")
    reps = materialise(some.agg(least.alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")).withColumn("x", F.col("least.r")), "classes")
    keyed = reps.select(F.explode("keys").alias("key"), "x", "n")
    shared = keyed.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("lo <> hi").select("key")
    members = materialise(keyed.join(shared, "key", "left_semi").distinct(), "buckets")
    if members.isEmpty():
        return signed, reps, None
    # written tables have known sizes: Spark broadcasts them below spark.sql.autoBroadcastJoinThreshold and joins by shuffle above
    wanted = materialise(members.select(F.col("x").alias("_row")).distinct(), "candidates")
    texts = materialise(rows.select("_row", "_text").join(wanted, "_row"), "texts")
    classes = materialise(signed.join(wanted, "_row", "left_semi").select(F.col("_row").alias("x"), F.col("n_shingles").alias("n"), "parity", "signature", "keys"), "candidate-classes")
    labels: DataFrame | None = None
    compared: list[DataFrame] = []
    confirmed: list[DataFrame] = []

    for turn in range(STARS + 1):
        open_ = _labelled(members, labels)
        pairs = _ordered(_stars(open_, turn, threshold) if turn < STARS else _rest(open_, classes, threshold)).distinct()
        for old in compared:
            pairs = pairs.join(old, ["x", "c"], "left_anti")
        live = materialise(sequential(pairs, classes, threshold, bands * band_rows, miss), "survivors")
        if live.isEmpty():
            continue
        compared.append(live)
        found = materialise(confirm(live, texts, words, threshold), "links")
        if not found.isEmpty():
            confirmed.append(found)
            labels = materialise(connected_components(reduce(DataFrame.unionByName, confirmed), "x", "c"), "labels")
    return signed, reps, labels


def _judged(rows: DataFrame, **options) -> DataFrame:
    """_row, _id, n_shingles, component_id, kept, first (the one row of its group that stays), set_digest of every written row."""
    signed, reps, labels = links(rows, **options)
    named = reps.select("set_digest", "x", "least")
    head = F.col("least")
    if labels is not None:
        joined = named.join(labels.withColumnRenamed("id", "x"), "x").select("x", "component", "least")
        heads = joined.groupBy("component").agg(F.min("least").alias("head"))
        named = named.join(joined.select("x", "component").join(heads, "component").select("x", "head"), "x", "left")
        head = F.coalesce("head", "least")
    named = named.select("set_digest", head.alias("head"))
    some = F.col("n_shingles") > 0
    out = signed.select("_row", "_id", "_sha", "n_shingles", F.when(some, F.col("set_digest")).alias("set_digest")).join(named, "set_digest", "left")
    same = F.col("_id").eqNullSafe(F.col("head.i")) & F.col("_sha").eqNullSafe(F.col("head.s"))
    return out.select("_row", "_id", "n_shingles", F.when(some, F.col("head.i")).otherwise(F.col("_id")).alias("component_id"), F.when(some, same).otherwise(True).alias("kept"), F.when(some, F.col("_row") == F.col("head.r")).otherwise(True).alias("first"), "set_digest")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, set_digest."""
    rows = numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_row")
    return _judged(rows, **options).select(F.col("_id").alias(id_col), "n_shingles", "component_id", "kept", "set_digest")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group, with all its columns; documents without shingles stay."""
    row = f"_row_{uuid.uuid4().hex}"
    rows = numbered(docs, row)
    judged = _judged(rows.select(F.col(row).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), **options)
    gone = materialise(judged.filter("NOT first").select(F.col("_row").alias(row)), "near-copies")
    return rows.join(gone, row, "left_anti").drop(row)
