"""Shared helpers: tables in the cluster's shared folder, and byte arrays over Arrow text columns.

The array helpers look at one bounded slice of an Arrow batch at a time, so that a task's memory
follows the longest single text and not the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.scratch import materialise, shared_dir  # noqa: F401

SLICE_BYTES = 1 << 20
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE_CLASS = r"[\x20\x09-\x0D]"

_BASE = 0x9E3779B97F4A7C15 | 1
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def lookup_table(word: str, lower: bool = True) -> np.ndarray:
    """256 entries: 0 for bytes outside words, else the (lower-cased) byte.

    ``word`` is "nonspace" (all but space and 0x09-0x0D) or "alnum" (0-9, a-z and bytes from 0x80).
    """
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[ord("A") : ord("Z") + 1] += 32
    if word == "nonspace":
        table[list(SPACE_BYTES)] = 0
        # NUL is a word byte here; 0xFF never occurs in UTF-8 and stands for it
        table[0] = 0xFF
    else:
        keep = np.zeros(256, bool)
        keep[ord("0") : ord("9") + 1] = keep[ord("a") : ord("z") + 1] = keep[ord("A") : ord("Z") + 1] = keep[0x80:] = True
        table[~keep] = 0
    return table


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices of about ``limit`` bytes; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def kept_rows(docs: DataFrame, keep: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray]]], *extra: Column) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``keep`` marks in the pass that sees them; ``extra`` columns are for it alone.

    ``keep`` yields slices of the batches with a mask for each. No row moves and none needs a name.
    """
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, mask in keep(batches):
            yield rows.select(list(range(n))).filter(pa.array(mask))

    return docs.select("*", *(c.alias(f"_extra_{uuid.uuid4().hex}") for c in extra)).mapInArrow(run, docs.schema)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows, written once with a number of their own, by which later steps name a row whatever its id."""
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def text_digest(text: Column) -> Column:
    """SHA-256 of a text; null for a null."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """H[i] = sum of b[k] * BASE**k over k < i, modulo 2**64; H has one entry more than b."""
    out = np.zeros(len(b) + 1, np.uint64)
    if len(b):
        np.cumsum(b * powers(len(b))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of [start, end), the same for equal bytes wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def word_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words [start, end): the sum of a mixed number for each (place in the word, byte).

    Seeds give independent families. Unlike a polynomial modulo 2**64, no pattern of bytes cancels out.
    """
    out = np.zeros(len(start), np.uint64)
    size = end - start
    for lo in range(0, len(start), 1 << 17):  # some 1 MB of bytes at a time
        n = size[lo : lo + (1 << 17)]
        bound = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(bound, n)
        byte = b[np.repeat(start[lo : lo + len(n)], n) + place]
        value = mix(((place.astype(np.uint64) << np.uint64(8)) | byte) * _SPREAD + np.uint64(seed))
        out[lo : lo + len(n)] = mix(np.add.reduceat(value, bound) + n.astype(np.uint64))
    return out


def same_words(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pairs of words of ``size`` bytes are equal, byte by byte."""
    out = np.ones(len(size), bool)
    for lo in range(0, len(size), 1 << 17):
        n = size[lo : lo + (1 << 17)]
        bound = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(bound, n)
        differ = a[np.repeat(a_start[lo : lo + len(n)], n) + place] != b[np.repeat(b_start[lo : lo + len(n)], n) + place]
        if differ.any():
            out[lo : lo + len(n)] = ~np.logical_or.reduceat(differ, bound)
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit word hashes, byte starts, byte ends, word offsets of the texts); words never cross texts."""
    b = table[data]
    inside = b != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(b))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return word_hashes(b, start, end, seed), start, end, np.searchsorted(start, offsets)
