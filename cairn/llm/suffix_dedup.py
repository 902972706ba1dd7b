"""Suffix-array dedup: remove every byte covered by a ``window``-byte string that also starts in a smaller document.

Only equal windows must meet, so windows are dealt out by an anchor that their own content picks: the
16-byte string of least hash within the window. Consecutive windows with one anchor form a segment.

1. ``_parts``: the texts are written once, in parts of a task's rows, ``PART_BYTES`` or less where the task holds many texts, bucketed by part, so that
   later steps bring small tables to the texts and never move the texts. There is a bucket for every ``TASK_BYTES`` of text.
2. ``_anchor_blocks``: every part sends its distinct anchor hashes in one packed block per bucket; a
   bucket answers which of them occur in two documents or more, and which are ``hot``.
3. ``_segments``: a part sends the segments of those anchors: equal ones once, with their least document.
   Where they occur stays in the part. The windows of an anchor of ``hot`` segments or more are dealt out one by one, each by its own
   bytes: a hot anchor's segments never meet in one task, and equal windows still do.
4. ``_answers``: a bucket, of some ``ROWS`` segments, takes them by groups of one anchor, some ``CHUNK`` at a time, so that its memory follows neither
   the bucket nor the share of anchors that texts have in common, which grows with the input. It builds two suffix arrays of them, of the suffixes that begin at the
   anchors and of the reversed ones that end there. A mergesort orders them; it compares two suffixes by
   a binary search over prefix polynomial hashes for their common extension, so in logarithmic
   time, and common extensions of neighbours are verified byte by byte. A window that reaches t bytes to the
   left of its anchor is then known by its place in both arrays: equal windows are those whose common
   extensions reach t bytes to the left and the rest to the right. Their least document decides.
5. For each segment a mask of its lost windows returns to its part. The part finds its segments again, in the same order, and
   unites the removed ranges.

Defined cases: a null or short text loses nothing; matches never cross documents; a string repeated within
one document, or in rows that share an id, is no match by itself; a null id counts as greater than all others;
extra columns are ignored by ``find_repeats``; an empty table gives an empty result. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialise, mix, prefix_hash, range_hash, shared_dir, text_slices
from cairn.operators.scratch import table_name

WINDOW = 50
ANCHOR = 16
#: Most that a part says of an anchor's segments, and what it adds if they lie in two documents or more.
MOST, SEVERAL = (1 << 15) - 1, 1 << 15
#: Segments of one anchor, in all documents, from which its windows are dealt out one by one. Below it a group is at most twice a chunk, however often a document
#: repeats its anchor; a lower number would take more rows, since the share of anchors above it grows with the input.
HOT = MOST
#: Anchors in a bucket, about.
BUCKET = 1 << 19
#: Segments in a bucket of the suffix stage, about, and those that it works on at once.
ROWS, CHUNK = 1 << 18, 1 << 14
#: Windows of a segment of a hot anchor, about.
WINDOWS = 17
#: Bytes whose common extensions are verified at once.
VERIFIED = 1 << 18
#: Parts that a task's rows are split into, at least, and bytes of text in a part, about.
SPLIT, PART_BYTES = 8, 4 << 20
#: Bytes of text, about, in one bucket of the table of parts, which is the work of one task in each pass.
TASK_BYTES = 16 << 20
#: Most buckets that Spark allows a table by default; beyond TASK_BYTES times as many a bucket grows, and its parts are still taken one at a time.
MOST_BUCKETS = 100_000
#: Most tasks of the suffix stage; beyond it a task works through several buckets, one after the other.
TASKS = 100_000
_NO_ID = np.iinfo(np.int64).max


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor start, first window, last window) of every segment of the texts, in order."""
    n = len(data) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), empty, empty, empty
    at = np.arange(len(data) - k + 1)
    hashes = mix(range_hash(prefix_hash(data), at, at + k))
    low = np.uint64(0xFFFFFFFF)
    least = (hashes & ~low) | at.astype(np.uint64)  # the place breaks ties: the first of the least
    width, want = 1, window - k + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[:n], least[want - width :][:n])
    place = (least[:n] & low).astype(np.int64)
    valid = np.ones(n, bool)
    for i in range(1, window):
        edge = offsets[1:-1] - i
        valid[edge[(edge >= 0) & (edge < n)]] = False
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    stop = np.ones(n, bool)
    stop[:-1] = change[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    return hashes[place[first]], place[first], first, last


def _extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length, up to ``most``, of the common extension from x and y on: binary search over prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), most.copy()
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live] + 1) // 2
        a, b = x[live], y[live]
        same = range_hash(prefix, a, a + mid) == range_hash(prefix, b, b + mid)
        lo[live[same]] = mid[same]
        hi[live[~same]] = mid[~same] - 1
    return lo


def _before(text: np.ndarray, prefix: np.ndarray, x: np.ndarray, xn: np.ndarray, y: np.ndarray, yn: np.ndarray, strict: np.ndarray) -> np.ndarray:
    """Is suffix x (of xn bytes) below suffix y, or where not ``strict`` equal to it?"""
    most = np.minimum(xn, yn)
    common = _extension(prefix, x, y, most)
    ended = common == most
    end = len(text) - 1
    a, b = text[np.minimum(x + common, end)], text[np.minimum(y + common, end)]
    return np.where(ended, (xn < yn) | (~strict & (xn == yn)), a < b)


def suffix_sort(text: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common extension with the one before it) of the suffixes [start, start + size), group by group.

    A bottom-up mergesort, all runs of all groups at once: an element's place in the merged run is its place
    in its own run and the number of elements below it in the sibling run.
    """
    n = len(start)
    order = np.argsort(group, kind="stable")
    if n < 2:
        return order, np.zeros(n, np.int64)
    prefix = prefix_hash(text)
    g = group[order]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    sizes = np.diff(np.append(begin, n))
    base, total = np.repeat(begin, sizes), np.repeat(sizes, sizes)
    inner = np.arange(n) - base
    width = 1
    while width < sizes.max():
        run = inner // width
        sibling = np.where(run % 2 == 0, run + 1, run - 1)
        lo = np.minimum(sibling * width, total)
        first, hi = lo.copy(), np.minimum((sibling + 1) * width, total)
        left = run % 2 == 0  # equal elements of the left run come first
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            me, other = order[live], order[base[live] + mid]
            below = _before(text, prefix, start[other], size[other], start[me], size[me], left[live])
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
        to = base + (run // 2) * 2 * width + (inner - run * width) + (lo - first)
        merged = np.empty(n, np.int64)
        merged[to] = order
        order = merged
        width *= 2
    x, y = start[order[:-1]], start[order[1:]]
    most = np.minimum(size[order[:-1]], size[order[1:]])
    common = _extension(prefix, x, y, most)
    # verification: equal hashes must be equal bytes
    bound = np.concatenate([[0], np.cumsum(common)])
    lo = 0
    while lo < n - 1:
        hi = max(lo + 1, int(np.searchsorted(bound, bound[lo] + VERIFIED, "right")) - 1)
        long = common[lo:hi]
        inside = np.arange(bound[hi] - bound[lo]) - np.repeat(bound[lo:hi] - bound[lo], long)
        differ = text[np.repeat(x[lo:hi], long) + inside] != text[np.repeat(y[lo:hi], long) + inside]
        if differ.any():
            row = np.repeat(np.arange(lo, hi), long)[differ]
            np.minimum.at(common, row, inside[differ])
        lo = hi
    out = np.concatenate([[0], common])
    out[begin] = 0
    return order, out


def least_documents(text: np.ndarray, at: np.ndarray, anchor: np.ndarray, group: np.ndarray, doc: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the segments [at[i], at[i + 1]) with their anchors' starts: (segments, t, least document) of all windows that reach t bytes left of the anchor."""
    n = len(anchor)
    left, right = anchor - at[:-1], at[1:] - anchor
    order_r, common_r = suffix_sort(text, anchor, right, group)
    order_l, common_l = suffix_sort(text[::-1], len(text) - anchor, left, group)
    g = group[order_r]
    new_group = np.concatenate([[True], g[1:] != g[:-1]]) if n else np.zeros(0, bool)
    out = []
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(int(left.max(initial=-1)) + 1):
        here = np.flatnonzero((left >= t) & (right >= window - t))
        if not len(here):
            continue
        class_r[order_r] = np.cumsum(new_group | (common_r < window - t))
        class_l[order_l] = np.cumsum(new_group | (common_l < t))
        key = class_l[here] * np.int64(n + 1) + class_r[here]
        order = np.argsort(key, kind="stable")
        edge = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        least = np.minimum.reduceat(doc[here][order], np.flatnonzero(edge))
        m = np.empty(len(here), np.int64)
        m[order] = least[np.cumsum(edge) - 1]
        out.append((here, np.full(len(here), t), m))
    return out


def _blocks(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its places in order) of the buckets that occur."""
    order = np.argsort(bucket, kind="stable")
    found, start = np.unique(bucket[order], return_index=True)
    for i, lo, hi in zip(found.tolist(), start, np.append(start[1:], len(order))):
        yield i, order[lo:hi]


def _chunks(group: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The places of whole groups, chunk by chunk: as many groups as have ``most`` members together, or one that has more."""
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.concatenate([group[order][1:] != group[order][:-1], [True]])) + 1
    lo = 0
    while lo < len(order):
        hi = int(edges[max(np.searchsorted(edges, lo + most, "right") - 1, np.searchsorted(edges, lo, "right"))])
        yield order[lo:hi]
        lo = hi


def _sizes(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Bytes of the texts: of all, and of those that one task reads at most."""
    by_task = docs.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.octet_length(text_col)).alias("n"))
    found = by_task.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    return found["total"] or 0, found["most"] or 0


def _text_bytes(docs: DataFrame, text_col: str) -> int:
    return _sizes(docs, text_col)[0]


def _parts(docs: DataFrame, id_col: str, text_col: str, total: int, most: int = 0) -> DataFrame:
    """The texts, of ``total`` bytes and ``most`` in a task, by part, written as a table that is bucketed by part without moving a row between tasks. Parts and buckets follow the bytes, not a setting."""
    spark = docs.sparkSession
    split = max(SPLIT, -(-most // PART_BYTES))
    part = F.spark_partition_id() * split + F.pmod(F.xxhash64("_id"), F.lit(split)).cast("int")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text")).withColumn("_part", part)
    name = table_name("parts")
    n = min(MOST_BUCKETS, max(2, -(-total // TASK_BYTES)))
    writer = rows.write.format("parquet").option("compression", "zstd").bucketBy(n, "_part")
    (writer if "." in name else writer.option("path", f"{shared_dir(spark)}/{name}")).saveAsTable(name)
    return spark.table(name)


def _slices(table: pa.Table, window: int):
    """(document keys, rows' start, data, offsets, anchors) of a part, slice by slice."""
    keys = table.column("_key").to_numpy()
    for lo, hi, data, offsets in text_slices(table.column("_text")):
        yield keys, lo, hi, data, offsets, anchors(data, offsets, window)


def _anchor_blocks(parts: DataFrame, n_buckets: int, window: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        found, docs = [], []
        for keys, lo, _, _, offsets, (a, place, _, _) in _slices(table, window):
            found.append(a)
            docs.append(keys[lo + np.searchsorted(offsets, place, "right") - 1])
        a = np.concatenate(found) if found else np.zeros(0, np.uint64)
        d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        order = np.lexsort((d, a))
        a, d = a[order], d[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        other = new.copy()
        other[1:] |= d[1:] != d[:-1]
        at = np.flatnonzero(new)
        count = np.minimum(np.diff(np.append(at, len(a))), MOST)
        count = (count + SEVERAL * (np.diff(np.append(np.flatnonzero(other).searchsorted(at), other.sum())) > 1)).astype(np.uint16)
        a = a[new]
        rows = [(i, a[k].tobytes(), count[k].tobytes()) for i, k in _blocks((a % np.uint64(n_buckets)).astype(np.int64))]
        part = table.column("_part")[0].as_py()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([part] * len(rows), pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    return parts.groupBy("_part").applyInArrow(run, "bucket int, part int, keys binary, counts binary")


def _shared_anchors(blocks: DataFrame, hot: int) -> DataFrame:
    """(part, keys, hot, rows): the part's anchors that two documents or more hold, and about as many segments as they will make."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k.as_buffer(), np.uint64) for k in table.column("keys")]
        a, back = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([np.frombuffer(k.as_buffer(), np.uint16) for k in table.column("counts")])
        several, counts = counts >= SEVERAL, (counts & MOST).astype(np.int64)
        shared = np.bincount(back, 1 + several, len(a))[back] >= 2
        is_hot = np.bincount(back, counts, len(a))[back] >= hot
        rows = np.where(is_hot, WINDOWS * counts, counts)
        out, at = [], 0
        for part, k in zip(table.column("part").to_pylist(), keys):
            own = slice(at, at + len(k))
            at += len(k)
            if (on := shared[own]).any():
                out.append((part, k[on].tobytes(), is_hot[own][on].tobytes(), int(rows[own][on].sum())))
        return pa.table({"part": pa.array([r[0] for r in out], pa.int32()), "keys": pa.array([r[1] for r in out], pa.binary()), "hot": pa.array([r[2] for r in out], pa.binary()), "rows": pa.array([r[3] for r in out], pa.int64())})

    return blocks.groupBy("bucket").applyInArrow(run, "part int, keys binary, hot binary, rows long")


class _Found:
    """The segments of a part that hold shared anchors: unique ones (grid of bytes, size and anchor place; group; least document) and their uses."""

    def __init__(self, table: pa.Table, keys: np.ndarray, hot: np.ndarray, window: int):
        most = 2 * window - ANCHOR
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        rows, group, doc, row, place = [], [], [], [], []
        for ids, lo, _, data, offsets, (a, q, first, last) in _slices(table, window):
            i = np.minimum(np.searchsorted(keys, a), len(keys) - 1)
            hit = keys[i] == a
            a, q, first, last, is_hot = a[hit], q[hit], first[hit], last[hit], hot[i[hit]]
            n = np.where(is_hot, last - first + 1, 1)  # windows of hot anchors, one by one
            back = np.repeat(np.arange(len(a)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            alone = is_hot[back]
            first = first[back] + step
            last = np.where(alone, first, last[back])
            size = last - first + window
            grid = np.zeros((len(back), most + 2), np.uint8)
            inside = np.arange(most)[None, :] < size[:, None]
            grid[:, :most][inside] = data[(first[:, None] + np.arange(most)[None, :])[inside]]
            own = mix(range_hash(prefix_hash(data), first, first + window))
            grid[:, most] = size
            grid[:, most + 1] = np.where(alone, 0, q[back] - first)
            rows.append(grid)
            group.append(np.where(alone, own, a[back]))
            text = lo + np.searchsorted(offsets, first, "right") - 1
            doc.append(ids[text])
            row.append(text)
            place.append(first - offsets[text - lo])
        grid, group, doc, row, place = (np.concatenate(x) for x in (rows, group, doc, row, place))
        whole = np.ascontiguousarray(grid).view([("", f"V{grid.shape[1]}")]).ravel()
        order = np.lexsort((doc, _row_hash(grid), group))
        same = np.zeros(len(order), bool)
        same[1:] = (group[order][1:] == group[order][:-1]) & (whole[order][1:] == whole[order][:-1])
        start = np.flatnonzero(~same)
        head = order[start]
        #: of the unique segments
        self.grid, self.group, self.least, self.most = grid[head], group[head], doc[head], most
        #: of the uses: their segment, document above its least one, row in the part, place in the text
        self.of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        self.above, self.row, self.place = doc[order] > self.least[self.of], row[order], place[order]

    @staticmethod
    def of_answers(table: pa.Table, answers: pa.Table, window: int) -> _Found | None:
        shared = answers.filter(answers.column("keys").is_valid())
        if not table.num_rows or not shared.num_rows:
            return None
        blocks = sorted((k.as_py(), h.as_py()) for k, h in zip(shared.column("keys"), shared.column("hot")))
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k, _ in blocks])
        return _Found(table, keys, np.concatenate([np.frombuffer(h, bool) for _, h in blocks]), window)

    def blocks(self, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, its unique segments in order)."""
        return _blocks(((self.group >> np.uint64(7)) % np.uint64(n_buckets)).astype(np.int64))


_SEGMENTS = "bucket int, part int, sizes binary, anchors binary, groups binary, least binary, text binary"


def _segments(parts: DataFrame, shared: DataFrame, n_buckets: int, window: int) -> DataFrame:
    names = [f.split()[0] for f in _SEGMENTS.split(", ")]
    types = dict(zip(names, [pa.int32(), pa.int32(), *[pa.binary()] * 5]))

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in names}
        found = _Found.of_answers(table, answers, window)
        if found is not None:
            part, most = table.column("_part")[0].as_py(), found.most
            for b, k in found.blocks(n_buckets):
                g = found.grid[k]
                values = {"bucket": b, "part": part, "sizes": g[:, most], "anchors": g[:, most + 1], "groups": found.group[k], "least": found.least[k], "text": g[:, :most][np.arange(most)[None, :] < g[:, most : most + 1]]}
                for name, v in values.items():
                    out[name].append(v.tobytes() if isinstance(v, np.ndarray) else v)
        return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})

    return parts.groupBy("_part").cogroup(shared.groupBy("part")).applyInArrow(run, _SEGMENTS)


def _row_hash(grid: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bytes."""
    weight = mix(np.arange(1, grid.shape[1] + 1, dtype=np.uint64))
    out = np.zeros(len(grid), np.uint64)
    for k in range(grid.shape[1]):
        out += grid[:, k] * weight[k]
    return out


def lost_windows(table: pa.Table, window: int) -> pa.Table:
    """(part, bucket, masks) of a bucket's segments; see ``_answers``."""
    read = lambda name, kind: [np.frombuffer(v.as_buffer(), kind) for v in table.column(name)]
    sizes = read("sizes", np.uint8)
    size, shift, group, doc, text = (np.concatenate(x) for x in (sizes, read("anchors", np.uint8), read("groups", np.uint64), read("least", np.int64), read("text", np.uint8)))
    begin = np.cumsum(size, dtype=np.int64) - size
    lost = np.zeros(len(size), np.uint64)  # bit j: the window that begins j bytes into the segment
    for k in _chunks(group, CHUNK):
        at = np.concatenate([[0], np.cumsum(size[k], dtype=np.int64)])
        own = text[np.repeat(begin[k] - at[:-1], size[k]) + np.arange(at[-1])]
        left, of = shift[k].astype(np.int64), doc[k]
        for i, t, m in least_documents(own, at, at[:-1] + left, group[k], of, window):
            gone = m < of[i]
            lost[k[i[gone]]] |= np.uint64(1) << (left[i[gone]] - t[gone]).astype(np.uint64)
    masks = np.split(lost, np.cumsum([len(x) for x in sizes])[:-1])
    live = [i for i, m in enumerate(masks) if m.any()]
    return pa.table({"part": table.column("part").take(pa.array(live, pa.int64())), "bucket": table.column("bucket").take(pa.array(live, pa.int64())), "masks": pa.array([masks[i].tobytes() for i in live], pa.binary())})


def _answers(segments: DataFrame, n_buckets: int, window: int) -> DataFrame:
    """(part, bucket, masks): for each segment that the part sent to the bucket, in order, the bits of its windows that start in a smaller document."""
    # as many tasks as buckets (TASKS at most), so that a task's share does not grow with the input
    return segments.repartition(min(n_buckets, TASKS), "bucket").groupBy("bucket").applyInArrow(lambda table: lost_windows(table, window), "part int, bucket int, masks binary")


def lost_ranges(found: _Found, masks: dict[int, np.ndarray], n_buckets: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the removed ranges of a part's uses; ranges may overlap."""
    lost = np.zeros(len(found.group), np.uint64)
    for b, k in found.blocks(n_buckets):
        if b in masks:
            lost[k] = masks[b]
    windows = found.grid[:, found.most].astype(np.int64) - window + 1
    # a use in a document above the least one of its own part loses all windows
    every = (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)
    mask = np.where(found.above, every[found.of], lost[found.of])
    use = np.flatnonzero(mask)
    mask = mask[use]
    row, lo, hi = [], [], []
    prev, start = np.zeros(len(use), bool), np.zeros(len(use), np.int64)
    for j in range(int(windows.max(initial=0)) + 1):
        bit = ((mask >> np.uint64(j)) & np.uint64(1)).astype(bool)
        start[bit & ~prev] = j
        done = np.flatnonzero(prev & ~bit)
        row.append(found.row[use[done]])
        lo.append(found.place[use[done]] + start[done])
        hi.append(found.place[use[done]] + j - 1 + window)
        prev = bit
    return tuple(np.concatenate(x).astype(np.int64) for x in (row, lo, hi))


def united(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the ranges of each row."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    if not len(row):
        return row, lo, hi
    wide = np.int64(max(int(hi.max()), 1) + 1)
    reach = np.maximum.accumulate(row * wide + hi)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (row[1:] * wide + lo[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return row[at], lo[at], np.maximum.reduceat(hi, at)


def _apply(parts: DataFrame, shared: DataFrame, answers: DataFrame, id_type: str, n_buckets: int, window: int) -> DataFrame:
    schema = f"_id {id_type}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    both = shared.unionByName(answers, allowMissingColumns=True).select("part", "keys", "hot", "bucket", "masks")

    def run(table: pa.Table, given: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        row, lo, hi = none, none, none
        found = _Found.of_answers(table, given, window)
        if found is not None:
            masks = given.filter(given.column("masks").is_valid())
            row, lo, hi = united(*lost_ranges(found, {b.as_py(): np.frombuffer(m.as_buffer(), np.uint64) for b, m in zip(masks.column("bucket"), masks.column("masks"))}, n_buckets, window))
        bounds = np.searchsorted(row, np.arange(table.num_rows + 1))
        size, removed, spans, kept = [], [], [], []
        for i, text in enumerate(table.column("_text")):
            raw = text.as_buffer().to_pybytes()
            own = [(int(a), int(b)) for a, b in zip(lo[bounds[i] : bounds[i + 1]], hi[bounds[i] : bounds[i + 1]])]
            edges = [0, *(x for s in own for x in s), len(raw)]
            size.append(len(raw))
            removed.append(sum(b - a for a, b in own))
            spans.append([{"start": a, "end": b} for a, b in own])
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if own else raw)
        return pa.table({"_id": table.column("_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})

    return parts.groupBy("_part").cogroup(both.groupBy("part")).applyInArrow(run, schema)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (maximal removed byte ranges), kept (the remaining bytes)."""
    if not ANCHOR <= window <= ANCHOR + 62:
        raise ValueError(f"window must be from {ANCHOR} to {ANCHOR + 62} bytes")
    total, most = _sizes(docs, text_col)
    parts = _parts(docs, id_col, text_col, total, most)
    n_anchor = int(total * 2 / (window - ANCHOR + 2) / bucket) + 1
    shared = materialise(_shared_anchors(_anchor_blocks(parts, n_anchor, window), hot), "shared-anchors")
    n_buckets = (shared.agg(F.sum("rows").alias("n")).first()["n"] or 0) // min(bucket, ROWS) + 1
    answers = materialise(_answers(_segments(parts, shared, n_buckets, window), n_buckets, window), "lost-windows")
    return _apply(parts, shared, answers, parts.schema["_id"].dataType.simpleString(), n_buckets, window).withColumnRenamed("_id", id_col)
