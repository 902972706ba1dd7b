"""Benchmark decontamination by suffix arrays over the training documents.

Each task cuts its documents into shards of about ``SHARD_BYTES`` of text and builds the word suffix array
of every shard: words become ranks in the vocabulary of the test items (other words are one rank below
all of them, and no suffix begins there), and the suffixes are sorted by tripling the sorted depth
until it passes a window. A word has an item's rank only if it is that word byte by byte: hashes choose
the candidate, bytes decide.

A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one
window. The suffixes of the items that begin a window are looked up by binary search, comparing word by word; equal
windows are looked up once. The interval of suffixes that begin with a window gives all its occurrences with their
locations. The words of all occurrences are the hits of a document, and the items of its windows are its items.
Every occurrence is then extended: its place in the suffix array of the items gives the longest verbatim
match that starts there. Shared runs of fewer words than a window are no matches and are not reported.

The test items go to the tasks in blocks of at most ``BLOCK_BYTES`` of text (usually one). The documents are read once whatever their number: a task holds a shard of
documents and loads block after block, one at a time. ``drop_contaminated`` filters the rows in the pass that reads them, so no document is shuffled.

Defined cases: a null text has no words, and an item without words no window; rows that repeat a document are each
judged by their own text; repeated item ids count as one item, and a null item id counts with the empty string as its name;
extra columns are ignored, or kept by ``drop_contaminated``; a text of any length is one shard at least; without documents the result is empty,
without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import kept_rows, lookup_table, same_words, text_slices, words_of

WINDOW = 10
SHARD_BYTES = 3 << 20
BLOCK_BYTES = 4 << 20
#: Names of items in an output batch, about.
BATCH_NAMES = 1 << 16
_ALNUM = lookup_table("alnum")
_RANK_BITS = 21


class Items:
    """The test items of a block: their vocabulary by bytes, their words as ranks with a 0 after each item, their distinct windows and who owns them."""

    def __init__(self, names: list[str], texts: list[str | None], window: int):
        self.names = sorted(set(names))
        number = {n: i for i, n in enumerate(self.names)}
        own = np.array([number[n] for n in names], np.int64)
        data, offsets = next(((d, o) for _, _, d, o in text_slices(pa.array(texts, pa.string()), 1 << 62)), (np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        self.bytes = _ALNUM[data]
        for self.seed in range(16):
            words, start, end, at = words_of(data, offsets, _ALNUM, self.seed)
            self.vocabulary, first, back = np.unique(words, return_index=True, return_inverse=True)
            self.start, self.size = start[first], (end - start)[first]
            if np.array_equal(self.size[back], end - start) and same_words(self.bytes, start, self.bytes, self.start[back], end - start).all():
                break  # no two words of the items share a hash
        else:
            raise ValueError("the words of the items collide under every seed")
        self.table_bits = max(10, int(np.ceil(np.log2(max(2, 8 * len(self.vocabulary))))))
        self.table = np.zeros(1 << self.table_bits, np.int64)
        self.table[self._slot(self.vocabulary)] = np.arange(1, len(self.vocabulary) + 1)
        size = np.diff(at)
        text = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(words)) + text
        self.words = np.zeros(len(words) + len(size) + 1, np.int64)
        self.words[place] = back + 1
        self.owner = np.zeros(len(self.words), np.int64)
        self.owner[place] = own[text]
        self.order = suffix_array(self.words, int(size.max(initial=0)) + 1)
        left = at[1:][text] - np.arange(len(words))
        begins = np.flatnonzero((left >= window) | ((size[text] < window) & (left == size[text])))
        length = np.minimum(left[begins], window)
        steps = np.arange(window)[None, :]
        content = np.where(steps < length[:, None], self.words[np.minimum(place[begins][:, None] + steps, len(self.words) - 1)], 0).astype(np.int32)
        _, first, back = np.unique(content, axis=0, return_index=True, return_inverse=True) if len(begins) else (None, begins, begins)
        self.window, self.length = place[begins][first], length[first]
        pairs = np.unique(np.stack([back.ravel(), own[text[begins]]], 1), axis=0) if len(begins) else np.zeros((0, 2), np.int64)
        bound = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        known: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []  # the different sets of items that own a window
        self.list_of = np.zeros(len(first), np.int64)
        for k in range(len(first)):
            owners = pairs[bound[k] : bound[k + 1], 1]
            self.list_of[k] = known.setdefault(owners.tobytes(), len(self.lists))
            if self.list_of[k] == len(self.lists):
                self.lists.append(owners)

    def _slot(self, w: np.ndarray) -> np.ndarray:
        return (w >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def ranks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(1.. for words of the items and 0 for others, word offsets of the texts). Most words are settled by one look at a table by hash."""
        w, start, end, at = words_of(data, offsets, _ALNUM, self.seed)
        if not len(self.vocabulary):
            return np.zeros(len(w), np.int64), at
        out = self.table[self._slot(w)]
        hit = np.flatnonzero(out)
        r = out[hit]
        other = self.vocabulary[r - 1] != w[hit]
        if other.any():  # another word of the items may own the slot
            i = hit[other]
            k = np.minimum(np.searchsorted(self.vocabulary, w[i]), len(self.vocabulary) - 1)
            out[i] = np.where(self.vocabulary[k] == w[i], k + 1, 0)
        hit = np.flatnonzero(out)
        k = out[hit] - 1
        size = end[hit] - start[hit]
        same = self.size[k] == size
        same[same] = same_words(_ALNUM[data], start[hit[same]], self.bytes, self.start[k[same]], size[same])
        out[hit[~same]] = 0
        return out, at


def suffix_array(r: np.ndarray, depth: int) -> np.ndarray:
    """Positions whose rank is not 0, ordered by the words that follow, for ``depth`` words at least. A 0 ends every comparison: it is below all words."""
    sa = np.flatnonzero(r)
    if not len(sa):
        return sa
    at = lambda x, i: np.where(i < len(x), x[np.minimum(i, len(x) - 1)], 0)
    rank, sorted_to = r, 1
    while sorted_to < depth:
        keys = [rank[sa], at(rank, sa + sorted_to), at(rank, sa + 2 * sorted_to)]
        if rank.max() >> _RANK_BITS:  # a very long text: three ranks don't fit one number
            order = np.lexsort(keys[::-1])
        else:
            keys = [(keys[0] << (2 * _RANK_BITS)) | (keys[1] << _RANK_BITS) | keys[2]]
            order = np.argsort(keys[0], kind="stable")
        sa, keys = sa[order], [key[order] for key in keys]
        fresh = np.ones(len(sa), bool)
        fresh[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
        rank = np.zeros(len(r), np.int64)
        rank[sa] = np.cumsum(fresh)
        sorted_to *= 3
        if fresh.all():
            break
    return sa


def compare(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(words in common, sign) of the suffixes of x at i against those of y at j, over at most ``most`` words. Both tables end in 0, and a 0 ends a suffix."""
    common, sign = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    live = np.arange(len(i)) if most is None else np.flatnonzero(most > 0)
    while len(live):
        a, b = x[i[live] + common[live]], y[j[live] + common[live]]
        same = (a == b) & (a != 0)
        sign[live[~same]] = np.sign(a - b)[~same]
        live = live[same]
        common[live] += 1
        if most is not None:
            live = live[common[live] < most[live]]
    return common, sign


def search(x: np.ndarray, order: np.ndarray, y: np.ndarray, j: np.ndarray, most: np.ndarray | None = None, upper: bool = False) -> np.ndarray:
    """First place in the suffix array ``order`` of x that is not below (upper: above) each suffix of y at j."""
    lo, hi = np.zeros(len(j), np.int64), np.full(len(j), len(order), np.int64)
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        _, sign = compare(x, order[mid], y, j[live], None if most is None else most[live])
        right = sign <= 0 if upper else sign < 0
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
    return lo


def shard_matches(r: np.ndarray, at: np.ndarray, items: Items, window: int) -> dict[str, np.ndarray]:
    """Over the words of a shard (``at``: word offsets of its documents): hit words, (document, list of items) pairs, longest matches."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    spaced = np.zeros(len(r) + len(at), np.int64)  # a 0 after each document
    place = np.arange(len(r)) + text
    spaced[place] = r
    sa = suffix_array(spaced, window + 1)
    empty = np.zeros(0, np.int64)
    none = {"hit": np.zeros(len(r), bool), "doc": empty, "list": empty, "long_doc": empty, "long_item": empty, "long_len": empty, "long_at": empty}
    if not len(sa) or not len(items.window):
        return none
    lo = search(spaced, sa, items.words, items.window, items.length)
    hi = search(spaced, sa, items.words, items.window, items.length, upper=True)
    count = hi - lo
    rows = np.repeat(np.arange(len(lo)), count)
    where = sa[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    if not len(where):
        return none
    edge = np.zeros(len(spaced) + 1, np.int64)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + items.length[rows], -1)
    doc_of = np.repeat(np.arange(len(at) - 1), np.diff(at) + 1)
    pair = np.unique(doc_of[where] * np.int64(len(items.lists)) + items.list_of[rows])
    # the longest match from an occurrence on is with a neighbour of its place among the items' suffixes
    where = np.unique(where)
    spot = search(items.words, items.order, spaced, where)
    best, source = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
    for near in (spot - 1, spot):
        inside = np.flatnonzero((near >= 0) & (near < len(items.order)))
        j = items.order[near[inside]]
        common, _ = compare(spaced, where[inside], items.words, j)
        better = common > best[inside]
        best[inside[better]], source[inside[better]] = common[better], j[better]
    doc = doc_of[where]
    order = np.lexsort((where, -best, doc))
    top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
    return {"hit": (np.cumsum(edge)[:-1] > 0)[place], "doc": pair // len(items.lists), "list": pair % len(items.lists), "long_doc": doc[top], "long_item": items.owner[source[top]], "long_len": best[top], "long_at": where[top] - at[:-1][doc[top]] - doc[top]}


def _spans(hit: np.ndarray, at: np.ndarray) -> list[list[dict[str, int]]]:
    """Maximal runs of hit words of each document, as word positions in it."""
    begin, end = hit.copy(), hit.copy()
    if len(hit):
        begin[1:] &= ~hit[:-1]
        end[:-1] &= ~hit[1:]
        inner = at[(at > 0) & (at < len(hit))]
        begin[inner] = hit[inner]
        end[inner - 1] = hit[inner - 1]
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(b, at)
    return [[{"start": int(x - at[i]), "end": int(y - at[i])} for x, y in zip(b[first[i] : first[i + 1]], e[first[i] : first[i + 1]])] for i in range(len(at) - 1)]


class Blocks:
    """The test items in blocks of at most ``block_bytes`` of text, about, each broadcast as it is made. Iterating loads them one by one."""

    def __init__(self, benchmark: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int):
        tests = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
        size = tests.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
        self.parts = []
        for k in range(n):
            rows = tests.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k).orderBy("name", "text").collect()
            self.parts.append(tests.sparkSession.sparkContext.broadcast(Items([r["name"] for r in rows], [r["text"] for r in rows], window)))

    def __iter__(self) -> Iterator[Items]:
        for part in self.parts:
            yield part.value
            if len(self.parts) > 1:
                vars(part).pop("_value", None)  # else a task would hold all of them


class Shard:
    """The documents of a shard with what all blocks of items have in common with them: hit words, names of items by document, longest matches."""

    def __init__(self, held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]], blocks: Blocks, window: int):
        self.rows = [x[0] for x in held]
        self.found: dict[int, list[list[str]]] = {}
        for k, items in enumerate(blocks):
            ranked = [items.ranks(data, offsets) for _, data, offsets in held]
            self.at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(at) for _, at in ranked]))])
            m = shard_matches(np.concatenate([r for r, _ in ranked]), self.at, items, window)
            if not k:
                n = len(self.at) - 1
                self.hit, self.longest, self.place, self.item = m["hit"], np.zeros(n, np.int64), np.full(n, -1), np.full(n, None, object)
            self.hit = self.hit | m["hit"]
            names = {i: [items.names[o] for o in items.lists[i]] for i in np.unique(m["list"]).tolist()}
            for doc, i in zip(m["doc"].tolist(), m["list"].tolist()):
                self.found.setdefault(doc, []).append(names[i])
            for doc, size, place, item in zip(*(m[f"long_{c}"].tolist() for c in ("doc", "len", "at", "item"))):
                if (size, -place, items.names[item]) > (self.longest[doc], -self.place[doc], self.item[doc] or ""):
                    self.longest[doc], self.place[doc], self.item[doc] = size, place, items.names[item]


def _shards(batches: Iterator[pa.RecordBatch], blocks: Blocks, window: int, text_at: int) -> Iterator[Shard]:
    """``text_at`` is the position of the text column."""
    held, size = [], 0
    for b in batches:
        for lo, hi, data, offsets in text_slices(b.column(text_at)):
            held.append((b.slice(lo, hi - lo), data, offsets))
            size += len(data)
            if size >= SHARD_BYTES:
                yield Shard(held, blocks, window)
                held, size = [], 0
    if held:
        yield Shard(held, blocks, window)


_OUT = "_id {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest_words long, longest_item string, longest_at long"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans, items (names, sorted), longest_words, longest_item, longest_at (0, null and -1 without a hit)."""
    blocks = Blocks(benchmark, window, item_col, item_text_col, block_bytes)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, blocks, window, 1):
            n, spans = len(shard.at) - 1, _spans(shard.hit, shard.at)
            own = pa.concat_arrays([x.column(0) for x in shard.rows])
            found, size, done = [], 0, 0
            for d in range(n):
                found.append(sorted(set().union(*shard.found.get(d, ()))))
                size += len(found[-1])
                if size >= BATCH_NAMES or d == n - 1:
                    part = slice(done, d + 1)
                    columns = [own[part], pa.array(np.diff(shard.at)[part]), pa.array(spans[part], span), pa.array(found, pa.list_(pa.string())), pa.array(shard.longest[part]), pa.array(shard.item[part].tolist(), pa.string()), pa.array(shard.place[part])]
                    yield pa.RecordBatch.from_arrays(columns, ["_id", "n_words", "spans", "items", "longest_words", "longest_item", "longest_at"])
                    found, size, done = [], 0, d + 1

    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return base.mapInArrow(run, _OUT.format(kind=kind)).select(F.col("_id").alias(id_col), "n_words", hits.alias("n_hit"), "spans", "items", "longest_words", "longest_item", "longest_at")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose text has no hit, with all their columns. Every row is judged by its own text, in the pass that reads it."""
    text_at, blocks = docs.columns.index(text_col), Blocks(benchmark, window, item_col, item_text_col, block_bytes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for shard in _shards(batches, blocks, window, text_at):
            total = np.concatenate([[0], np.cumsum(shard.hit)])
            clean = total[shard.at[1:]] == total[shard.at[:-1]]
            done = 0
            for x in shard.rows:
                yield x, clean[done : done + x.num_rows]
                done += x.num_rows

    return kept_rows(docs, keep)
