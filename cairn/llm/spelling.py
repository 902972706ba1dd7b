"""Groups of spelling variants: words at one edit from each other, and the frequent form that each leads to.

Words are counted document by document, so a frequent word is one row a task before anything is shuffled. The vocabulary is then cut, in code-point order,
into shards of at most ``SHARD_WORDS`` words, and each shard becomes a compact trie: one node a branching point or word, a string on each edge. Words travel in
blocks of at most ``BLOCK_WORDS``; every block meets every shard once. In the task that holds the two, each word's Levenshtein automaton of
distance one walks the trie depth-first: a state is a place in the word and the number of errors so far. Without an error it follows the word; at every node and edge that
leave the word it replaces, inserts or deletes there, which finds each neighbour once, because the error can be moved to the first code point in which
the two differ; after an error the edges must spell the rest of the word. Accepting nodes are the word's neighbours in that shard.

Of each word and shard one row leaves the task: how many neighbours, and the best of them. The rows are added up by word. A word's form is its best
neighbour if that is ``RATIO`` times as frequent; forms are followed to their end by pointer doubling, and since counts at least double at each step they end.

The shards are broadcast while all of them together take at most ``BROADCAST_BYTES``, as measured; beyond that blocks and shards are joined by shuffle.

Defined cases: a null text has no word; a null id counts as the empty string; repeated rows count again; of neighbours with equal counts the smallest in
code-point order is best; words without neighbours have no form and are their own root. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import os.path
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialise
from cairn.operators.graph import walks_to_sinks

#: Fixed value: what a word is made of, once A-Z are lower-cased.
RUNS = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
SHARD_WORDS, BLOCK_WORDS = 1 << 16, 1 << 16
BROADCAST_BYTES = 64 << 20
#: Words that a task counts before it hands them on.
HELD_WORDS = 1 << 17
_LONG = 1 << 20
_LEAF: dict[str, tuple[str, int]] = {}


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, edit_one_in: int | None = None) -> DataFrame:
    """(word, n): the words of at least ``least_length`` code points and their occurrences.

    ``edit_one_in`` plants errors, as a test of the groups: of every so many pairs of document and word, chosen by a checksum, one loses a code point throughout the document.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for id_, text in zip(b.column(0), b.column(1)):
                low = text.as_py().encode().lower().decode()  # of bytes, lower() changes A-Z alone
                runs = Counter(RUNS.findall(low) if len(low) <= _LONG else (m.group() for m in RUNS.finditer(low)))
                start = zlib.crc32(f"{id_.as_py()}:".encode())
                for word, n in runs.items():
                    if edit_one_in and not (h := zlib.crc32(word.encode(), start)) % edit_one_in:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield _batch(counts)
                    counts.clear()
        if counts:
            yield _batch(counts)

    return base.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _batch(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


class Trie:
    """A compact trie: nodes in preorder, each with the string on the edge to it, its children and the count of the word that ends there (0: none). Node 0 is the root."""

    def __init__(self, labels: list[str], parents: list[int], counts: list[int]):
        self.labels, self.parents, self.counts = labels, parents, counts
        self.children: list[dict[str, tuple[str, int]]] = [_LEAF] * len(labels)  # by the first code point of the edge
        for node in range(1, len(labels)):
            if self.children[parents[node]] is _LEAF:
                self.children[parents[node]] = {}
            self.children[parents[node]][labels[node][0]] = (labels[node], node)

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        """From different words in code-point order."""
        labels, parents, ends = [""], [-1], [0]
        open_ = [(0, len(words), 0, -1)]  # words of an edge, where the edge begins in them, the node above
        while open_:
            lo, hi, depth, parent = open_.pop()
            if parent < 0:
                node = to = 0
            else:
                to = depth + len(os.path.commonprefix([words[lo][depth:], words[hi - 1][depth:]]))
                node = len(labels)
                labels.append(words[lo][depth:to])
                parents.append(parent)
                ends.append(0)
            if lo < hi and len(words[lo]) == to:
                ends[node] = counts[lo]
                lo += 1
            edges = []
            while lo < hi:
                end = bisect_left(words, words[lo][:to] + chr(ord(words[lo][to]) + 1), lo, hi)
                edges.append((lo, end, to, node))
                lo = end
            open_ += reversed(edges)
        return cls(labels, parents, ends)

    def pack(self) -> bytes:
        sizes = np.array([len(x) for x in self.labels], np.int32)
        head = np.array([len(self.labels)], np.int64)
        return b"".join([head.tobytes(), sizes.tobytes(), np.array(self.parents, np.int32).tobytes(), np.array(self.counts, np.int64).tobytes(), "".join(self.labels).encode()])

    @classmethod
    def unpack(cls, data: bytes) -> Trie:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int32, n, 8)
        text, ends = data[8 + 16 * n :].decode(), np.cumsum(sizes).tolist()
        labels = [text[e - s : e] for e, s in zip(ends, sizes.tolist())]
        return cls(labels, np.frombuffer(data, np.int32, n, 8 + 4 * n).tolist(), np.frombuffer(data, np.int64, n, 8 + 8 * n).tolist())

    def _rest(self, word: str, node: int, at: int) -> int:
        """The count of the word that ``word[at:]`` leads to from the node, 0 if there is none: the automaton after an error."""
        children, size = self.children, len(word)
        while at < size:
            edge = children[node].get(word[at])
            if edge is None or not word.startswith(edge[0], at):
                return 0
            node, at = edge[1], at + len(edge[0])
        return self.counts[node]

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """(neighbour, its count) of all words at distance one, each once."""
        children, size, rest = self.children, len(word), self._rest
        node = at = 0
        while True:  # no error so far: word[:at] leads to the node
            edges = children[node]
            here = word[at] if at < size else ""
            after = word[at + 1] if at + 1 < size else ""
            for first, (label, child) in edges.items():
                if first == here:
                    continue
                if len(label) == 1:
                    below = children[child]
                    if here and (not after or after in below) and (n := rest(word, child, at + 1)):
                        yield word[:at] + first + word[at + 1 :], n
                    if (not here or here in below) and (n := rest(word, child, at)):
                        yield word[:at] + first + word[at:], n
                else:
                    if here and word.startswith(label[1:], at + 1) and (n := rest(word, child, at + len(label))):
                        yield word[:at] + first + word[at + 1 :], n
                    if word.startswith(label[1:], at) and (n := rest(word, child, at + len(label) - 1)):
                        yield word[:at] + first + word[at:], n
            if not here:
                return
            if after != here and (n := rest(word, node, at + 1)):  # of equal code points, the last is deleted
                yield word[:at] + word[at + 1 :], n
            edge = edges.get(here)
            if edge is None:
                return
            label, child = edge
            if not word.startswith(label, at):
                break
            node, at = child, at + len(label)
        q = 1
        while at + q < size and label[q] == word[at + q]:
            q += 1
        p = at + q  # the edge leaves the word within it
        if p < size:
            if word.startswith(label[q + 1 :], p + 1) and (n := rest(word, child, at + len(label))):
                yield word[:p] + label[q] + word[p + 1 :], n
            if word.startswith(label[q:], p + 1) and (n := rest(word, child, at + len(label) + 1)):
                yield word[:p] + word[p + 1 :], n
        if word.startswith(label[q + 1 :], p) and (n := rest(word, child, at + len(label) - 1)):
            yield word[:p] + label[q] + word[p:], n


def trie_shards(vocabulary: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, trie): the vocabulary (word, n) in code-point order, in tries of at most ``shard_words`` words, written."""
    n = max(1, -(-vocabulary.count() // shard_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [], []
        for b in batches:
            words += b.column(0).to_pylist()
            counts += b.column(1).to_pylist()
            while len(words) >= shard_words:
                yield shard(words[:shard_words], counts[:shard_words])
                del words[:shard_words], counts[:shard_words]
        if words:
            yield shard(words, counts)

    def shard(words: list[str], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([Trie.of(words, counts).pack()], pa.binary())], ["trie"])

    ordered = vocabulary.select("word", "n").repartitionByRange(n, "word").sortWithinPartitions("word")
    return materialise(ordered.mapInArrow(run, "trie binary").withColumn("shard", F.monotonically_increasing_id()), "tries")


def word_blocks(vocabulary: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(words): the vocabulary in blocks of at most ``block_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= block_words:
                yield block(held[:block_words])
                del held[:block_words]
        if held:
            yield block(held)

    def block(words: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([words], pa.list_(pa.string()))], ["words"])

    return materialise(vocabulary.select("word").mapInArrow(run, "words array<string>"), "word-blocks")


def neighbours(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(word, n_near, best, best_n) of the words of (word, n) that have a neighbour: how many, and the most frequent one. ``word`` must be unique and ``n`` positive."""
    shards, blocks = trie_shards(vocabulary, shard_words), word_blocks(vocabulary, block_words)
    sizes = shards.select("shard", F.octet_length("trie").alias("b")).collect()  # two numbers a shard
    pairs = max(1, len(sizes) * blocks.count())
    numbers = F.array(*(F.lit(r["shard"]) for r in sizes)) if sizes else F.expr("cast(array() as array<bigint>)")
    small = sum(r["b"] for r in sizes) <= broadcast_bytes
    dealt = blocks.withColumn("shard", F.explode(numbers)).repartition(min(pairs, 8 * int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    met = dealt.join(F.broadcast(shards) if small else shards, "shard").select("shard", "words", "trie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, trie = None, None
        for b in batches:
            for shard, words, packed in zip(b.column(0), b.column(1), b.column(2)):
                if number != shard.as_py():
                    number, trie = shard.as_py(), Trie.unpack(packed.as_py())
                rows = []
                for word in words.as_py():
                    found = dict(trie.near(word))
                    if found:
                        best = min(found, key=lambda v: (-found[v], v))
                        rows.append((word, len(found), best, found[best]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n_near", "best", "best_n"])

    found = met.mapInArrow(run, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def variant_groups(counts: DataFrame, ratio: float = RATIO, least_count: int = LEAST_COUNT, **sizes) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of (word, n) that occur at least ``least_count`` times. Words with one root are variants of it."""
    vocabulary = materialise(counts.filter(F.col("n") >= least_count).select("word", "n"), "vocabulary")
    known = vocabulary.join(neighbours(vocabulary, **sizes), "word", "left")
    leads = F.col("best_n") >= ratio * F.col("n")
    formed = materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best")).alias("form"), F.when(leads, F.col("best_n")).alias("form_n")), "forms")
    ends = walks_to_sinks(formed.filter("form IS NOT NULL").select(F.col("word").alias("src"), F.col("form").alias("dst")))
    return formed.join(ends.select(F.col("id").alias("word"), "sink"), "word", "left").select("word", "form", F.coalesce("sink", "word").alias("root"), "n", "n_near", "form_n")
