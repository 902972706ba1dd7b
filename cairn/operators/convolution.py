"""A trained two-layer graph convolution: full-batch gradient descent with sparse products as joins.

The network is softmax(A relu(A X W1 + b1) W2 + b2), where A is the adjacency matrix with self loops, normalised by the roots of both degrees. A X is made once.
Since A stands to the left of the small matrices, every epoch takes two sparse products of one column each: of the difference of the two columns of relu(A X W1 + b1) W2 on the way forward, and of the
errors on the way back (A is symmetric). Edges and nodes are written once in buckets, so a product moves the node values to the edges, which are neither moved nor sorted, and then
partial sums by node, combined before the shuffle. The gradients of the weights are sums over nodes: each task adds up its nodes and sends one row of some
400 numbers for 3 features and 64 hidden units, and these rows are added up; weights and Adam's moments are the driver's only state.

Nodes without edges have only their self loop. Edges with ends that are no nodes are ignored, repeated edges count once, direction is ignored. Features must not be null; a null label is no class, and such a node is not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.scratch import bucketed, hashed, materialise

HIDDEN, EPOCHS, RATE = 64, 20, 0.01


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w): both directions of the distinct edges among the nodes and a self loop each, weighted 1 / sqrt(degree of src * degree of dst)."""
    ids = nodes.select("id").distinct()
    own = edges.select("src", "dst").filter("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    both = materialise(own.union(own.select("dst", "src")).union(ids.select("id", "id")).distinct(), "both-ways")
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    weighted = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    return bucketed(weighted.select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("w")), "src", "adjacency")


def product(matrix: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(id, names): the sparse matrix (src, dst, w) times the columns of ``values`` (id, names)."""
    met = matrix.join(hashed(values.select(F.col("id").alias("src"), *names)), "src")
    return met.groupBy(F.col("dst").alias("id")).agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in names))


class Network:
    """The weights, and what they make of rows of A X."""

    def __init__(self, features: int, hidden: int = HIDDEN, seed: int = 42):
        r = np.random.default_rng(seed)
        uniform = lambda a, b: r.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        self.weights = [uniform(features, hidden), np.zeros(hidden), uniform(hidden, 2), np.zeros(2)]
        self.moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        self.steps = 0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.weights[0] + self.weights[1], 0)

    def update(self, gradients: list[np.ndarray], rate: float) -> None:
        """A step of Adam."""
        self.steps += 1
        for w, g, m in zip(self.weights, gradients, self.moments):
            m[0][...] = 0.9 * m[0] + 0.1 * g
            m[1][...] = 0.999 * m[1] + 0.001 * g * g
            w -= rate * (m[0] / (1 - 0.9**self.steps)) / (np.sqrt(m[1] / (1 - 0.999**self.steps)) + 1e-8)


def _numbers(batch: pa.RecordBatch, first: int, last: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, last)], 1).astype(float)


class Convolution:
    """A network over one graph: ``nodes`` (id, label 0 or 1, train boolean, features), ``edges`` (src, dst)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, features: list[str], hidden: int = HIDDEN, seed: int = 42):
        self.features, self.network, self.losses = features, Network(len(features), hidden, seed), []
        nodes = materialise(nodes.select("id", F.col("label").cast("double").alias("label"), (F.col("train") & F.col("label").isNotNull()).alias("train"), *(F.col(f).cast("double").alias(f) for f in features)), "nodes")
        self.kind = dict(nodes.dtypes)["id"]
        self.matrix = adjacency(edges, nodes)
        self.rows = bucketed(nodes.select("id", "label", "train").join(product(self.matrix, nodes, features), "id"), "id", "convolved")
        self.trained = nodes.filter("train").count()

    def _scores(self) -> DataFrame:
        """(id, gap): the difference of the two columns of A relu(A X W1 + b1) W2, without b2; the probabilities depend on nothing else."""
        network, n = self.network, len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = network.hidden(_numbers(b, 1, 1 + n)) @ (network.weights[2][:, 1] - network.weights[2][:, 0])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["id", "gap"])

        made = self.rows.select("id", *self.features).mapInArrow(run, f"id {self.kind}, gap double")
        return product(self.matrix, made, ["gap"])

    def probabilities(self) -> DataFrame:
        """(id, label, train, score): the probability of class 1."""
        bias = self.network.weights[3]
        gap = F.col("gap") + float(bias[1] - bias[0])
        return self.rows.select("id", "label", "train").join(hashed(self._scores()), "id").select("id", "label", "train", (1 / (1 + F.exp(-gap))).alias("score"))

    def gradients(self) -> tuple[float, list[np.ndarray]]:
        """(loss, gradients of W1, b1, W2, b2): of the mean cross entropy over the nodes to train on."""
        network, n, m = self.network, len(self.features), max(1, self.trained)
        scored = materialise(self.probabilities(), "forward")
        errors = scored.select("id", F.when(F.col("train"), (F.col("score") - F.col("label")) / m).otherwise(0.0).alias("d1"))
        back = product(self.matrix, errors.filter("d1 <> 0"), ["d1"])  # the error of class 0 is the opposite
        shapes = [w.shape for w in network.weights]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(int(np.prod(s)) for s in shapes[:3]))
            for b in batches:
                x, d = _numbers(b, 0, n), _numbers(b, n, n + 1)
                d = np.concatenate([-d, d], 1)
                h = network.hidden(x)
                inner = (d @ network.weights[2].T) * (h > 0)
                total += np.concatenate([(x.T @ inner).ravel(), inner.sum(0), (h.T @ d).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["slot", "value"])

        sums = self.rows.join(hashed(back), "id").select(*self.features, "d1").mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value"))
        found = np.zeros(sum(int(np.prod(s)) for s in shapes[:3]))
        for r in sums.collect():  # a row a weight
            found[r["slot"]] = r["value"]
        right = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
        ends = scored.filter("train").agg(F.sum(-F.log(F.greatest(right, F.lit(1e-12)))).alias("loss"), F.sum((F.col("score") - F.col("label")) / m).alias("b")).first()
        cut = np.cumsum([int(np.prod(s)) for s in shapes[:3]])
        parts = [p.reshape(s) for p, s in zip(np.split(found, cut[:-1]), shapes)]
        return (ends["loss"] or 0.0) / m, [*parts, np.array([-(ends["b"] or 0.0), ends["b"] or 0.0])]

    def fit(self, epochs: int = EPOCHS, rate: float = RATE) -> Convolution:
        """``losses`` has the loss before each epoch."""
        for _ in range(epochs):
            loss, gradients = self.gradients()
            self.losses.append(loss)
            self.network.update(gradients, rate)
        return self
