"""Attributions of tree models: how much each feature adds to each row's margin, exactly.

A row's margin is that of the mean row plus the sum of its attributions. They are Shapley values of the game in which a feature that is not known is averaged over both
branches of its splits by the training rows that took them. In that game a leaf is worth its value times one factor a feature on its path: whether the row keeps to the path where
the feature is known, the share of training rows that did where it is not. So a leaf of few features is attributed by the coefficients of a product of
small polynomials, for a batch of rows at once, and a model's attribution is the sum over its leaves.

The trees are read from the saved model, a row a node; their number and depth are parameters of the model, so they are a bounded closure of the tasks. Rows stay where they are:
no shuffle. Features must not be null; a model without splits attributes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.scratch import shared_dir


class Leaf:
    """A leaf: its value, and of each feature on its path what the path allows (low < x <= high, and of the categories ``some``, if not None) and the share of training rows that keep to it."""

    def __init__(self, value: float, path: list[tuple[int, float | set[float], bool, float]]):
        """The path's splits are (feature, threshold or categories of the left branch, was it left, share of the rows that went this way)."""
        self.value = value
        self.features = sorted({f for f, *_ in path})
        k = {f: i for i, f in enumerate(self.features)}
        self.low, self.high, self.share = np.full(len(k), -np.inf), np.full(len(k), np.inf), np.ones(len(k))
        self.splits: list[tuple[int, np.ndarray, bool]] = []
        for f, split, left, share in path:
            if isinstance(split, set):
                self.splits.append((k[f], np.array(sorted(split)), left))
            elif left:
                self.high[k[f]] = min(self.high[k[f]], split)
            else:
                self.low[k[f]] = max(self.low[k[f]], split)
            self.share[k[f]] *= share

    def keeps(self, x: np.ndarray) -> np.ndarray:
        """Of each row and feature of the path: does the row keep to the path?"""
        out = (x[:, self.features] > self.low) & (x[:, self.features] <= self.high)
        for i, categories, left in self.splits:
            out[:, i] &= np.isin(x[:, self.features[i]], categories) == left
        return out

    def add(self, x: np.ndarray, out: np.ndarray, weight: float) -> None:
        """Adds the leaf's attributions of the rows of x."""
        m = len(self.features)
        kept = self.keeps(x)
        for j in range(m):
            poly = np.zeros((len(x), m))
            poly[:, 0] = 1.0
            for size, i in enumerate((i for i in range(m) if i != j), 1):  # by the number of known features, one feature after the other
                poly[:, 1 : size + 1] = poly[:, 1 : size + 1] * self.share[i] + poly[:, :size] * kept[:, i : i + 1]
                poly[:, 0] *= self.share[i]
            mean = poly @ np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
            out[:, self.features[j]] += weight * self.value * (kept[:, j] - self.share[j]) * mean


class Trees:
    """The leaves of a model of weighted trees."""

    def __init__(self, leaves: list[tuple[float, list[Leaf]]]):
        self.leaves = leaves
        self.mean = sum(w * leaf.value * leaf.share.prod() for w, own in leaves for leaf in own)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for weight, own in self.leaves:
            for leaf in own:
                out += weight * leaf.value * leaf.keeps(x).all(1)
        return out

    def attributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for weight, own in self.leaves:
            for leaf in own:
                leaf.add(x, out, weight)
        return out


def trees_of(spark: SparkSession, model) -> Trees:
    """The trees of a fitted boosted model, from what it writes when saved: a row a node."""
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():  # bounded by number and depth of the trees
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    return Trees([(float(w), list(_leaves(nodes[k]))) for k, w in enumerate(model.treeWeights)])


def _leaves(nodes: dict[int, object]) -> Iterator[Leaf]:
    open_: list[tuple[int, list]] = [(0, [])]
    while open_:
        i, path = open_.pop()
        node = nodes[i]
        if node["leftChild"] < 0:
            yield Leaf(node["prediction"], path)
            continue
        split, f = node["split"]["leftCategoriesOrThreshold"], node["split"]["featureIndex"]
        rule = set(split) if node["split"]["numCategories"] >= 0 else split[0]
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            open_.append((child, [*path, (f, rule, left, nodes[child]["rawCount"] / node["rawCount"])]))


def attribute(rows: DataFrame, trees: Trees, names: list[str], id_col: str = "tx_id", features: str = "features") -> DataFrame:
    """(id, margin, mean, names): of each row the model's margin and the attribution of every feature, for which mean + attributions = margin."""
    base = rows.select(F.col(id_col).alias("_id"), vector_to_array(features).alias("_x"))
    kind = base.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(names))
            found = trees.attributions(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.margin(x)), pa.array(np.full(len(x), trees.mean)), *(pa.array(found[:, i]) for i in range(len(names)))], ["_id", "margin", "mean", *names])

    schema = ", ".join([f"_id {kind}", "margin double", "mean double", *(f"`{n}` double" for n in names)])
    return base.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
