"""Groups of accounts at every risk threshold at once: a tree of merges instead of components for each cut.

Boruvka rounds over the edges of greatest risk: every group takes its riskiest edge to another group, groups that are joined so become one, and
the tree notes for each group its new group and the risk of the edge that it took. There are as many levels as rounds, which are logarithmic in the number of accounts.
Two accounts are in one group at a cut exactly if all edges of the tree between them have at least that risk: the least of these is the least risk on
the best path between the two in the graph. So the groups of each account at all levels, a row an account, give each pair the highest cut that leaves it together, and
what holds at every cut follows by running sums over these, for any number of different risks.

Risks may be any numbers but null; self loops and edges with null ends join nothing; of repeated edges the greatest risk counts. Equal risks merge in any order with the same groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalar import objective
from cairn.operators.components import merged
from cairn.operators.relational import global_row_number, metrics, running_totals
from cairn.operators.scratch import Growing, hashed, materialise


def merge_tree(edges: DataFrame) -> DataFrame:
    """(level, id, parent, risk): of each group with an edge to another, by level from single accounts on, the group that it merges into and the risk of the edge taken.

    ``edges`` are (src, dst, risk); groups are named by their least account.
    """
    kind = dict(edges.dtypes)["src"]
    tree = Growing(edges.sparkSession, f"level int, id {kind}, parent {kind}, risk double", "merges")
    links = edges.filter("src <> dst AND risk IS NOT NULL").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("risk").cast("double").alias("risk"))
    links = materialise(links.groupBy("a", "b").agg(F.max("risk").alias("risk")), "links")
    links, level = materialise(global_row_number(links, ["risk", "a", "b"], "i"), "links"), 0
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("id"), F.col("b").alias("to"), "i", "risk").union(links.select("b", "a", "i", "risk"))
        pick = materialise(ends.groupBy("id").agg(F.max_by("to", "i").alias("to"), F.max("risk").alias("risk")), "picked")
        groups = merged(pick)
        tree.add(pick.join(hashed(groups), "id").select(F.lit(level).alias("level"), "id", F.col("component").alias("parent"), "risk"))
        at = lambda end: hashed(groups.select(F.col("id").alias(end), F.col("component").alias(f"{end}_group")))  # noqa: E731, B023
        moved = links.join(at("a"), "a").join(at("b"), "b").filter("a_group <> b_group").select(F.col("a_group").alias("a"), F.col("b_group").alias("b"), "i", "risk")
        links, level = materialise(moved, "links"), level + 1
    return tree.read()


def _levels(tree: DataFrame) -> int:
    return (tree.agg(F.max("level").alias("n")).first()["n"] or 0) + 1


def _ancestors(tree: DataFrame) -> tuple[DataFrame, int]:
    """((id, g1, m1, g2, m2, ..), levels): of every account of the tree the group that it is in after each level, and the least risk of the edges taken on the way there.

    Found from the last level down, so that each level's groups are joined once.
    """
    levels, up = _levels(tree), None
    for level in range(levels - 1, -1, -1):
        own = tree.filter(F.col("level") == level).select("id", F.col("parent").alias(f"g{level + 1}"), F.col("risk").alias(f"m{level + 1}"))
        if up is not None:
            near, risk = F.col(f"g{level + 1}"), F.col(f"m{level + 1}")
            further = [c for k in range(level + 2, levels + 1) for c in (F.coalesce(f"g{k}", near).alias(f"g{k}"), F.least(risk, f"m{k}").alias(f"m{k}"))]
            own = own.join(up.withColumnRenamed("id", f"g{level + 1}"), f"g{level + 1}", "left").select("id", near, risk, *further)
        up = materialise(own, "ancestors")
    return up, levels


def _with_cut(rows: DataFrame, tree: DataFrame, src: str, dst: str) -> DataFrame:
    """The rows with ``cut``, the highest threshold at which the accounts src and dst are in one group: after the first level that has both in one, the least risk that either met."""
    up, levels = _ancestors(tree)
    at = lambda end, mark: hashed(up.select(F.col("id").alias(end), *(F.col(f"{c}{k}").alias(f"_{mark}_{c}{k}") for k in range(1, levels + 1) for c in "gm")))
    met = [F.when(F.col(f"_a_g{k}") == F.col(f"_b_g{k}"), F.least(f"_a_m{k}", f"_b_m{k}")) for k in range(1, levels + 1)]
    cut = F.when(F.col(src) == F.col(dst), F.lit(float("inf"))).otherwise(F.coalesce(*met))
    return rows.join(at(src, "a"), src, "left").join(at(dst, "b"), dst, "left").select(*rows.columns, cut.alias("cut"))


def last_cut(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, cut) of the distinct pairs: the highest threshold at which both are in one group; infinity for an account and itself, null where no edges lead from one to the other."""
    return _with_cut(pairs.select("src", "dst").distinct(), tree, "src", "dst")


def groups_at(tree: DataFrame, vertices: DataFrame, cut: float) -> DataFrame:
    """(id, component) of the ids of ``vertices`` when only edges of risk ``cut`` or more join them; a group is named by its least account among them."""
    rows = vertices.select("id").distinct().select("id", F.col("id").alias("node"), F.lit(0).alias("height"))
    for level in range(_levels(tree)):
        own = tree.filter((F.col("level") == level) & (F.col("risk") >= cut)).select(F.col("id").alias("node"), "parent")
        on = F.col("parent").isNotNull() & (F.col("height") == level)  # who stops once stays
        rows = rows.join(own, "node", "left").select("id", F.when(on, F.col("parent")).otherwise(F.col("node")).alias("node"), F.when(on, level + 1).otherwise(F.col("height")).alias("height"))
    rows = materialise(rows, "groups-at")
    names = rows.groupBy("node", "height").agg(F.min("id").alias("component"))
    return rows.join(names, ["node", "height"]).select("id", "component")


def transfer_cuts(tx: DataFrame, tree: DataFrame) -> DataFrame:
    """The transfers with ``cut``, the highest threshold at which sender and receiver are in one group."""
    return _with_cut(tx, tree, "sender", "receiver")


def scores_by_cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """(threshold, tp, fp, tn, fn) at each of the thresholds (column risk) for rows (cut, is_laundering): a row counts as positive up to its cut."""
    by = rows.groupBy("cut").agg(F.count_if(F.col("is_laundering") == 1).alias("p"), F.count_if(F.col("is_laundering") == 0).alias("q"))
    every = materialise(cuts.select(F.col("risk").cast("double").alias("cut")).distinct().join(by, "cut", "full").na.fill(0, ["p", "q"]), "cuts")
    total = every.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    below = running_totals(every.filter("cut IS NOT NULL"), "cut", ["p", "q"])
    known = every.filter("cut IS NOT NULL").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    tp, fp = F.lit(known["p"] or 0) - F.col("below_p"), F.lit(known["q"] or 0) - F.col("below_q")
    found = below.select(F.col("cut").alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.lit(total["q"] or 0) - fp).alias("tn"), (F.lit(total["p"] or 0) - tp).alias("fn"))
    return found.join(cuts.select(F.col("risk").cast("double").alias("threshold")).distinct(), "threshold", "left_semi")


def threshold_scores(tx: DataFrame, edges: DataFrame) -> DataFrame:
    """(threshold, precision, recall, f1, objective) at every cut that the risks distinguish, and at infinity, where every account is alone."""
    rows = materialise(transfer_cuts(tx, merge_tree(edges)).select("is_laundering", "cut"), "transfer-cuts")
    cuts = edges.select("risk").filter("risk IS NOT NULL").distinct().unionByName(tx.sparkSession.createDataFrame([(float("inf"),)], "risk double"))
    return metrics(scores_by_cut(rows, cuts)).select("threshold", "precision", "recall", "f1", objective(F.col("recall"), F.col("f1")).alias("objective"))
