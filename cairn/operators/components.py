"""Connected components of an edge table, by contraction.

In each round every vertex points at the least vertex near its least neighbour, in an order drawn anew for the round, and one such step further; the
edges follow, and what falls together is dropped. So vertices and edges shrink by a constant factor a round whatever the ids and the shape,
rounds are logarithmic, and all rounds together take little more than the first. At the end the pointers are composed from the last round back to the first.
A minimum is a partial aggregate, so a hub's edges are combined before the shuffle; joins hash the side of one row a vertex and let the edges stream past it,
so that a hub's edges are never sorted or held. Rounds are written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.scratch import hashed, materialise

MAX_ROUNDS = 60


def _onward(pointers: DataFrame, further: DataFrame, to: str = "to") -> DataFrame:
    """(id, to): each pointer followed by the one that ``further`` (id, to) has for where it leads; it must have one."""
    return pointers.join(hashed(further.select(F.col("id").alias("to"), F.col(to).alias("z"))), "to").select("id", F.col("z").alias("to"))


def _pointers(links: DataFrame, round_: int) -> DataFrame:
    """(id, to) of every vertex of the links, in the order of the round: to its least neighbour, on to the least of that one and its neighbours, and once more so.

    A vertex below all its neighbours takes the first step too, so that what hangs on one hub falls together in a round; no vertex goes up in the order.
    """
    order = lambda c: F.xxhash64(F.lit(round_), F.col(c))
    both = links.select(F.col("u").alias("id"), F.col("v").alias("to")).union(links.select(F.col("v").alias("id"), F.col("u").alias("to")))
    near = both.withColumn("h", order("to")).groupBy("id").agg(F.min_by("to", "h").alias("to"), F.min("h").alias("h"))
    near = materialise(near.select("id", "to", F.when(order("id") < F.col("h"), F.col("id")).otherwise(F.col("to")).alias("least")), "pointers")
    two = materialise(_onward(near, near, "least"), "pointers")
    return materialise(_onward(two, two), "pointers")


def _moved(links: DataFrame, pointers: DataFrame) -> DataFrame:
    """The distinct links between different vertices after both ends have moved."""
    at = lambda end: hashed(pointers.select(F.col("id").alias(end), F.col("to").alias(f"{end}_to")))
    ends = links.join(at("u"), "u").join(at("v"), "v").filter("u_to <> v_to")
    return ends.select(F.greatest("u_to", "v_to").alias("u"), F.least("u_to", "v_to").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, component) of every vertex of the edges; a component is named by its least id.

    Null endpoints are ignored; a self loop makes a vertex of its own.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), (F.col(src).isNotNull() & F.col(dst).isNotNull()).alias("on"))
    pairs = materialise(pairs.filter("on").select("u", "v").distinct(), "pairs")
    links, rounds = pairs.filter("u <> v"), []
    while not links.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        rounds.append(_pointers(links, len(rounds)))
        links = materialise(_moved(links, rounds[-1]), "links")
    alone = pairs.filter("u = v").select(F.col("u").alias("id"), F.col("v").alias("component"))
    if not rounds:
        return alone
    # where the first pointers lead, and the least vertex that leads there
    held = rounds[0].groupBy(F.col("to").alias("id")).agg(F.min("id").alias("low"))
    last = None
    for pointers in reversed(rounds[1:]):
        further = pointers if last is None else pointers.join(hashed(last.select(F.col("id").alias("to"), F.col("to").alias("z"))), "to", "left").select("id", F.coalesce("z", "to").alias("to"))
        last = further
    if last is not None:
        held = held.join(hashed(last), "id", "left").select("id", "low", F.coalesce("to", "id").alias("to"))
        held = materialise(held, "held")
        held = held.join(hashed(held.groupBy("to").agg(F.min("low").alias("least"))), "to").select("id", F.col("least").alias("low"))
    names = materialise(_onward(rounds[0], held, "low").select("id", F.col("to").alias("component")), "components")
    return names.unionByName(alone.join(hashed(names.select("id")), "id", "left_anti"))


def merged(picked: DataFrame) -> DataFrame:
    """(id, component): the groups that pointers (id, to) join, one pointer an id, where the only cycles are pairs that point at each other; named by their least id.

    Boruvka's picks are so, since every group takes the first of its edges in one total order. The lesser of such a pair is the root, and pointers are doubled up to it.
    """
    far = lambda p: hashed(p.select(F.col("id").alias("to"), F.col("to").alias("z")))
    root = F.when(F.col("z") == F.col("id"), F.least("id", "to")).otherwise(F.col("to"))
    at, moved = materialise(picked.select("id", "to").join(far(picked), "to").select("id", root.alias("to")), "merging"), True
    while moved:
        step = materialise(at.join(far(at), "to").select("id", F.col("z").alias("to"), (F.col("z") != F.col("to")).alias("on")), "merging")
        at, moved = step.drop("on"), not step.filter("on").isEmpty()
    names = at.groupBy("to").agg(F.min("id").alias("component"))
    return materialise(at.join(hashed(names), "to").select("id", "component"), "merged")
