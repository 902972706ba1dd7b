"""Graph operators over edge tables: propagation, levels and risks of DAGs, temporal forests, tiers, walks.

Edges with a null end join nothing and are ignored; repeated edges count once unless the operator counts transfers; self loops are edges, and cycles.
Without edges results are empty. Ties go to the least id. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import edge_risk, hour_of, uniform
from cairn.operators.components import connected_components, merged
from cairn.operators.relational import Chain, chunked, global_row_number
from cairn.operators.scratch import Growing, bucketed, hashed, materialise, sided


#: Levels of a tree of seals that are made, or walked, at once, within groups of 2^STRIDE nodes.
STRIDE = 10
#: Pivots whose searches share a row.
LANES = 16


def sources_of(edges: DataFrame) -> DataFrame:
    """(id) of vertices with an outgoing edge and no incoming one."""
    return edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def sinks_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def frontier(edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """(id, component): one step of labels along the edges."""
    step = edges.join(labelled.select(F.col("id").alias("src"), "component"), "src").select(F.col("dst").alias("id"), "component")
    return step.groupBy("id").agg(F.min("component").alias("component"))


def propagate(edges: DataFrame, seed: str = "source", rounds: int = 3) -> DataFrame:
    """(id, component) after ``rounds`` steps from the seeds: vertices without incoming (source) or outgoing (sink) edges."""
    start = sources_of(edges) if seed == "source" else sinks_of(edges)
    labelled = start.select("id", F.col("id").alias("component"))
    for _ in range(rounds):
        both = labelled.unionByName(frontier(edges, labelled))
        labelled = materialise(both.groupBy("id").agg(F.min("component").alias("component")), "propagated")
    return labelled


def propagate_chain(chain: Chain, seed: str = "source", rounds: int = 3) -> DataFrame:
    """``propagate`` over the temporal chain, without its pairs."""
    start = chain.ends().filter("has_out AND NOT has_in" if seed == "source" else "has_in AND NOT has_out")
    labelled = materialise(start.select("id", F.col("id").alias("component")), "propagated")
    for _ in range(rounds):
        step = chain.forward(labelled.select("id", F.col("component").alias("v"))).select("id", F.col("v").alias("component"))
        labelled = materialise(labelled.unionByName(step).groupBy("id").agg(F.min("component").alias("component")), "propagated")
    return labelled


def relax(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, level, risk) of every vertex of a DAG: edges on the longest path to it, and the greatest sum of weights of a path from a source to it.

    A vertex is the greater of a constant, from its settled predecessors, and of what its open ones will give. In each phase all vertices with one open
    predecessor are jumped over by doubling, up to a settled vertex or one with several, and the edges and constants of those behind follow them. In a forest the vertices
    with several open predecessors are halved by each phase, so rounds grow with the square of the logarithm of the vertices; in any DAG phases are at most the joins
    on the longest path. A cycle raises an error. Edges with a null end are ignored.
    """
    spark, long = edges.sparkSession, "long"
    own = edges.select("src", "dst", (F.col(weight) if weight else F.lit(0.0)).cast("double").alias("w")).filter("src IS NOT NULL AND dst IS NOT NULL")
    own = materialise(own.groupBy("src", "dst").agg(F.lit(1).cast(long).alias("hops"), F.max("w").alias("w")), "edges")
    done = Growing(spark, f"id {dict(own.dtypes)['src']}, level long, risk double", "done")
    done.add(sources_of(own).select("id", F.lit(0).cast(long).alias("level"), F.lit(0.0).alias("risk")))
    settled, hung = done.read(), []
    nodes = materialise(own.select(F.col("dst").alias("id"), F.lit(None).cast(long).alias("level"), F.lit(None).cast("double").alias("risk")).distinct(), "open-vertices")
    while True:
        # settled ends of edges become constants
        ends = own.join(settled.select(F.col("id").alias("src"), F.col("level").alias("l"), F.col("risk").alias("r")), "src", "left")
        rows = nodes.select("id", "level", "risk", F.lit(0).cast(long).alias("open")).unionByName(
            ends.select(F.col("dst").alias("id"), (F.col("l") + F.col("hops")).alias("level"), (F.col("r") + F.col("w")).alias("risk"), F.col("l").isNull().cast(long).alias("open")))
        nodes = materialise(rows.groupBy("id").agg(F.max("level").alias("level"), F.max("risk").alias("risk"), F.sum("open").alias("open")), "open-vertices")
        own = materialise(own.join(settled.select(F.col("id").alias("src")), "src", "left_anti"), "open-edges")
        ready = nodes.filter("open = 0").select("id", "level", "risk")
        single = own.join(nodes.filter("open = 1").select(F.col("id").alias("dst"), "level", "risk"), "dst")
        jump = materialise(single.select(F.col("dst").alias("id"), F.col("src").alias("to"), "hops", "w", "level", "risk"), "jump")
        n, reach, moved = jump.count(), 1, True
        if not n and ready.isEmpty():
            if nodes.isEmpty():
                break
            raise ValueError("the graph has a cycle")
        while n and moved:
            far = jump.select(F.col("id").alias("to"), F.col("to").alias("z"), F.col("hops").alias("h"), F.col("w").alias("v"), F.col("level").alias("l"), F.col("risk").alias("r"))
            step = jump.join(far, "to", "left").select("id", F.coalesce("z", "to").alias("to"), (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"), (F.col("w") + F.coalesce("v", F.lit(0.0))).alias("w"),
                F.greatest("level", F.col("l") + F.col("hops")).alias("level"), F.greatest("risk", F.col("r") + F.col("w")).alias("risk"), F.col("z").isNotNull().alias("on"))
            jump = materialise(step, "jump")
            moved, jump, reach = not jump.filter("on").isEmpty(), jump.drop("on"), 2 * reach
            if moved and reach > 2 * n:
                raise ValueError("the graph has a cycle")
        # of the rest, edges from a single vertex start where it hangs, and leave its constant
        rest = materialise(nodes.filter("open > 1").select("id", "level", "risk"), "joins")
        ahead = own.join(rest.select(F.col("id").alias("dst")), "dst", "left_semi").join(jump.select(F.col("id").alias("src"), "to", F.col("hops").alias("h"), F.col("w").alias("v"), "level", "risk"), "src", "left")
        ahead = materialise(ahead.select(F.coalesce("to", "src").alias("src"), "dst", (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"), (F.col("w") + F.coalesce("v", F.lit(0.0))).alias("w"), (F.col("level") + F.col("hops")).alias("level"), (F.col("risk") + F.col("w")).alias("risk")), "ahead")
        hung.append(jump)
        done.add(ready)
        constants = ahead.filter("level IS NOT NULL").select(F.col("dst").alias("id"), "level", "risk")
        nodes = rest.unionByName(constants)
        own = ahead.groupBy("src", "dst").agg(F.max("hops").alias("hops"), F.max("w").alias("w"))
        settled = ready
    for jump in reversed(hung):  # what a vertex hung on was settled later, or hung in a later phase
        found = jump.join(done.read().select(F.col("id").alias("to"), F.col("level").alias("l"), F.col("risk").alias("r")), "to")
        done.add(materialise(found.select("id", F.greatest("level", F.col("l") + F.col("hops")).alias("level"), F.greatest("risk", F.col("r") + F.col("w")).alias("risk")), "settled"))
    return done.read()


def is_dag(edges: DataFrame) -> bool:
    """Has the graph no cycle? Then peeling leaves no edge; a self loop is a cycle, an empty graph has none."""
    return edges.filter("src = dst").isEmpty() and cycle_core(edges).isEmpty()


def cycle_core(edges: DataFrame) -> DataFrame:
    """The edges between different vertices that are left after vertices without incoming or without outgoing edges are peeled off: every longer cycle is among them.

    Stretches of vertices with one edge in and one out stand or fall as one, so they are jumped over by doubling first; then each round peels from both sides.
    """
    left = materialise(edges.filter("src <> dst").select("src", "dst").distinct(), "core")
    while True:
        into = left.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
        out = left.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
        degree = materialise(into.join(out, "id", "full").na.fill(0, ["i", "o"]), "core-degrees")
        bare = degree.filter("i = 0 OR o = 0").select("id")
        if bare.isEmpty():
            return left.select("src", "dst")
        gone = materialise(_stretches(left, degree, bare), "peeled")
        left = materialise(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), "core")


def followed(pointers: DataFrame) -> DataFrame:
    """(back, id, to, on): pointers (back, id, to), one a key (back, id), doubled until they lead where none leads on; ``on`` are those that never end, since they run in rings.

    A round ends the pointers of up to twice as many steps as the one before. There are pointers of every length up to the longest, so when a round ends none, those left are in
    rings: rounds are the logarithm of the longest stretch, not of the number of pointers. Both directions are doubled at once.
    """
    jump = materialise(pointers.select("back", "id", "to", F.lit(True).alias("on")), "stretch")
    left, before = jump.count(), None
    while left and left != before:
        far = jump.select("back", F.col("id").alias("to"), F.col("to").alias("z"))
        jump = materialise(jump.select("back", "id", "to").join(far, ["back", "to"], "left").select("back", "id", F.coalesce("z", "to").alias("to"), F.col("z").isNotNull().alias("on")), "stretch")
        left, before = jump.filter("on").count(), left
    return jump


def _stretches(edges: DataFrame, degree: DataFrame, bare: DataFrame) -> DataFrame:
    """(id): the bare vertices and all that hang on them by a stretch: with one edge in, from a peeled vertex, or one out, to a peeled one."""
    one = lambda count, near, far: edges.join(degree.filter(F.col(count) == 1).select(F.col("id").alias(near)), near).select(F.lit(count == "i").alias("back"), F.col(near).alias("id"), F.col(far).alias("to"))
    jump = followed(one("i", "dst", "src").union(one("o", "src", "dst")))
    roots = degree.filter("i = 0").select(F.lit(True).alias("back"), F.col("id").alias("to")).union(degree.filter("o = 0").select(F.lit(False), "id"))
    return bare.union(jump.join(roots, ["back", "to"], "left_semi").select("id")).distinct()


def temporal_forest(tx: DataFrame) -> DataFrame:
    """(tx_id) of the transfers that a scan in order of time keeps because they join two unconnected accounts.

    This is the minimum spanning forest under the weight (epoch, tx_id), found in Boruvka rounds: every group of
    accounts takes its earliest edge to another group. The edges are numbered once, so that a pick is a least number, combined before the shuffle.
    """
    own = tx.filter("sender <> receiver").select("tx_id", "epoch", F.col("sender").alias("a"), F.col("receiver").alias("b"))
    edges = materialise(global_row_number(own, ["epoch", "tx_id"], "i").select("tx_id", "i", "a", "b"), "forest-edges")
    kept: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("to"), "i", "tx_id").union(edges.select("b", "a", "i", "tx_id"))
        pick = materialise(ends.groupBy("id").agg(F.min_by("to", "i").alias("to"), F.min_by("tx_id", "i").alias("tx_id")), "picked")
        kept.append(pick.select("tx_id"))
        labels = merged(pick)
        at = lambda end: hashed(labels.select(F.col("id").alias(end), F.col("component").alias(f"{end}_label")))  # noqa: E731, B023
        edges = edges.join(at("a"), "a").join(at("b"), "b").filter("a_label <> b_label")
        edges = materialise(edges.select("tx_id", "i", F.col("a_label").alias("a"), F.col("b_label").alias("b")), "forest-edges")
    return reduce(DataFrame.unionByName, kept).distinct() if kept else tx.select("tx_id").filter(F.lit(False))


def walks_to_sinks(successor: DataFrame) -> DataFrame:
    """(id, sink, hops) by pointer doubling over an acyclic successor function; a cycle raises an error."""
    jump = materialise(successor.select(F.col("src").alias("id"), F.col("dst").alias("sink"), F.lit(1).cast("long").alias("hops")), "jump")
    n, reach = jump.count(), 1
    while True:
        if reach > 2 * n + 1:
            raise ValueError("the successors have a cycle")
        far = jump.select(F.col("id").alias("sink"), F.col("sink").alias("z"), F.col("hops").alias("more"))
        step = jump.join(far, "sink", "left")
        jump = materialise(step.select("id", F.coalesce("z", "sink").alias("sink"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("z").isNotNull().alias("moved")), "jump")
        moved = not jump.filter("moved").isEmpty()
        jump = jump.drop("moved")
        if not moved:
            return jump
        reach *= 2


def best_predecessor(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): every vertex with the predecessor of greatest risk (columns id, risk of ``nodes``), the least id of equals."""
    scored = edges.select("src", "dst").join(nodes.select(F.col("id").alias("src"), "risk"), "src")
    return scored.groupBy("dst").agg(F.max_by("src", F.struct("risk", -F.col("src"))).alias("to")).select(F.col("dst").alias("src"), F.col("to").alias("dst"))


def chain_predecessor(chain: Chain, nodes: DataFrame) -> DataFrame:
    """(src, dst): every transfer with its predecessor in the chain of greatest risk (columns id, risk of ``nodes``), the least id of equals."""
    values = nodes.select("id", F.struct("risk", (-F.col("id")).alias("m")).alias("v"))
    return chain.forward(values, F.max, F.greatest).select(F.col("id").alias("src"), (-F.col("v.m")).alias("dst"))


def trace(successor: DataFrame, start: DataFrame) -> DataFrame:
    """(start, id, hops): the walks from the ids of ``start`` along an acyclic successor function (src, dst).

    Round k holds the first 2^k vertices of each walk and adds as many by jumps of 2^k steps, so rounds are logarithmic in the longest. A cycle that a walk enters raises an error.
    """
    jump = materialise(successor.select("src", "dst"), "jump")
    n = jump.count()
    path, span = materialise(start.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("hops")), "trace"), 1
    while True:
        step = materialise(path.join(jump, path["id"] == jump["src"]).select("start", F.col("dst").alias("id"), (F.col("hops") + span).alias("hops")), "trace")
        if step.isEmpty():
            return path
        if span > n:
            raise ValueError("the successors have a cycle")
        path = path.unionByName(step)
        jump = materialise(jump.join(jump.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")), "jump")
        span *= 2


def walk_accounts(walks: DataFrame, tx: DataFrame) -> DataFrame:
    """(account): senders and receivers of the transfers (column id) of walks."""
    own = tx.join(walks.select(F.col("id").alias("tx_id")).distinct(), "tx_id", "left_semi")
    return own.select(F.col("sender").alias("account")).union(own.select("receiver")).distinct()


def set_metrics(predicted: DataFrame, actual: DataFrame, key: str = "account", epsilon: float = 1e-9) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of two sets; ``epsilon`` is added to the denominators, so empty sets give 0."""
    both = predicted.select(key).distinct().withColumn("p", F.lit(1)).join(actual.select(key).distinct().withColumn("a", F.lit(1)), key, "full")
    counts = both.agg(F.count_if(F.expr("p = 1 AND a = 1")).alias("tp"), F.count_if(F.expr("p = 1 AND a IS NULL")).alias("fp"), F.count_if(F.expr("p IS NULL AND a = 1")).alias("fn"))
    ratios = counts.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp") + epsilon), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + epsilon)})
    return ratios.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + epsilon))


def account_edges(tx: DataFrame) -> DataFrame:
    """(src, dst, risk): distinct account pairs with the risk of their latest transfer."""
    scored = tx.withColumn("risk", edge_risk(F.col("is_laundering"), F.col("amount"), hour_of(F.col("epoch"))))
    return scored.groupBy(F.col("sender").alias("src"), F.col("receiver").alias("dst")).agg(F.max_by("risk", F.struct("epoch", "tx_id")).alias("risk"))


def risk_components(edges: DataFrame, threshold: float) -> DataFrame:
    """Account groups joined by the edges at or above the threshold; other accounts are groups of their own."""
    vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    joined = connected_components(edges.filter(F.col("risk") >= threshold))
    return vertices.join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def group_shape(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, n, n_sources, n_sinks): vertices, and those without incoming and without outgoing edges."""
    out = edges.select(F.col("src").alias("id"), F.lit(1).alias("o")).distinct()
    into = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i")).distinct()
    return components.join(out, "id", "left").join(into, "id", "left").groupBy("component").agg(F.count("*").alias("n"), F.count_if(F.col("i").isNull()).alias("n_sources"), F.count_if(F.col("o").isNull()).alias("n_sinks"))


def tiers_independent(shape: DataFrame) -> DataFrame:
    """One flag a tier; a group may have several."""
    s, z, n = F.col("n_sources"), F.col("n_sinks"), F.col("n")
    return shape.select("*", ((s <= 3) & (z >= 10)).alias("high"), ((s == 0) | (z == 0)).alias("severed"), ((s <= 5) & (z <= 5) & (n >= 15)).alias("medium"))


def tiers_exclusive(shape: DataFrame) -> DataFrame:
    s, z = F.col("n_sources"), F.col("n_sinks")
    tier = F.when((s == 0) & (z >= 10), "severed").when((s <= 3) & (z >= 10), "high").when((s <= 3) & (z <= 3), "medium").otherwise("low")
    return shape.select("*", tier.alias("tier"))


def same_group(tx: DataFrame, components: DataFrame) -> DataFrame:
    """tx_id, is_laundering, predicted: 1 if sender and receiver are in one group."""
    at = lambda end: components.select(F.col("id").alias(end), F.col("component").alias(f"{end}_group"))
    rows = tx.join(at("sender"), "sender", "left").join(at("receiver"), "receiver", "left")
    return rows.select("tx_id", "is_laundering", F.coalesce(F.col("sender_group") == F.col("receiver_group"), F.lit(False)).cast("int").alias("predicted"))


def tabu_search(scores: list[tuple[float, ...]], start: float = 1.5, step: float = 0.2, low: float = 0.1, high: float = 3.0, memory: int = 5, rounds: int = 20) -> list[tuple]:
    """(threshold, precision, recall, f1, objective, best threshold so far) of every step.

    ``scores`` are (cut, precision, recall, f1, objective); a threshold acts as the least cut at or above it. A step goes to the best of the threshold
    below, the present one and the one above that was not taken in the last ``memory`` steps, the lower of equals; the search ends where none is left.
    """
    table = sorted(scores)
    value = lambda x: next((v[1:] for v in table if v[0] >= x - 1e-9), (0.0, 0.0, 0.0, 0.0))
    at, best, recent, path = start, (0.0, start), [], []
    for _ in range(rounds):
        near = [x for x in (round(at + d, 6) for d in (-step, 0.0, step)) if low <= x <= high and x not in recent]
        if not near:
            break
        at = max(near, key=lambda x: (value(x)[3], -x))
        best = max(best, (value(at)[3], at), key=lambda b: b[0])
        path.append((at, *value(at), best[1]))
        recent = [*recent, at][-memory:]
    return path


def monte_carlo(edges: DataFrame, components: DataFrame, walks: int = 100, steps: int = 4, seed: int = 7) -> DataFrame:
    """(component, id, visits, rate): seeded walks within groups, along edges (src, dst, epoch) that come later than the last one."""
    members = edges.select(F.col("src").alias("id")).distinct().join(components, "id")
    inner = edges.join(components.select(F.col("id").alias("src"), "component"), "src").join(components.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst").filter("component = c2").select("src", "dst", "epoch")
    draw = lambda *key: uniform(seed, *(k.cast("string") for k in key))
    walkers = members.select("component", "id").withColumn("w", F.explode(F.sequence(F.lit(1), F.lit(walks))))
    at = walkers.groupBy("component", "w").agg(F.min_by("id", F.struct(draw(F.col("w"), F.col("id")), "id")).alias("id")).withColumn("t", F.lit(None).cast("long"))
    at = materialise(at, "walkers")
    seen = [at.select("component", "id")]
    for k in range(steps):
        moves = at.join(inner, at["id"] == inner["src"]).filter("t IS NULL OR epoch > t")
        pick = F.min_by(F.struct("dst", "epoch"), F.struct(draw(F.lit(k), F.col("component"), F.col("w"), F.col("dst"), F.col("epoch")), "dst", "epoch"))
        at = materialise(moves.groupBy("component", "w").agg(pick.alias("m")).select("component", "w", F.col("m.dst").alias("id"), F.col("m.epoch").alias("t")), "walkers")
        seen.append(at.select("component", "id"))
    visits = reduce(DataFrame.unionByName, seen).groupBy("component", "id").agg(F.count("*").alias("visits"))
    total = visits.groupBy("component").agg(F.sum("visits").alias("total"))
    return visits.join(total, "component").select("component", "id", "visits", (F.col("visits") / F.col("total")).alias("rate"))


def ranked_edges(edges: DataFrame) -> DataFrame:
    """(src, rank, dst, epoch, passed, degree) of edges (src, dst, epoch, tx_id): the place of each among its source's in order of time, then id, how many edges of its target are not later than it, and how many the target has.

    All are running counts over the accounts' edges in and out, in chunks of one total order, so a busy account is the work of many tasks.
    """
    kind = F.lit(0)
    out = edges.select(F.col("src").alias("account"), "epoch", kind.alias("kind"), "tx_id", "dst")
    into = edges.select(F.col("dst").alias("account"), "epoch", (kind + 1).alias("kind"), "tx_id", F.lit(None).cast(dict(edges.dtypes)["dst"]).alias("dst"))
    order = ["account", "epoch", "kind", "tx_id"]
    parts = chunked(out.unionByName(into), order, "edge-ends")
    sends = F.when(F.col("kind") == 0, 1).otherwise(0)
    sums = parts.groupBy("_p").agg(F.sum(sends).alias("n"))  # a row a chunk
    offset = sums.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("o"))
    counted = parts.join(F.broadcast(offset), "_p").withColumn("c", F.sum(sends).over(Window.partitionBy("_p").orderBy(*order)) + F.col("o"))
    counted = materialise(counted.select("account", "epoch", "kind", "tx_id", "dst", "c"), "edge-ranks")
    by = counted.groupBy("account").agg(F.min(F.col("c") - sends).alias("base"), F.max("c").alias("top"))
    rows = materialise(counted.join(by, "account").select("*", (F.col("c") - F.col("base")).alias("rank"), (F.col("top") - F.col("base")).alias("degree")), "edge-ranks")
    arrived = rows.filter("kind = 1").select("tx_id", F.col("rank").alias("passed"), "degree")
    return rows.filter("kind = 0").select(F.col("account").alias("src"), "rank", "dst", "epoch", "tx_id").join(arrived, "tx_id").select("src", "rank", "dst", "epoch", "passed", "degree")


def ranked_walks(edges: DataFrame, components: DataFrame, walks: int = 100, steps: int = 4, seed: int = 7) -> DataFrame:
    """(component, id, visits, rate): ``monte_carlo``'s walks, drawn by rank: along edges (src, dst, epoch, tx_id) within groups that come later than the last one, all of them equally likely.

    A walker's edges are the end of its account's list in order of time. It draws a place in that end and looks the edge up, so a step takes as many rows as walkers,
    whatever the degree of an account. A walk starts at a member with edges, drawn by its place among them. Where a group's only such member has no edge within the group,
    all its walks end where they start, and they are counted without being drawn.
    """
    at = lambda end: components.select(F.col("id").alias(end), F.col("component").alias(f"{end}_group"))
    inner = edges.join(at("src"), "src").join(at("dst"), "dst").filter("src_group = dst_group").select("src", "dst", "epoch", "tx_id")
    table = materialise(ranked_edges(inner), "ranked-edges")
    degree = inner.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    own = edges.select(F.col("src").alias("id")).distinct().join(components, "id").join(degree, "id", "left").select("component", "id", F.coalesce("degree", F.lit(0)).alias("degree"))
    sized = materialise(global_row_number(own, ["component", "id"], "place"), "members")
    bounds = materialise(sized.groupBy("component").agg(F.min("place").alias("lo"), F.count("*").alias("n"), F.max("degree").alias("most"), F.min("id").alias("id")), "groups")
    draw = lambda *key: uniform(seed, *(k.cast("string") for k in key))
    drawn = bounds.filter("n > 1 OR most > 0").withColumn("w", F.explode(F.sequence(F.lit(1), F.lit(walks))))
    start = drawn.withColumn("place", F.col("lo") + F.floor(draw(F.col("component"), F.col("w")) * F.col("n"))).select("component", "w", "place")
    walkers = start.join(sized.select("id", "place", "degree"), "place").select("component", "w", "id", F.lit(0).cast("long").alias("passed"), "degree")
    walkers = materialise(walkers, "walkers")
    seen = [walkers.select("component", "id")]
    for k in range(steps):
        left = F.col("degree") - F.col("passed")
        rank = F.col("passed") + 1 + F.floor(draw(F.lit(k), F.col("component"), F.col("w")) * left)
        move = walkers.filter(left > 0).select("component", "w", F.col("id").alias("src"), rank.alias("rank"))
        walkers = materialise(move.join(table, ["src", "rank"]).select("component", "w", F.col("dst").alias("id"), "passed", "degree"), "walkers")
        seen.append(walkers.select("component", "id"))
    still = bounds.filter("n = 1 AND most = 0").select("component", "id", F.lit(walks).cast("long").alias("visits"))
    visits = materialise(reduce(DataFrame.unionByName, seen).groupBy("component", "id").agg(F.count("*").alias("visits")).unionByName(still), "visits")
    total = visits.groupBy("component").agg(F.sum("visits").alias("total"))
    return visits.join(total, "component").select("component", "id", "visits", (F.col("visits") / F.col("total")).alias("rate"))


def account_columns(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(id, degree, group_node_count, group_edge_count, group_bidirect_ratio) over distinct directed pairs; degree counts distinct neighbours."""
    pairs = edges.select("src", "dst").distinct()
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    both = pairs.filter("src <> dst").union(pairs.filter("src <> dst").select("dst", "src")).distinct()
    degree = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    nodes = components.groupBy("component").agg(F.count("*").alias("group_node_count"))
    own = pairs.join(back, ["src", "dst"], "left").join(components.withColumnRenamed("id", "src"), "src")
    ties = own.groupBy("component").agg(F.count("*").alias("group_edge_count"), (F.count("back") / F.count("*")).alias("group_bidirect_ratio"))
    return components.join(degree, "id", "left").join(nodes, "component").join(ties, "component", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), "group_node_count", F.coalesce("group_edge_count", F.lit(0)).alias("group_edge_count"), F.coalesce("group_bidirect_ratio", F.lit(0.0)).alias("group_bidirect_ratio"))


def smoothed_features(edges: DataFrame, features: DataFrame, names: list[str], hops: int = 2) -> DataFrame:
    """Features averaged over ``hops`` hops by the symmetrically normalised adjacency with self loops (simplified graph convolution)."""
    vertices = features.select("id")
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").union(vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    norm = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("w"))
    norm = materialise(norm, "adjacency")
    for _ in range(hops):
        step = norm.join(features.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in names))
        features = materialise(step, "smoothed")
    return features


def _undirected(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(both directions of the distinct edges between different vertices, all vertices)."""
    edges = materialise(edges.select("src", "dst"), "pairs")
    both = materialise(edges.filter("src <> dst").select("src", "dst").union(edges.filter("src <> dst").select("dst", "src")).distinct(), "undirected")
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).filter("id IS NOT NULL")
    return both, materialise(ends.distinct(), "vertices")


def _pivots(vertices: DataFrame, pivots: int, seed: int) -> DataFrame:
    """(id): the vertices of least hash."""
    return vertices.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), "id").limit(pivots)


def pivot_closeness(edges: DataFrame, pivots: int = 16, seed: int = 42) -> DataFrame:
    """(id, reached, distance, closeness): of every account, the pivots that it reaches in the undirected graph, the sum of its distances to them, and their ratio (0 without one).

    Closeness to all accounts takes a search from each; these are searches from ``pivots`` accounts of least hash, all at once, one join a step.
    """
    both, vertices = _undirected(edges)
    kind = dict(vertices.dtypes)["id"]
    near = Growing(edges.sparkSession, f"start {kind}, id {kind}, d long", "distances")
    front = materialise(_pivots(vertices, pivots, seed).select(F.col("id").alias("start"), "id"), "front")
    d = 0
    while not front.isEmpty():
        near.add(front.select("start", "id", F.lit(d).cast("long").alias("d")))
        step = front.join(both, front["id"] == both["src"]).select("start", F.col("dst").alias("id")).distinct()
        front, d = materialise(step.join(near.read(), ["start", "id"], "left_anti"), "front"), d + 1
    sums = near.read().filter("d > 0").groupBy("id").agg(F.count("*").alias("reached"), F.sum("d").alias("distance"))
    return vertices.join(sums, "id", "left").na.fill(0, ["reached", "distance"]).withColumn("closeness", F.when(F.col("distance") > 0, F.col("reached") / F.col("distance")).otherwise(0.0))


def pivot_betweenness(edges: DataFrame, pivots: int = 16, seed: int = 42) -> DataFrame:
    """(id, betweenness): how many shortest paths of the undirected graph lead through each account, by searches from ``pivots`` accounts of least hash.

    Forward, all pivots at once, each level holds its vertices with the number of shortest paths to them. Backward, level by level, a vertex gets from
    each one beyond it the share of its paths that pass here, times 1 and what that one has itself. Sums are scaled from the pivots to all
    accounts, and halved, since a path has two ends; with all accounts as pivots they are exact. A row holds a vertex for ``LANES`` pivots, a column each, 0 where its pivot's level is another,
    so an edge is met once a level and not once a level and pivot. Neighbours of a level lie in it or beside it, so only two levels are held against the next.
    """
    both, vertices = _undirected(edges)
    both = bucketed(both, "src", "undirected")
    kind, n = dict(vertices.dtypes)["id"], vertices.count()
    lanes = [f"p{i}" for i in range(min(LANES, max(1, pivots)))]
    mask = reduce(lambda x, y: x.bitwiseOR(y), (F.when(F.col(c) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(lanes)))
    some = reduce(lambda x, y: x | y, (F.col(c) > 0 for c in lanes))
    place = F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), "id")) - 1  # of the pivots alone
    start = _pivots(vertices, pivots, seed).withColumn("k", place)
    start = start.select(F.floor(F.col("k") / len(lanes)).cast("int").alias("g"), "id", *(F.when(F.col("k") % len(lanes) == i, 1.0).otherwise(0.0).alias(c) for i, c in enumerate(lanes)))
    levels, front = [], materialise(start, "front")
    while not front.isEmpty():
        levels.append(front)
        met = sided(front.withColumnRenamed("id", "src"), front.count()).join(both, "src").select("g", F.col("dst").alias("id"), *lanes, F.lit(0).alias("seen"))
        known = reduce(DataFrame.unionByName, levels[-2:]).select("g", "id", *(F.lit(0.0).alias(c) for c in lanes), mask.alias("seen"))
        step = met.unionByName(known).groupBy("g", "id").agg(*(F.sum(c).alias(c) for c in lanes), F.bit_or("seen").alias("seen"))
        fresh = step.select("g", "id", *(F.when(F.col("seen").bitwiseAND(F.lit(1 << i)) == 0, F.col(c)).otherwise(0.0).alias(c) for i, c in enumerate(lanes)))
        front = materialise(fresh.filter(some), "front")
    shares = Growing(edges.sparkSession, f"id {kind}, share double", "shares")
    beyond = None  # (g, src, lanes): what each vertex of the level beyond gives for each path of a vertex before it
    for level in range(len(levels) - 1, 0, -1):
        here = levels[level]
        if beyond is not None:
            back = sided(beyond, levels[level + 1].count()).join(both, "src").groupBy("g", F.col("dst").alias("id")).agg(*(F.sum(c).alias(f"b_{c}") for c in lanes))
            here = here.join(back, ["g", "id"], "left")
        part = lambda c: F.coalesce(F.col(f"b_{c}"), F.lit(0.0)) if beyond is not None else F.lit(0.0)  # noqa: E731, B023
        own = here.select("g", "id", reduce(lambda x, y: x + y, (F.col(c) * part(c) for c in lanes)).alias("share"), *(F.when(F.col(c) > 0, 1 / F.col(c) + part(c)).otherwise(0.0).alias(c) for c in lanes))  # (1 + paths * part) / paths
        own = materialise(own, "shares")
        shares.add(own.select("id", "share"))
        beyond = own.drop("share").withColumnRenamed("id", "src")
    sums = shares.read().groupBy("id").agg(F.sum("share").alias("s"))
    return vertices.join(sums, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) * (n / (2.0 * max(1, min(pivots, n))))).alias("betweenness"))


def chained_hashes(tx: DataFrame, numbered: DataFrame, block: int = 1024) -> DataFrame:
    """(tx_id, block, poh): hash chains over blocks of consecutive transfers.

    ``numbered`` has tx_id and row_id from 1 in order of time. Each hash covers its transfer and the hash before it in the block, so
    a block's last hash seals it; a chain over all rows would be one task's work, so blocks are sealed apart, and ``seal_tree`` ties the seals to one root.
    """
    rows = tx.join(numbered.select("tx_id", "row_id"), "tx_id").withColumn("block", F.floor((F.col("row_id") - 1) / block))
    text = F.concat(F.col("sender").cast("string"), F.col("receiver").cast("string"), F.col("tx_id").cast("string"))
    sealed = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("row_id", "tx_id", text.alias("x")))).alias("rows"))
    before = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
    step = lambda acc, r: F.concat(acc, F.array(F.sha2(F.concat(before(acc), r["x"]).cast("binary"), 256)))
    hashes = F.aggregate("rows", F.expr("cast(array() as array<string>)"), step)
    chained = sealed.select("block", F.explode(F.arrays_zip(F.transform("rows", lambda r: r["tx_id"]).alias("tx_id"), hashes.alias("poh"))).alias("o"))
    return chained.select("o.tx_id", "block", "o.poh")


def seal_tree(seals: DataFrame) -> DataFrame:
    """(level, place, hash): a tree of hashes over the seals (place from 0 without gaps, hash), each node the SHA-256 of its two children's hashes; a node without a sibling moves up as it is.

    Level 0 are the seals, the last level is the root. ``STRIDE`` levels are made at once, from groups of 2^STRIDE neighbouring nodes at most, so a million seals are two rounds.
    """
    tree = Growing(seals.sparkSession, "level int, place long, hash string", "seals")
    nodes = materialise(seals.select(F.col("place").cast("long").alias("place"), "hash"), "seal-level")
    n, base = nodes.count(), 0
    top = (n - 1).bit_length()
    pair = lambda row, i: F.sha2(F.concat(F.get(row, 2 * i), F.get(row, 2 * i + 1)).cast("binary"), 256)
    above = lambda row: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(row) - 1, 1)), lambda i: F.when(2 * i + 1 < F.size(row), pair(row, i)).otherwise(F.get(row, 2 * i)))
    while n:
        k = min(STRIDE, top - base)
        own = nodes.groupBy(F.shiftright("place", k).alias("g")).agg(F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("own"))
        rows = F.array(F.transform("own", lambda x: x["hash"]))
        if k:
            rows = F.aggregate(F.sequence(F.lit(1), F.lit(k)), rows, lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1)))))
        rows = materialise(own.select("g", rows.alias("rows")), "seal-rows")
        each = rows.select("g", F.posexplode("rows").alias("up", "row")).select("g", "up", F.posexplode("row").alias("i", "hash"))
        last = base + k == top
        tree.add(each.filter(F.lit(last) | (F.col("up") < k)).select((F.col("up") + base).alias("level"), (F.expr(f"shiftleft(g, {k} - up)") + F.col("i")).alias("place"), "hash"))
        if last:
            break
        nodes, base = rows.select(F.col("g").alias("place"), F.get(F.get("rows", F.lit(k)), F.lit(0)).alias("hash")), base + k
    return tree.read()


def block_seals(numbered: DataFrame, block: int = 1024) -> DataFrame:
    """(place, hash): the last hash of each block of ``chained_hashes``, from transfers numbered by row_id; the hashes before it are not kept."""
    text = F.concat(F.col("sender").cast("string"), F.col("receiver").cast("string"), F.col("tx_id").cast("string"))
    own = numbered.groupBy(F.floor((F.col("row_id") - 1) / block).alias("place")).agg(F.array_sort(F.collect_list(F.struct("row_id", text.alias("x")))).alias("rows"))
    return own.select("place", F.aggregate("rows", F.lit(""), lambda acc, r: F.sha2(F.concat(acc, r["x"]).cast("binary"), 256)).alias("hash"))


def seal_proofs(tree: DataFrame) -> DataFrame:
    """(place, seal, path): for each seal its siblings on the way to the root, from the seal up, as (left, hash); where there is none, no entry.

    From the root down, ``STRIDE`` levels at once: the nodes of a subtree are one group, its path above is joined to it once, and only the last round has a row a seal.
    """
    top = tree.agg(F.max("level").alias("n")).first()["n"] or 0
    upper = tree.filter(F.col("level") == top).select("place", F.expr("cast(array() as array<struct<left:boolean,hash:string>>)").alias("path"))
    if top == 0:
        return upper.join(tree.select("place", F.col("hash").alias("seal")), "place").select("place", "seal", "path")
    for base in reversed(range(0, top, STRIDE)):
        k = min(STRIDE, top - base)
        nodes = tree.filter((F.col("level") >= base) & (F.col("level") < base + k)).withColumn("g", F.expr(f"shiftright(place, {base + k} - level)"))
        own = nodes.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("level", "place", "hash"))).alias("nodes"))
        level = lambda j: F.transform(F.filter("nodes", lambda x: x["level"] == base + j), lambda x: x["hash"])  # noqa: E731, B023
        rows = own.select("g", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), level).alias("rows"))
        beside = lambda i: F.transform("rows", lambda row, j: F.struct((F.call_function("shiftright", i, j) % 2 == 1).alias("left"), F.get(row, F.call_function("shiftright", i, j).bitwiseXOR(F.lit(1))).alias("hash")))
        path = lambda i: F.concat(F.filter(beside(i), lambda p: p["hash"].isNotNull()), F.col("path"))  # noqa: E731, B023
        leaves = rows.join(upper.withColumnRenamed("place", "g"), "g").select("g", F.explode(F.transform(F.get("rows", F.lit(0)), lambda h, i: F.struct(i.alias("i"), h.alias("seal"), path(i).alias("path")))).alias("leaf"))  # noqa: B023
        found = leaves.select((F.shiftleft("g", k) + F.col("leaf.i")).alias("place"), "leaf.seal", "leaf.path")
        upper = materialise(found.select("place", "path"), "seal-paths") if base else found
    return upper


def sealed_root(seal: Column, path: Column) -> Column:
    """The root that a seal and its path lead to."""
    pair = lambda acc, p: F.when(p["left"], F.concat(p["hash"], acc)).otherwise(F.concat(acc, p["hash"]))
    return F.aggregate(path, seal, lambda acc, p: F.sha2(pair(acc, p).cast("binary"), 256))


def risk_rules(label: Column, amount: Column, epoch: Column) -> Column:
    return edge_risk(label, amount, hour_of(epoch))
