"""Strongly connected components, and the edges that lie on cycles.

Vertices that lie on no cycle are trimmed first, and stretches of vertices with one edge in and one out are contracted by pointer doubling, so a long
cycle is one step. What is left is solved by forward and backward reach: in each weakly connected part, all parts at once, one pivot
of greatest degree product is searched from in both directions; what both searches reach is a component, and no component straddles what only one or neither reaches. Edges
between these are dropped, the rest is trimmed, and its parts are searched again. Searches take a join a step, as many steps as the contracted graph is wide.

Edges with a null end are ignored, repeated edges count once, a self loop is a cycle of its own vertex. Without edges results are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.components import connected_components
from cairn.operators.graph import cycle_core, followed
from cairn.operators.scratch import Growing, materialise


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id) of the vertices that the edges (src, dst) lead to from the ids of ``start``, these included."""
    seen = Growing(edges.sparkSession, f"id {dict(edges.dtypes)['src']}", "reached")
    front = materialise(start.select("id").distinct(), "front")
    while not front.isEmpty():
        seen.add(front)
        step = edges.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        front = materialise(step.join(seen.read(), "id", "left_anti"), "front")
    return seen.read()


def _by_pivots(edges: DataFrame) -> DataFrame:
    """(id, component): the components of more than one vertex, named by one of them."""
    kind = dict(edges.dtypes)["src"]
    found = Growing(edges.sparkSession, f"id {kind}, component {kind}", "strong")
    live = cycle_core(edges)
    while not live.isEmpty():
        parts = materialise(connected_components(live), "parts")
        out = live.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
        into = live.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
        wide = parts.join(out, "id").join(into, "id").groupBy("component").agg(F.max_by("id", F.struct(F.col("o") * F.col("i"), "id")).alias("pivot"))
        wide = materialise(wide, "pivots")
        start = wide.select(F.col("pivot").alias("id"))
        ahead = reached(live, start).withColumn("f", F.lit(True))
        back = reached(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start).withColumn("b", F.lit(True))
        sides = materialise(parts.join(ahead, "id", "left").join(back, "id", "left").select("id", "component", F.col("f").isNotNull().alias("f"), F.col("b").isNotNull().alias("b")), "sides")
        found.add(sides.filter("f AND b").join(wide, "component").select("id", F.col("pivot").alias("component")))
        at = lambda end: sides.filter("NOT (f AND b)").select(F.col("id").alias(end), F.struct("f", "b").alias(f"{end}_side"))  # noqa: E731, B023
        rest = live.join(at("src"), "src").join(at("dst"), "dst").filter("src_side = dst_side").select("src", "dst")
        live = cycle_core(rest)
    return found.read()


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the edges (src, dst): vertices that reach each other share a component, which is named by its least id."""
    pairs = materialise(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "pairs")
    vertices = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
    core = cycle_core(pairs)
    out = core.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    into = core.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    degree = materialise(out.join(into, "id"), "degrees")
    inner = degree.filter("i = 1 AND o = 1").select("id")
    at = lambda near, far: core.join(inner.withColumnRenamed("id", near), near).select(F.lit(near == "dst").alias("back"), F.col(near).alias("id"), F.col(far).alias("to"))
    ends = followed(at("src", "dst").union(at("dst", "src")))
    last, first = (ends.filter(f"back = {back} AND NOT on").select("id", "to") for back in (False, True))
    round_ = ends.filter("on AND NOT back").select("id")
    rings = connected_components(core.join(round_.withColumnRenamed("id", "src"), "src", "left_semi"))
    outer = degree.filter("NOT (i = 1 AND o = 1)").select("id")
    heads = core.join(outer.withColumnRenamed("id", "src"), "src", "left_semi")
    short = heads.join(last.withColumnRenamed("id", "dst"), "dst", "left").select("src", F.coalesce("to", "dst").alias("dst")).filter("src <> dst").distinct()
    solved = _by_pivots(materialise(short, "contracted"))
    known = materialise(outer.join(solved, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "outer")
    held = last.join(known.select(F.col("id").alias("to"), F.col("component").alias("c")), "to").select("id", "c").join(first.join(known.select(F.col("id").alias("to"), "component"), "to").select("id", "component"), "id")
    members = materialise(known.unionByName(held.filter("c = component").select("id", "component")).unionByName(rings), "members")
    names = members.groupBy("component").agg(F.min("id").alias("name"))
    return vertices.join(members.join(names, "component").select("id", "name"), "id", "left").select("id", F.coalesce("name", "id").alias("component"))


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, cyclic) of the distinct edges: 1 for those on a cycle, which are self loops and edges within a component, and 0 for the others."""
    of = materialise(strong_components(edges), "strong-components")
    at = lambda end: of.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component"))
    pairs = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    return pairs.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", (F.col("src_component") == F.col("dst_component")).cast("int").alias("cyclic"))
