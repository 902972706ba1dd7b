"""Operators against plain Python specifications on small graphs and fixtures."""

import itertools
import math
import random
import zipfile
from collections import Counter
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import scalar
from cairn.operators import attributions, convolution, graph, learning, merge_tree, relational, scratch, strong, sweep
from cairn.operators.components import connected_components, merged
from cairn.operators.scratch import materialise
from cairn.operators.shipping import ship
from cairn.plans import registry
from cairn.sources import transactions as source
from cairn.streaming import transfers as streaming


def frame(spark, rows):
    return spark.createDataFrame(rows, "tx_id long, sender long, receiver long, epoch long, amount double, is_laundering int")


def random_tx(seed, n=60, accounts=20):
    r = random.Random(seed)
    return [(i, r.randrange(accounts), r.randrange(accounts), r.randrange(40), float(r.randrange(10_000)), r.randrange(2)) for i in range(n)]


def union_find(pairs):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    kept = []
    for k, a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return {a: find(a) for a in list(parent)}, kept


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(30)] + [(100 + i, 101 + i) for i in range(25)] + [(7, 7), (None, 3)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == union_find([(0, a, b) for a, b in edges if a is not None])[0]


def test_components_settle_in_few_rounds_on_a_hub_and_a_path(spark):
    """A hub's leaves fall together in one round, and a path is cut by more than four a round, whatever its ids."""
    hub = [(5000, 6000 + i) for i in range(300)] + [(5000, 4000 + i) for i in range(300)]
    path = [(i, i + 1) for i in range(600)]
    rows = connected_components(spark.createDataFrame(hub + path, "src long, dst long"), max_rounds=5)
    assert {(r.component, r["count"]) for r in rows.groupBy("component").count().collect()} == {(0, 601), (4000, 601)}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_forest_equals_a_scan_in_order(spark, seed):
    rows = random_tx(seed)
    kept = union_find([(x[0], x[1], x[2]) for x in sorted(rows, key=lambda x: (x[3], x[0]))])[1]
    assert sorted(r.tx_id for r in graph.temporal_forest(frame(spark, rows)).collect()) == sorted(kept)


@pytest.mark.parametrize("seed", [5, 6])
def test_hub_edges_have_the_components_of_the_chain(spark, seed):
    t = frame(spark, random_tx(seed))
    both = [sorted(tuple(r) for r in connected_components(e).collect()) for e in (relational.temporal_chain(t), relational.chain_hubs(t))]
    assert both[0] == both[1]


def test_chain_is_strict(spark):
    t = frame(spark, [(1, 1, 2, 5, 1.0, 0), (2, 2, 3, 5, 1.0, 0), (3, 2, 3, 6, 1.0, 0), (4, 5, 5, 1, 1.0, 0)])
    assert [tuple(r) for r in relational.temporal_chain(t).collect()] == [(1, 3)]


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (0, 1), (9, 9)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.cycle_core(edges).collect()) == [(1, 2), (2, 3), (3, 1)]
    assert not graph.is_dag(edges) and graph.is_dag(edges.filter("src < dst AND src <> 3"))


def test_tabu_steps_to_the_best_neighbour():
    scores = [(0.5, 0.1, 0.2, 0.3, 0.1), (1.4, 0.0, 0.0, 0.0, 0.6), (1.5, 0.0, 0.0, 0.0, 0.4), (2.5, 0.0, 0.0, 0.0, 0.2)]
    path = graph.tabu_search(scores, rounds=8)
    # from 1.5 to 1.3, which acts as the cut 1.4; then all thresholds of that cut are equals, and the lowest that is not taken of late is next
    assert [x[0] for x in path[:3]] == [1.3, 1.1, 0.9] and path[0][1:] == (0.0, 0.0, 0.0, 0.6, 1.3)
    assert all(0.1 <= x[0] <= 3.0 for x in path) and {x[5] for x in path} == {1.3}
    assert all(path[i][0] not in [x[0] for x in path[max(0, i - 5) : i]] for i in range(1, len(path)))
    assert graph.tabu_search([], rounds=3)[0] == (1.3, 0.0, 0.0, 0.0, 0.0, 1.5)


def same_groups_by_force(rows, cuts):
    """By cut: the group of every account."""
    ends = [(0, v, v) for a, b, _ in rows for v in (a, b)]
    return {cut: union_find([(0, a, b) for a, b, w in rows if w >= cut] + ends)[0] for cut in cuts}


def test_merge_tree_gives_the_groups_of_every_cut(spark):
    r = random.Random(21)
    rows = [(r.randrange(40), r.randrange(40), r.randrange(60) / 2) for _ in range(70)] + [(100 + i, 101 + i, 50.0 - i % 7) for i in range(30)] + [(200, 200, 3.0)]
    edges = spark.createDataFrame([*rows, rows[0]], "src long, dst long, risk double")
    tree = materialise(merge_tree.merge_tree(edges), "tree")
    cuts = sorted({w for *_, w in rows} | {0.25, 99.0})
    want = same_groups_by_force(rows, cuts)
    vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    for cut in cuts[::12]:
        assert {x.id: x.component for x in merge_tree.groups_at(tree, vertices, cut).collect()} == want[cut]
    ids = sorted(want[99.0])
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids[::3]], "src long, dst long")
    for x in merge_tree.last_cut(tree, pairs).collect():
        together = [c for c in cuts if want[c][x.src] == want[c][x.dst]]
        assert x.cut == (float("inf") if x.src == x.dst else max((c for c in together if c != 0.25), default=None))


def test_ten_thousand_different_risks(spark):
    """All cuts of 10,000 different risks from one tree: scores equal those of a scan from the highest risk down."""
    r = random.Random(10)
    n = 10_000
    rows = [(i, r.randrange(2500), r.randrange(2500), i, r.random(), r.randrange(2)) for i in range(n)]
    edges = spark.createDataFrame([(x[1], x[2], x[4]) for x in rows], "src long, dst long, risk double")
    found = {x.threshold: (x.precision, x.recall) for x in merge_tree.threshold_scores(frame(spark, rows), edges).collect()}
    assert len(found) == n + 1
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    positive = sum(x[5] for x in rows)
    for k, x in enumerate(sorted(rows, key=lambda x: -x[4])):
        parent[find(x[1])] = find(x[2])
        if k % 1500 == 0:
            together = [y[5] for y in rows if find(y[1]) == find(y[2])]
            assert found[x[4]] == (sum(together) / len(together), sum(together) / positive)


def test_walks_on_cycles_raise(spark):
    successor = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    with pytest.raises(ValueError, match="cycle"):
        graph.walks_to_sinks(successor)
    with pytest.raises(ValueError, match="cycle"):
        graph.trace(successor, spark.createDataFrame([(1,)], "id long"))
    assert [tuple(x) for x in graph.trace(successor, spark.createDataFrame([(4,)], "id long")).collect()] == [(4, 4, 0), (4, 5, 1)]


def longest_paths(edges):
    """(level, risk) by a scan in topological order; None if there is a cycle."""
    into, out, value = {}, {}, {}
    for (a, b), w in edges.items():
        into[b] = into.get(b, 0) + 1
        out.setdefault(a, []).append((b, w))
    ready = [v for v in {x for e in edges for x in e} if v not in into]
    value = {v: (0, 0.0) for v in ready}
    done = 0
    while ready:
        a = ready.pop()
        done += 1
        for b, w in out.get(a, ()):
            k, r = value.get(b, (0, float("-inf")))
            value[b] = (max(k, value[a][0] + 1), max(r, value[a][1] + w))
            into[b] -= 1
            if not into[b]:
                ready.append(b)
    return value if done == len({x for e in edges for x in e}) else None


@pytest.mark.parametrize("seed", [31, 32, 33])
def test_relax_equals_a_topological_scan(spark, seed):
    r = random.Random(seed)
    edges = {(a, b): float(r.randrange(-3, 9)) for a, b in (sorted(r.sample(range(25), 2)) for _ in range(30))}
    edges |= {(100 + i, 101 + i): 1.5 for i in range(12)} | {(105, 3): 2.0, (40, 100): 1.0}
    got = graph.relax(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, w double"), "w")
    assert {x.id: (x.level, x.risk) for x in got.collect()} == longest_paths(edges)


def test_relax_on_cycles_and_long_paths(spark):
    of = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    for cycle in ([(1, 2), (2, 3), (3, 1)], [(0, 1), (1, 2), (2, 1), (2, 5)], [(4, 4)], [(0, 9), (1, 2), (2, 3), (3, 4), (4, 1)]):
        with pytest.raises(ValueError, match="cycle"):
            graph.relax(of(cycle))
    path = spark.range(12_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.relax(path).agg(F.max("level"), F.count("*")).first()[:] == (12_000, 12_001)
    assert graph.is_dag(path) and not graph.is_dag(path.union(of([(12_000, 0)])))
    assert graph.relax(of([]).limit(0)).count() == 0


def test_relax_contracts_forests_in_few_phases(spark, monkeypatch):
    """A tree in which every vertex joins two branches, hung on a comb as long: as many levels as vertices on the comb, few phases, whatever their order."""
    r = random.Random(5)
    edges = {(2 * i, i): float(r.randrange(-3, 9)) for i in range(1, 64)} | {(2 * i + 1, i): float(r.randrange(-3, 9)) for i in range(1, 64)}
    for i in range(1000, 1120):
        edges |= {(i, i + 1): float(r.randrange(-3, 9)), (i + 5000, i): float(r.randrange(-3, 9)), (i, i + 9000): 1.0}
    edges |= {(1, 1000): 2.0, (1120, 20_000): -1.0}
    tags = Counter()
    real = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, tag: tags.update([tag]) or real(df, tag))
    got = graph.relax(spark.createDataFrame([(f"v{a}", f"v{b}", w) for (a, b), w in edges.items()], "src string, dst string, w double"), "w")
    assert {int(x.id[1:]): (x.level, x.risk) for x in got.collect()} == longest_paths(edges)
    assert tags["ahead"] <= 2 * math.log2(2 * len(edges))


def swept_levels(rows, weight):
    """Plain Python: transfers in order of time; what comes before a transfer is every strictly earlier one that pays its sender."""
    value, out = {}, {}
    for i, a, b, t, *_ in sorted((x for x in rows if x[3] is not None), key=lambda x: x[3]):
        before = [value[x[0]] for x in rows if a is not None and x[3] is not None and x[2] == a and x[3] < t]
        known = [v for v in before if v]
        value[i] = (0, 0.0) if not before else (1 + max(k for k, _ in known), weight[i] + max(r for _, r in known)) if known and weight.get(i) is not None else None
        follows = any(x[3] is not None and x[3] > t and x[1] == b for x in rows if b is not None)
        if value[i] and (value[i][0] or follows):
            out[i] = value[i]
    return out


@pytest.mark.parametrize("block_rows", [1, 7, 40, 10_000])
def test_levels_by_sweeps_equal_plain_python(spark, block_rows):
    rows = random_tx(block_rows, 150, 25)
    rows = [(i, a if i % 13 else None, b if i % 17 else None, 20 if i % 3 == 0 else None if i % 41 == 0 else t, *rest) for i, a, b, t, *rest in rows]  # a third at one instant
    weight = {x[0]: None if x[0] % 23 == 0 else float(x[0] % 9 - 3) for x in rows if x[0] % 29}
    t = frame(spark, rows + rows[:9]).repartition(3).withColumn("block", F.lit("x")).withColumn("w", F.lit(1))
    weights = spark.createDataFrame(list(weight.items()), "id long, w double")
    got = {x.id: (x.level, x.risk) for x in sweep.chain_levels(t, weights, block_rows).collect()}
    assert got == swept_levels(rows, weight) and max(k for k, _ in got.values()) > 2
    assert sweep.chain_levels(t.limit(0), weights, block_rows).count() == 0


def test_levels_take_few_rounds_on_long_paths(spark, monkeypatch):
    """One path of 600 transfers in time order: written rounds follow the blocks that it changes, not its steps."""
    t = frame(spark, [(i, i, i + 1, i, 1.0, 0) for i in range(600)]).select("*", F.col("sender").cast("string").alias("s"), F.col("receiver").cast("string").alias("r")).drop("sender", "receiver").withColumnsRenamed({"s": "sender", "r": "receiver"})
    tags = Counter()
    real = sweep.materialise
    monkeypatch.setattr(sweep, "materialise", lambda df, tag: tags.update([tag]) or real(df, tag))
    weights = t.select(F.col("tx_id").alias("id"), F.lit(0.5).alias("w"))
    for block_rows in (1000, 100):
        tags.clear()
        got = {x.id: (x.level, x.risk) for x in sweep.chain_levels(t, weights, block_rows).collect()}
        assert got == {i: (i, i / 2) for i in range(600)}
        blocks = t.count() // block_rows + 4  # the chunks of four partitions end in blocks of their own
        assert tags["said"] <= blocks + 1


def test_levels_sweep_every_block_once(spark, monkeypatch):
    """Paths that go through all blocks: each block is written once, and says of an account no more than one row."""
    rows = [(10 * i + j, 100 * j + i, 100 * j + i + 1, i, 1.0, 0) for i in range(60) for j in range(4)]
    added, real = [], sweep.Growing
    monkeypatch.setattr(sweep, "Growing", lambda *a: added.append(real(*a)) or added[-1])
    t = frame(spark, rows)
    got = {x.id: (x.level, x.risk) for x in sweep.chain_levels(t, t.select(F.col("tx_id").alias("id"), F.lit(2.0).alias("w")), 16).collect()}
    assert got == {10 * i + j: (i, 2.0 * i) for i in range(60) for j in range(4)}
    swept = added[0].read()
    assert swept.filter("id IS NOT NULL").count() == len(rows) and swept.filter("next IS NOT NULL").count() <= len(rows)


@pytest.mark.parametrize("seed", [41, 42])
def test_chain_without_pairs_equals_the_pairs(spark, seed):
    rows = random_tx(seed, 120, 8)
    t = frame(spark, rows).repartition(3)
    chain, pairs = relational.Chain(t), [tuple(x) for x in relational.temporal_chain(t).collect()]
    when = {x[0]: x[3] for x in rows}
    value = {x[0]: x[0] * 7 % 50 for x in rows if x[0] % 3}
    best = {}
    for a, b in pairs:
        if a in value:
            best.setdefault(b, []).append(value[a])
    values = spark.createDataFrame(list(value.items()), "id long, v long")
    assert {x.id: x.v for x in chain.forward(values).collect()} == {b: min(v) for b, v in best.items()}
    assert {x.id: x.v for x in chain.forward(values, F.max, F.greatest).collect()} == {b: max(v) for b, v in best.items()}
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append((when[b], b))
    assert {x.src: x.dst for x in chain.successors().collect()} == {a: min(v)[1] for a, v in after.items()}
    assert {x.id: (x.has_in, x.has_out) for x in chain.ends().collect()} == {x[0]: (x[0] in {b for _, b in pairs}, x[0] in after) for x in rows}
    assert {x.tx_id for x in relational.unreached(t).collect()} == {x[0] for x in rows} - {b for _, b in pairs}
    for seed_of in ("source", "sink"):
        a, b = (sorted(tuple(x) for x in df.collect()) for df in (graph.propagate_chain(chain, seed_of), graph.propagate(relational.temporal_chain(t), seed_of)))
        assert a == b


def test_previous_row_of_a_key_over_many_chunks(spark):
    r = random.Random(3)
    rows = [(i, None if i % 17 == 0 else 1 if i % 5 else r.randrange(6), r.randrange(60)) for i in range(400)]
    df = spark.createDataFrame(rows, "tx_id long, k long, epoch long")
    got = {x.tx_id: x.before for x in relational.previous(df, "k", ["epoch", "tx_id"], "epoch", "before").collect()}
    want, last = {}, {}
    for i, k, e in sorted(rows, key=lambda x: (x[2], x[0])):
        want[i] = last.get(k) if k is not None else None
        last[k] = e
    assert got == want


def test_scratch_is_deleted_after_errors_too(spark):
    for fail in (False, True):
        try:
            with scratch.scratch(spark) as name:
                edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
                assert connected_components(edges).count() == 3 and graph.relax(edges).count() == 3
                assert spark.sql(f"SHOW TABLES IN {name}").count() > 0
                if fail:
                    raise RuntimeError("stop")
        except RuntimeError:
            pass
        assert name not in [x[0] for x in spark.sql("SHOW DATABASES").collect()]
        path = Path(scratch.shared_dir(spark).removeprefix("file://")) / name
        assert not path.exists()


def test_fold_features_see_no_test_row(spark):
    rows = random_tx(51, 200, 15)
    t = frame(spark, rows)
    folds = learning.stratified_folds(t, 3)
    where = {x.tx_id: x.fold for x in folds.collect()}
    found = lambda rows: {x.tx_id: tuple(x)[1:] for x in learning.fold_features(frame(spark, rows), folds, 0).collect()}
    base = found(rows)
    assert {i: f[0] for i, f in base.items()} == {i: where[i] == 0 for i in where}
    # labels and amounts of the test rows, and labels of all, change nothing; a test row that is gone changes no other
    other = [(i, a, b, e, -1.0 if where[i] == 0 else x, 1 - y) for i, a, b, e, x, y in rows]
    assert found(other) == base
    gone = next(i for i in where if where[i] == 0)
    assert found([x for x in rows if x[0] != gone]) == {i: f for i, f in base.items() if i != gone}


def test_pooled_predictions_are_out_of_fold(spark):
    t = frame(spark, random_tx(52, 150, 12)).withColumn("label", F.col("is_laundering").cast("double"))
    folds = learning.stratified_folds(t, 3)
    pooled = learning.cross_validate(t, folds, learning.pipeline(["amount"], [], learning.models()["logistic"]), 3)
    assert sorted((x.tx_id, x.fold) for x in pooled.collect()) == sorted((x.tx_id, x.fold) for x in folds.collect())
    report = learning.fold_report(pooled).collect()
    assert [x.fold for x in report] == [0, 1, 2, -1] and all(0 <= x.auc <= 1 and 0 <= x.weighted_f1 <= 1 for x in report)
    one = learning.predictions(t.filter("label = 0"), t.limit(3), learning.pipeline(["amount"], [], learning.models()["logistic"]))
    assert {(x.predicted, x.score) for x in one.collect()} == {(0, 0.0)}


def test_importances_have_the_names_of_the_slots(spark):
    t = frame(spark, random_tx(53, 150, 12)).withColumns({"label": F.col("is_laundering").cast("double"), "kind": F.when(F.col("is_laundering") == 1, "yes").otherwise("no")})
    model = learning.pipeline(["amount"], ["kind"], learning.models()["forest"]).fit(t)
    named = learning.importances(model, t)
    assert {n for n, _ in named} >= {"amount", "kind_oh_yes", "kind_oh_no"} and named[0][0].startswith("kind_oh_")


def test_csv_byte_order_mark_and_graphml_document(spark, tmp_path):
    df = frame(spark, random_tx(54, 20))
    source.write_csv(df, str(tmp_path / "csv"), bom=True)
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbf") for f in (tmp_path / "csv").glob("part-*"))
    nodes = spark.createDataFrame([("a&b",), ("<c>",)], "id string")
    source.write_graphml(nodes, spark.createDataFrame([("a&b", "<c>", "1"), ("<c>", "<c>", None)], "src string, dst string, ts string"), str(tmp_path / "g"))
    document = ElementTree.fromstring("".join(f.read_text() for f in sorted((tmp_path / "g").glob("part-*"))))
    tags = Counter(e.tag.split("}")[1] for e in document.iter())
    assert tags == {"graphml": 1, "key": 1, "graph": 1, "node": 2, "edge": 2, "data": 2}
    assert {x.id for x in source.read_graphml_nodes(spark, str(tmp_path / "g")).collect()} == {"a&b", "<c>"}


def test_the_write_itself_observes_counts(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k")).repartition(3).mapInArrow(count, "id long, k long")
    seen = source.write_observed(rows, str(tmp_path / "whole"), n=F.count(F.lit(1)), with_k=F.count("k"), most=F.max("k"))
    assert seen == {"n": 1000, "with_k": sum(i % 3 > 0 for i in range(1000)), "most": 6}
    assert computed.value == 1000  # one evaluation for rows and counts
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "whole")).collect())) == [(i, i % 7 if i % 3 else None) for i in range(1000)]
    assert source.write_observed(spark.range(0), str(tmp_path / "none")) == {"n": 0}
    assert source.write_observed(spark.range(0), str(tmp_path / "null"), most=F.max("id")) == {"most": None}
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("observed_")]
    with pytest.raises(Exception, match="(?i)exist"):
        source.write_observed(rows, str(tmp_path / "whole"))


def test_models_are_fitted_after_an_observed_write(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    points = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") >= 50).cast("int").alias("label"))
    assert source.write_observed(points, str(tmp_path / "points"))["n"] == 100
    vectors = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.read.parquet(str(tmp_path / "points")))
    model = LogisticRegression(maxIter=20).fit(vectors)
    assert model.summary.accuracy > 0.95
    assert model.transform(vectors).filter("prediction = label").count() > 95


def test_the_package_is_shipped_whole(spark):
    names = zipfile.ZipFile(ship(spark)).namelist()
    assert {"cairn/__init__.py", "cairn/operators/graph.py", "cairn/plans/registry.py"} <= set(names)


def test_walk_rates_sum_to_one(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (3, 1, 3), (8, 9, 1)], "src long, dst long, epoch long")
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)], "id long, component long")
    got = graph.monte_carlo(edges, comp, walks=20)
    assert all(abs(r.s - 1) < 1e-9 for r in got.groupBy("component").agg(F.sum("rate").alias("s")).collect())


def test_scalars_on_bad_input(spark):
    df = spark.createDataFrame([("01:02:03",), ("x",), (None,), ("7",)], "t string")
    assert [r[0] for r in df.select(scalar.seconds_of_day(F.col("t"))).collect()] == [3723, 43200, 43200, 43200]
    assert [r[0] for r in df.select(scalar.hour_or_default(F.col("t"))).collect()] == [12, 12, 12, 7]


def test_row_numbers_and_folds(spark):
    df = frame(spark, random_tx(9, 300))
    assert sorted(r.row_id for r in relational.global_row_number(df, ["epoch", "tx_id"]).collect()) == list(range(1, 301))
    folds = df.join(learning.stratified_folds(df, 3), "tx_id").groupBy("is_laundering", "fold").count().collect()
    by = {y: [r["count"] for r in folds if r.is_laundering == y] for y in (0, 1)}
    assert all(max(v) - min(v) <= 1 for v in by.values())


def test_auc_of_known_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5)], "y int, s double")
    assert learning.auc(df, "y", "s").first().auc == 0.875


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    row = relational.metrics(relational.confusion(df, F.col("y"), F.col("p"))).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 0.0, 0.0, 0.0)


def test_graphml_edges(spark, tmp_path):
    path = tmp_path / "g.graphml"
    path.write_text('<graphml><graph><edge source="1" target="2"><data key="d0">2022-10-07</data></edge><edge source="2" target="3"><data key="d0">x</data></edge></graph></graphml>')
    assert sorted(tuple(r) for r in source.read_graphml_edges(spark, str(path)).collect()) == [("1", "2", "2022-10-07"), ("2", "3", "x")]


def test_cross_validation_and_ablation_rows(spark):
    df = frame(spark, random_tx(11, 120)).withColumn("label", F.col("is_laundering").cast("double"))
    flow = learning.pipeline(["amount"], [], learning.models()["logistic"])
    got = learning.cross_validate(df, learning.stratified_folds(df, 2), flow, 2).collect()
    assert len(got) == 120 and {r.fold for r in got} == {0, 1}
    table = learning.ablation(df.filter("epoch < 20"), df.filter("epoch >= 20"), {"a": (["amount"], []), "b": (["amount", "epoch"], [])}, ["logistic", "tree"])
    assert table.count() == 4


def test_trace_follows_the_riskiest_predecessors(spark):
    edges = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (4, 5), (5, 6), (9, 6)], "src long, dst long")
    nodes = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 2.0), (4, 2.0), (5, 3.0), (6, 4.0), (9, 1.0)], "id long, risk double")
    path = graph.trace(graph.best_predecessor(edges, nodes), nodes.filter("id = 6").select("id"))
    assert sorted(tuple(r) for r in path.collect()) == [(6, 1, 4), (6, 3, 3), (6, 4, 2), (6, 5, 1), (6, 6, 0)]
    assert graph.trace(edges, nodes.limit(0).select("id")).count() == 0


def test_running_totals_go_on_where_they_ended(spark, tmp_path):
    arrivals, state = str(tmp_path / "in"), str(tmp_path / "state")
    stream = lambda t: streaming.read_transfers(spark, arrivals, t.schema, files_per_batch=1)
    first, second = frame(spark, random_tx(12, 40)), frame(spark, [(100 + x[0], *x[1:]) for x in random_tx(13, 30)])
    first.repartition(3).write.parquet(arrivals)
    streaming.accumulate(stream(first), ["sender"], state)
    second.write.mode("append").parquet(arrivals)
    got = streaming.accumulate(stream(first), ["sender"], state)
    want = first.union(second).groupBy("sender").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("total"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    again = streaming.accumulate(stream(first), ["sender"], state)
    assert again.agg(F.sum("n")).first()[0] == 70


def test_running_totals_of_an_empty_folder(spark, tmp_path):
    t = frame(spark, random_tx(1, 1))
    t.limit(0).write.parquet(str(tmp_path / "in"))
    assert streaming.accumulate(streaming.read_transfers(spark, str(tmp_path / "in"), t.schema), ["sender"], str(tmp_path / "state")).count() == 0


def test_late_rows_and_second_deliveries(spark, tmp_path):
    day = 86_400
    rows = [(1, 1, 2, 10, 5.0, 0), (1, 1, 2, 10, 5.0, 0), (2, 1, 2, day + 5, 7.0, 0), (3, 1, 2, 3 * day, 1.0, 0)]
    t = frame(spark, rows).withColumn("payment_type", F.lit("x"))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    arrivals = streaming.read_transfers(spark, str(tmp_path / "in"), t.schema)
    totals = streaming.drain(streaming.windowed_totals(arrivals), str(tmp_path / "windows"))
    assert sorted((r.window_start, r.n, float(r.total)) for r in totals.collect()) == [(0, 2, 10.0), (day, 1, 7.0)]
    kept = streaming.drain(streaming.first_deliveries(arrivals).select("tx_id"), str(tmp_path / "kept"))
    assert sorted(r.tx_id for r in kept.collect()) == [1, 2, 3]


def strong_by_force(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    reach = {}
    for v in after:
        seen, todo = {v}, [v]
        while todo:
            for w in after[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        reach[v] = seen
    return {v: min(w for w in reach[v] if v in reach[w]) for v in after}


SHAPES = {
    "bridge": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)],
    "long ring with a tail": [(i, (i + 1) % 90) for i in range(90)] + [(5, 100), (100, 101), (200, 7)],
    "two rings at one vertex": [(0, 1), (1, 2), (2, 0), (0, 11), (11, 12), (12, 13), (13, 0)],
    "chain of pairs": [e for i in range(0, 12, 2) for e in ((i, i + 1), (i + 1, i), (i + 1, i + 2))],
    "no cycle": [(1, 2), (1, 3), (2, 4), (3, 4)],
    "loops": [(1, 1), (1, 2), (3, 3)],
}


@pytest.mark.parametrize("graph_of", ["shapes", "random"])
def test_strong_components_equal_brute_force(spark, graph_of):
    """All shapes side by side in one table, with ends of null, repeated edges and another column; and a sparse random graph."""
    r = random.Random(2)
    shapes = [(1000 * k + a, 1000 * k + b) for k, edges in enumerate(SHAPES.values()) for a, b in edges]
    edges = shapes if graph_of == "shapes" else [(r.randint(0, 90), r.randint(0, 90)) for _ in range(115)]
    want = strong_by_force(edges)
    table = spark.createDataFrame([*edges, edges[0], (None, 1), (2, None)], "src long, dst long").withColumn("component", F.lit("x"))
    assert {x.id: x.component for x in strong.strong_components(table).collect()} == want
    if graph_of == "random":
        assert {(x.src, x.dst): x.cyclic for x in strong.cyclic_edges(table).collect()} == {(a, b): int(want[a] == want[b]) for a, b in edges}
    else:
        assert strong.strong_components(table.limit(0)).count() == 0


def test_rings_do_not_prolong_the_doubling(spark, monkeypatch):
    """A ring's pointers never end; rounds follow the longest stretch beside it, which here has four edges, and not the thousand pointers."""
    written = []
    real = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, tag: (written.append(tag), real(df, tag))[1])
    ring = [(2 * i, (2 * i + 2) % 1000) for i in range(500)]
    tail = [(2001, 2002), (2002, 2003), (2003, 2004), (2004, 2005)]
    table = spark.createDataFrame(ring + tail + [(5000, 5001)], "src long, dst long")
    assert {(x.src, x.dst) for x in graph.cycle_core(table).collect()} == set(ring)
    assert written.count("stretch") <= 6
    jump = graph.followed(table.select(F.lit(False).alias("back"), F.col("src").alias("id"), F.col("dst").alias("to")))
    assert {(x.id, x.to) for x in jump.filter("NOT on").collect()} == {(5000, 5001), *((i, 2005) for i in range(2001, 2005))} and jump.filter("on").count() == 500


def test_cyclic_flags_differ(spark):
    flags = {x.cyclic for x in registry.QUERIES["gr4_cyclic_transfers"](spark, "/root/testdata/sf0.01").select("cyclic").distinct().collect()}
    assert flags == {0, 1}


def test_cyclic_flags_are_of_every_transfer(spark):
    sf = "/root/testdata/sf0.001"
    flags = registry.QUERIES["gr4_cyclic_transfers"](spark, sf).select("tx_id")
    assert sorted(r.tx_id for r in flags.collect()) == sorted(r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").collect())


def test_strong_components_are_of_every_account(spark):
    sf = "/root/testdata/sf0.001"
    ends = source.transactions(spark, sf)
    ends = ends.select("sender").union(ends.select("receiver")).distinct()
    found = registry.QUERIES["gr4_strong_components"](spark, sf).select("id")
    assert sorted(r.id for r in found.collect()) == sorted(r.sender for r in ends.collect())


def test_components_are_not_broadcast(spark):
    """A table of ids in one component takes few bytes a row in its files; the joins with it shuffle all the same."""
    t = spark.range(2000).select(F.col("id").alias("tx_id"), F.lit(1.0).alias("amount"), F.col("id").alias("epoch"), F.lit(0).alias("is_laundering"))
    own = spark.range(2000).select("id", F.lit(0).cast("long").alias("component"))
    joins = []
    real, relational.materialise = relational.materialise, lambda df, tag: (joins.append(df._jdf.queryExecution().toString()) if tag == "members" else None, real(df, tag))[1]
    try:
        assert relational.component_features(t, own).first()["tx_count"] == 2000
    finally:
        relational.materialise = real
    assert len(joins) == 1 and "SortMergeJoin" in joins[0] and "BroadcastHashJoin" not in joins[0]


def betweenness_by_force(edges):
    near = {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, set()).update({y} - {x})
    out = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order = {s: 0}, Counter({s: 1}), [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        share = Counter()
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                out[w] += share[w] / 2
    return out


def test_betweenness_of_all_pivots_is_exact(spark):
    r = random.Random(25)
    edges = [(r.randrange(25), r.randrange(25)) for _ in range(36)] + [(50, 51), (51, 52), (60, 60)]
    want = betweenness_by_force(edges)
    table = spark.createDataFrame([*edges, edges[3]], "src long, dst long")
    got = {x.id: x.betweenness for x in graph.pivot_betweenness(table, pivots=1000).collect()}
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v]) for v in want)
    some = graph.pivot_betweenness(table, pivots=16).collect()
    assert len(some) == len(want) and sum(x.betweenness for x in some) == pytest.approx(sum(want.values()), rel=0.5)
    assert graph.pivot_betweenness(table.limit(0)).count() == 0


def test_betweenness_meets_an_edge_once_a_level(spark, monkeypatch):
    """Sixteen searches take a row a vertex and level, not one a pivot; more pivots than lanes are as exact."""
    sizes = []
    real = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, tag: (lambda out: (sizes.append(out.count()) if tag == "front" else None, out)[1])(real(df, tag)))
    r = random.Random(5)
    edges = list({(r.randrange(40), r.randrange(40)) for _ in range(150)})
    table = spark.createDataFrame(edges, "src long, dst long")
    n = len({v for e in edges for v in e})
    assert graph.pivot_betweenness(table, pivots=16).count() == n
    assert max(sizes) <= n
    monkeypatch.setattr(graph, "LANES", 3)
    small = edges[:30]
    want = betweenness_by_force(small)
    got = {x.id: x.betweenness for x in graph.pivot_betweenness(spark.createDataFrame(small, "src long, dst long"), pivots=50).collect()}
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v]) for v in want)


def test_convolution_gradients_equal_numpy(spark):
    r = np.random.default_rng(24)
    n, edges = 14, [(int(a), int(b)) for a, b in r.integers(0, 13, (24, 2))]
    x, y, train = r.random((n, 3)), r.integers(0, 2, n), r.random(n) < 0.7
    nodes = spark.createDataFrame([(i, int(y[i]), bool(train[i]), *map(float, x[i])) for i in range(n)], "id long, label int, train boolean, a double, b double, c double")
    table = spark.createDataFrame([*edges, edges[0], (3, 999)], "src long, dst long")
    model = convolution.Convolution(nodes, table, ["a", "b", "c"], hidden=5)
    near = np.eye(n)
    for a, b in edges:
        near[a, b] = near[b, a] = 1
    d = near.sum(1)
    near /= np.sqrt(np.outer(d, d))
    w1, b1, w2, b2 = model.network.weights

    def loss_of(weights):
        z = near @ np.maximum(near @ x @ weights[0] + weights[1], 0) @ weights[2] + weights[3]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return -np.log(p[np.arange(n), y])[train].mean()

    loss, found = model.gradients()
    assert loss == pytest.approx(loss_of([w1, b1, w2, b2]))
    for k, g in enumerate(found):  # against differences of the loss
        for at in np.ndindex(g.shape):
            moved = [[w.copy() for w in model.network.weights] for _ in range(2)]
            moved[0][k][at] += 1e-6
            moved[1][k][at] -= 1e-6
            assert g[at] == pytest.approx((loss_of(moved[0]) - loss_of(moved[1])) / 2e-6, abs=1e-6)
    assert model.fit(epochs=4, rate=0.05).losses[-1] < loss


def test_attributions_equal_sums_over_subsets(spark):
    """Of trees by hand, with numeric and categorical splits and a feature that is split twice: Shapley values by their definition."""
    rules = [(0, 0.5), (1, {0.0, 2.0}), (0, 0.2), (2, 0.7)]
    leaf = lambda v, *steps: attributions.Leaf(v, [(*rules[i], left, share) for i, left, share in steps])
    leaves = [leaf(1.5, (0, True, 0.6), (2, True, 0.5), (1, True, 0.3)), leaf(-2.0, (0, True, 0.6), (2, True, 0.5), (1, False, 0.7)), leaf(0.5, (0, True, 0.6), (2, False, 0.5)), leaf(3.0, (0, False, 0.4), (3, True, 0.25)), leaf(-1.0, (0, False, 0.4), (3, False, 0.75))]
    trees = attributions.Trees([(0.8, leaves), (0.3, [leaf(2.0, (3, True, 0.5)), leaf(-2.0, (3, False, 0.5))]), (1.0, [attributions.Leaf(0.25, [])])])
    r = random.Random(7)
    x = np.array([[r.random(), float(r.randrange(3)), r.random(), r.random()] for _ in range(40)])

    def worth(row, known):
        total = 0.0
        for weight, own in trees.leaves:
            for q in own:
                kept = q.keeps(row[None, :])[0]
                total += weight * q.value * math.prod(float(k) if f in known else z for f, k, z in zip(q.features, kept, q.share))
        return total

    found = trees.attributions(x)
    for row, got in zip(x, found):
        for f in range(4):
            others = [g for g in range(4) if g != f]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (worth(row, {*s, f}) - worth(row, set(s))) for k in range(4) for s in itertools.combinations(others, k))
            assert got[f] == pytest.approx(want)
    assert trees.margin(x) == pytest.approx(trees.mean + found.sum(1)) and not found[:, 3].any()


def test_attributions_of_a_fitted_model(spark):
    rows = spark.createDataFrame([(i, float(i % 17), "abc"[i % 3], float((i % 17 > 8) ^ (i % 3 == 1))) for i in range(400)], "tx_id long, amount double, kind string, label double")
    flow = learning.pipeline(["amount"], ["kind"], learning.models()["boosted"], one_hot=False).fit(rows)
    scored = flow.transform(rows)
    got = attributions.attribute(scored, attributions.trees_of(spark, flow.stages[-1]), learning.feature_names(scored))
    margins = {x.tx_id: x.rawPrediction[1] for x in scored.select("tx_id", "rawPrediction").collect()}
    found = got.collect()
    assert len(found) == 400 and got.columns == ["tx_id", "margin", "mean", "amount", "kind_ix"]
    for x in found:
        assert x.margin == pytest.approx(margins[x.tx_id]) and x.mean + x.amount + x.kind_ix == pytest.approx(x.margin)
    assert len({round(x.kind_ix, 6) for x in found}) > 2


def test_learned_risks_ignore_the_labels_of_other_parts(spark):
    rows = [(*x, i % 3, x[3] % 2) for i, x in enumerate(random_tx(31, 150, 30))]
    schema = "tx_id long, sender long, receiver long, epoch long, amount double, is_laundering int, part int, cyclic int"
    table = lambda rows: spark.createDataFrame(rows, schema).withColumn("label", F.col("is_laundering").cast("double"))
    risks = [{x.tx_id: x.risk for x in learning.learned_risks(table(r)).collect()} for r in (rows, [(*x[:5], 1 - x[5] if x[6] else x[5], *x[6:]) for x in rows])]
    assert risks[0] == risks[1] and len(set(risks[0].values())) > 20
    report = learning.risk_group_report(materialise(learning.learned_risks(table(rows)), "risks")).orderBy("part").collect()
    edges = {}
    for x in sorted(rows, key=lambda x: (x[3], x[0])):
        edges[x[1], x[2]] = risks[0][x[0]]
    for r in report:
        label = union_find([(0, a, b) for (a, b), w in edges.items() if w >= r.threshold] + [(0, v, v) for p in edges for v in p])[0]
        hits = Counter((x[5], int(label[x[1]] == label[x[2]])) for x in rows if x[6] == r.part)
        assert (r.tp, r.fp, r.tn, r.fn) == (hits[1, 1], hits[0, 1], hits[0, 0], hits[1, 0])


def test_ranked_edges_count_what_came_before(spark):
    rows = random_tx(41, 120, 12)
    edges = frame(spark, rows).select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), "epoch", "tx_id")
    got = Counter(tuple(x) for x in graph.ranked_edges(edges.repartition(3)).collect())
    want = Counter()
    for i, a, b, t, *_ in rows:
        own = sorted((y[3], y[0]) for y in rows if y[1] == a)
        want[a, own.index((t, i)) + 1, b, t, sum(y[1] == b and y[3] <= t for y in rows), sum(y[1] == b for y in rows)] += 1
    assert got == want


def test_ranked_walks_draw_all_later_edges_alike(spark):
    """A hub with 3,000 edges: a step has a row a walker, goes to later edges only, and every one of them is as likely."""
    hub = [(i, 0, 1 + i % 3, i, 1.0, 0) for i in range(3000)] + [(5000 + i, 10, 0, 2000 + i, 1.0, 0) for i in range(1)]
    edges = frame(spark, hub).select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), "epoch", "tx_id")
    groups = spark.createDataFrame([(i, 0) for i in (0, 1, 2, 3, 10)], "id long, component long")
    visits = {x.id: x.visits for x in graph.ranked_walks(edges, groups, walks=3000, steps=2).collect()}
    ends = visits[1] + visits[2] + visits[3]
    assert visits[0] + visits[10] >= 3000 and ends == 3000  # every walker leaves the hub once, and none goes on from its neighbours
    assert all(800 < visits[k] < 1200 for k in (1, 2, 3))
    alone = graph.ranked_walks(edges.limit(0), groups).collect()
    assert alone == []


@pytest.mark.parametrize("n", [1, 2, 5, 8, 13])
def test_seal_tree_proves_every_block(spark, n):
    import hashlib

    seals = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    level = list(seals)
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[i + 1]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    table = spark.createDataFrame(list(enumerate(seals)), "place long, hash string")
    tree = graph.seal_tree(table)
    assert [x.hash for x in tree.orderBy(F.desc("level")).limit(1).collect()] == level
    proofs = table.join(graph.seal_proofs(tree), "place")
    assert {x[0] for x in proofs.select(graph.sealed_root(F.col("hash"), F.col("path"))).collect()} == set(level) and proofs.count() == n
    wrong = proofs.select(graph.sealed_root(F.sha2("hash", 256), F.col("path"))).collect()
    assert not {x[0] for x in wrong} & set(level)


def test_seal_tree_takes_few_rounds(spark, monkeypatch):
    """Strides of two levels, so that 5, 16 and 37 seals are several rounds, and rounds are as many as strides, not levels."""
    import hashlib

    written = []
    real = graph.materialise
    monkeypatch.setattr(graph, "STRIDE", 2)
    monkeypatch.setattr(graph, "materialise", lambda df, tag: (written.append(tag), real(df, tag))[1])
    for n, strides in ((5, 2), (16, 2), (37, 3)):
        level = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        table, want, k = spark.createDataFrame(list(enumerate(level)), "place long, hash string"), {}, 0
        while True:
            want |= {(k, i): h for i, h in enumerate(level)}
            if len(level) == 1:
                break
            level, k = [hashlib.sha256((level[i] + level[i + 1]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)], k + 1
        written.clear()
        tree = graph.seal_tree(table)
        assert {(x.level, x.place): x.hash for x in tree.collect()} == want
        proofs = graph.seal_proofs(tree).select("place", "seal", graph.sealed_root(F.col("seal"), F.col("path")).alias("root")).collect()
        assert {x.place: x.seal for x in proofs} == {i: want[0, i] for i in range(n)} and {x.root for x in proofs} == set(level)
        assert len(written) == 1 + strides + strides - 1


def test_flow_seconds_report_both_flows(spark):
    t = frame(spark, random_tx(51, 80, 15))
    found = learning.flow_seconds(t, learning.stratified_folds(t, 2), 2).collect()
    assert [(x.flow, x.fold) for x in found] == [("raw", 0), ("grouped", 0), ("raw", 1), ("grouped", 1), ("raw", -1), ("grouped", -1)]
    assert all(x.train_rows == x.test_rows == 40 and x.seconds > 0 for x in found)
    for x in found[4:]:
        assert x.seconds == pytest.approx(sum(y.seconds for y in found[:4] if y.flow == x.flow) / 2)


def recorded(monkeypatch, module):
    """The tables that the module materialises from now on, as (tag, table, plan before it is written)."""
    seen, real = [], module.materialise

    def write(df, tag):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append((tag, real(df, tag), plan))
        return seen[-1][1]

    monkeypatch.setattr(module, "materialise", write)
    return seen


def test_instances_add_up_and_equal_rows_share_them(spark, monkeypatch):
    monkeypatch.setattr(learning, "INSTANCES", 10)
    rows = spark.range(1000).select((F.col("id") % 3).cast("double").alias("x"), F.when(F.col("id") < 7, F.col("id")).otherwise(0).alias("k"), (F.col("id") % 2).cast("double").alias("label"))
    groups = learning.grouped(rows, ["x", "k"])
    got = learning.instances(groups).collect()
    assert sum(r.weight for r in got) == 1000 and max(r.weight for r in got) <= 100 and len(got) < 40
    assert all(r.weight == int(r.weight) and r.weight > 0 for r in got)
    monkeypatch.setattr(learning, "INSTANCES", 1000)
    assert {r.weight for r in learning.instances(groups).collect()} == {1.0}


def test_ablation_of_equal_rows_counts_all_of_them(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 4).cast("double").alias("x"), F.concat(F.lit("k"), F.col("id") % 3).alias("k"), (((F.col("id") % 4) > 1) & (F.col("id") % 3 > 0)).cast("double").alias("label"))
    seen = recorded(monkeypatch, learning)
    got = learning.ablation(rows, rows, {"both": (["x"], ["k"])}, ["logistic", "tree"]).drop("seconds").orderBy("model").collect()
    assert {t: df.count() for t, df, _ in seen if t in ("train-groups", "test-groups")} == {"train-groups": 12, "test-groups": 12}
    for r, kind in zip(got, ("logistic", "tree")):
        one = learning.evaluate(rows, rows, learning.pipeline(["x"], ["k"], learning.models()[kind])).first()
        assert (r.model, r.tp, r.fp, r.tn, r.fn) == (kind, one.tp, one.fp, one.tn, one.fn) and r.tp + r.fp + r.tn + r.fn == 400


def test_walks_that_cannot_move_are_counted_not_drawn(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2, 5, 1), (2, 1, 6, 2), (7, 1, 5, 3)], "src long, dst long, epoch long, tx_id long")
    parts = spark.createDataFrame([(1, 1), (2, 1), (7, 7)], "id long, component long")
    seen = recorded(monkeypatch, graph)
    got = {(r.component, r.id): (r.visits, r.rate) for r in graph.ranked_walks(edges, parts).collect()}
    assert got[7, 7] == (100, 1.0) and got[1, 1][0] + got[1, 2][0] > 100
    assert all(df.filter("component = 7").isEmpty() for t, df, _ in seen if t == "walkers")


def test_picks_of_the_forest_and_the_merges_are_hashed_not_sorted(spark, monkeypatch):
    rows = [(i, i * 7 % 5, (i * 3 + 1) % 8, i % 4, float(i % 3)) for i in range(40)]
    tx = spark.createDataFrame(rows, "tx_id long, sender long, receiver long, epoch long, risk double")
    for module, run in ((graph, lambda: graph.temporal_forest(tx)), (merge_tree, lambda: merge_tree.merge_tree(tx.select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), "risk")))):
        seen = recorded(monkeypatch, module)
        run().collect()
        plans = [plan for t, _, plan in seen if t == "picked"]
        assert plans and not any("SortAggregate" in p for p in plans)


def test_cuts_join_each_end_once(spark):
    edges = spark.createDataFrame([(i, i + 1, float(i % 5)) for i in range(40)], "src long, dst long, risk double")
    tree = merge_tree.merge_tree(edges)
    got = merge_tree.last_cut(tree, spark.createDataFrame([(0, 4), (5, 7), (3, 3), (0, 99)], "src long, dst long"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Join") == 2
    assert {(r.src, r.dst): r.cut for r in got.collect()} == {(0, 4): 0.0, (5, 7): 0.0, (3, 3): float("inf"), (0, 99): None}


def test_merged_follows_long_lines_of_pointers(spark):
    rows = [(i, i - 1) for i in range(1, 50)] + [(0, 1)] + [(100, 101), (101, 100)]
    got = {r.id: r.component for r in merged(spark.createDataFrame(rows, "id long, to long")).collect()}
    assert got == {**dict.fromkeys(range(50), 0), 100: 100, 101: 100}
