"""Every query of the engine against its SQL, and that the registry holds without the llm subpackage."""

import importlib.util

import pytest

from oracle import actual, expected

SF = "/root/testdata/sf0.001"
import __spark_entry__ as entry  # noqa: E402
from cairn.plans import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert actual(registry.QUERIES[name](spark, SF)) == expected(SF, registry.ORACLE_SQL[name])


def test_entry_and_registry(spark):
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_registry_without_llm(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("cairn.llm", "corpus_pipeline")) else real(name, *a))
    assert set(entry.queries()) == set(registry.QUERIES)


@pytest.mark.parametrize("name", ["ml16_cross_validation", "ml16_leak_aware_validation", "ml5_grouped_logistic", "ml15_expanding_training"])
def test_fold_reports_are_whole(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    keys = [(getattr(r, "model", ""), r.fold) for r in rows]
    assert len(set(keys)) == len(keys) and {f for _, f in keys} >= {0, 1, 2, -1}
    assert all(0 <= r[n] <= 1 for r in rows for n in ("accuracy", "weighted_f1", "auc", "recall"))


def test_threshold_search_ends_at_its_best(spark):
    rows = registry.QUERIES["gr21_threshold_search"](spark, SF).orderBy("step").collect()
    best = max(rows, key=lambda r: (r.objective, -r.step))
    assert rows[-1].best == best.threshold and len(rows) <= 20


def test_models_find_what_makes_the_label(spark):
    """The label depends on the payment type alone, of the columns that models get: they rank better than chance by it, and attribute to it."""
    pooled = [r for r in registry.QUERIES["ml15_expanding_training"](spark, SF).collect() if r.fold == -1]
    assert pooled[0].auc > 0.8
    top = max(registry.QUERIES["ml11_importances"](spark, SF).collect(), key=lambda r: r.importance)
    assert top.feature.startswith("payment_type")
    sizes = {r.feature: r for r in registry.QUERIES["ml7_attributions"](spark, SF).collect()}
    assert max(sizes.values(), key=lambda r: r.mean_size).feature == "payment_type_ix" and all(r.margin_error < 1e-9 for r in sizes.values())


def test_graph_flows_run_as_queries(spark):
    row = registry.QUERIES["gr24_trained_convolution"](spark, SF).first()
    assert row.last_loss < row.first_loss and row.tp + row.fp + row.tn + row.fn > 0
    report = {r.part: r for r in registry.QUERIES["ml5_learned_edge_risks"](spark, SF).collect()}
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert report.keys() == {1, 2} and abs(sum(r.tp + r.fp + r.tn + r.fn for r in report.values()) - 0.3 * n) <= 4
    between = registry.QUERIES["gr25_pivot_betweenness"](spark, SF).collect()
    assert between and all(r.betweenness >= 0 for r in between) and max(r.betweenness for r in between) > 0


@pytest.mark.parametrize("name", ["ml7_boosted_trees", "ml11_importances", "ml17_ablation"])
def test_models_run_as_queries(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows and all(0 <= (r["importance"] if "importance" in r else r["f1"]) <= 1 for r in rows)


@pytest.mark.parametrize("name", ["ml5_logistic_time_split", "gr24_graph_convolution"])
def test_models_score_every_test_row(spark, name):
    row = registry.QUERIES[name](spark, SF).first()
    assert row["tp"] + row["fp"] + row["tn"] + row["fn"] > 0 and 0 <= row["accuracy"] <= 1
