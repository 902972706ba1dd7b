"""Splits, classifiers and their evaluation, over pyspark.ml.

Null features raise an error in the assembler, so fill them first; a null category is a value of its own. Folds and windows without rows on a side are left out; metrics whose
denominator is 0 are 0, and the AUC of one class is 0.5. Ids must be unique: equal ids share their fold.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import objective, uniform
from cairn.operators import merge_tree
from cairn.operators.components import connected_components
from cairn.operators.relational import chain_hubs, chunked, component_features, confusion, global_row_number, metrics, weighted
from cairn.operators.scratch import Growing, hashed, materialise


def stratified_folds(df: DataFrame, k: int, seed: int = 42, id_col: str = "tx_id", label: str = "is_laundering") -> DataFrame:
    """(id, fold): each label's rows in seeded order, dealt out in turn."""
    drawn = df.select(F.col(id_col), F.col(label).alias("_y"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")).alias("_u"))
    numbered = global_row_number(drawn, ["_y", "_u", id_col])
    return numbered.select(id_col, ((F.col("row_id") - 1) % k).cast("int").alias("fold"))


def stratified_split(df: DataFrame, shares: list[float], seed: int = 42, id_col: str = "tx_id", label: str = "is_laundering") -> DataFrame:
    """(id, part): each label's rows in seeded order, cut at floor(rows of the label * share)."""
    drawn = df.select(F.col(id_col), F.col(label).alias("_y"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")).alias("_u"))
    numbered = global_row_number(drawn, ["_y", "_u", id_col])
    sizes = numbered.groupBy("_y").agg(F.min("row_id").alias("_first"), F.count("*").alias("_n"))  # a row a label
    placed = numbered.join(F.broadcast(sizes), numbered["_y"].eqNullSafe(sizes["_y"])).withColumn("_at", F.col("row_id") - F.col("_first"))
    part = F.lit(len(shares) - 1)
    for i in range(len(shares) - 2, -1, -1):
        part = F.when(F.col("_at") < F.floor(F.col("_n") * round(sum(shares[: i + 1]), 9)), i).otherwise(part)
    return placed.select(id_col, part.alias("part"))


def random_split(df: DataFrame, shares: list[float], seed: int = 42, id_col: str = "tx_id") -> DataFrame:
    """The rows with ``part``, 0 up, by a hash of the id: the same in any run."""
    u, part, bound = uniform(seed, F.col(id_col).cast("string")), F.lit(len(shares) - 1), 1.0
    for i in range(len(shares) - 2, -1, -1):
        bound = sum(shares[: i + 1])
        part = F.when(u < bound, i).otherwise(part)
    return df.withColumn("part", part)


def time_split(df: DataFrame, shares: list[float], order: list[str]) -> DataFrame:
    """The rows with ``part``: the earliest share first, cut at floor(rows * share)."""
    n = df.count()
    numbered = global_row_number(df, order)
    part = F.lit(len(shares) - 1)
    for i in range(len(shares) - 2, -1, -1):
        part = F.when(F.col("row_id") <= int(n * sum(shares[: i + 1])), i).otherwise(part)
    return numbered.withColumn("part", part).drop("row_id")


def window_slices(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The rows with ``slice`` 0 to k: equal slices in order, floor(rows / (k + 1)) rows each; rows beyond them leave."""
    size = df.count() // (k + 1)
    return global_row_number(df, order).withColumn("slice", F.floor((F.col("row_id") - 1) / max(size, 1)).cast("int")).filter(F.col("slice") <= k).drop("row_id")


def expanding_windows(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """(fold, train_rows, test_rows, train_positive, test_positive): fold i trains on the first i + 1 of k + 1 equal slices and tests on the next."""
    by = window_slices(df, k, order).groupBy("slice").agg(F.count("*").alias("n"), F.sum("is_laundering").alias("p"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # k + 1 rows
    return by.select((F.col("slice") - 1).cast("long").alias("fold"), F.sum("n").over(before).alias("train_rows"), F.col("n").alias("test_rows"), F.sum("p").over(before).alias("train_positive"), F.col("p").alias("test_positive")).filter("fold >= 0")


def predictions(train: DataFrame, test: DataFrame, flow: Pipeline, id_col: str = "tx_id") -> DataFrame:
    """(id, label, predicted, score) of the test rows; score is the probability of class 1, or the margin of a model without probabilities. A train part of one class predicts it everywhere."""
    labels = [r["label"] for r in train.select("label").distinct().limit(2).collect()]
    if len(labels) < 2:
        only = float(labels[0]) if labels else 0.0
        return test.select(id_col, "label", F.lit(only).cast("int").alias("predicted"), F.lit(only).alias("score"))
    scored = flow.fit(train).transform(test)
    column = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.select(id_col, "label", F.col("prediction").cast("int").alias("predicted"), vector_to_array(column)[1].alias("score"))


def pooled_predictions(df: DataFrame, splits: list[tuple[str, str]], flow: Pipeline, id_col: str = "tx_id") -> DataFrame:
    """(fold, id, label, predicted, score): the out-of-fold predictions of all (train, test) conditions in one table. Folds without rows on a side are left out."""
    out = Growing(df.sparkSession, f"fold int, {id_col} {df.schema[id_col].dataType.simpleString()}, label double, predicted int, score double", "predictions")
    for i, (train, test) in enumerate(splits):
        a, b = df.filter(train), df.filter(test)
        if not a.isEmpty() and not b.isEmpty():
            out.add(predictions(a, b, flow, id_col).select(F.lit(i).alias("fold"), id_col, F.col("label").cast("double").alias("label"), "predicted", "score"))
    return out.read()


def fold_report(pooled: DataFrame) -> DataFrame:
    """(fold, accuracy, weighted_precision, weighted_recall, weighted_f1, precision, recall, f1, auc) of each fold, and fold -1: all predictions pooled."""
    names = ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1", "precision", "recall", "f1", "auc"]
    folds = [r["fold"] for r in pooled.select("fold").distinct().orderBy("fold").collect()]
    rows = []
    for fold in [*folds, -1]:
        own = (pooled if fold == -1 else pooled.filter(F.col("fold") == fold)).withColumn("y", F.col("label").cast("int"))
        found = {}
        for part in (weighted(by_class(own, "y", "predicted")), metrics(confusion(own, F.col("y"), F.col("predicted"))).select("precision", "recall", "f1"), auc(own, "y", "score")):
            found |= part.first().asDict()  # a row each
        rows.append((fold, *(found[n] for n in names)))
    return pooled.sparkSession.createDataFrame(rows, "fold int, " + ", ".join(f"{n} double" for n in names))


def _ranked_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    """(s, p, q, below_p, below_q): of every distinct score, positives, others, and their numbers at lower scores; found chunk by chunk."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    parts = chunked(by, ["s"], "scores")
    every = Window.orderBy("_p")  # a row a chunk
    offset = parts.groupBy("_p").agg(F.sum("p").alias("m"), F.sum("q").alias("n")).select("_p", (F.sum("m").over(every) - F.col("m")).alias("op"), (F.sum("n").over(every) - F.col("n")).alias("oq"))
    here = Window.partitionBy("_p").orderBy("s")
    local = parts.withColumns({"lp": F.sum("p").over(here) - F.col("p"), "lq": F.sum("q").over(here) - F.col("q")})
    return local.join(F.broadcast(offset), "_p").select("s", "p", "q", (F.col("lp") + F.col("op")).alias("below_p"), (F.col("lq") + F.col("oq")).alias("below_q"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve: the rank sum with ties counted half, over the distinct scores; 0.5 where a class is missing."""
    total = _ranked_scores(df, label, score).agg(F.sum(F.col("p") * (F.col("below_q") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return total.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))).otherwise(0.5).alias("auc"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr): the ROC curve at every distinct score, rows at or above it counted as positive; 0 where a class is missing."""
    ranked = materialise(_ranked_scores(df, label, score), "ranked-scores")
    total = ranked.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq")).first()
    share = lambda below, n: F.lit(0.0) if not n else (F.lit(n) - F.col(below)) / F.lit(n)
    return ranked.select(F.col("s").alias("threshold"), share("below_p", total["tp"]).alias("tpr"), share("below_q", total["tq"]).alias("fpr"))


def by_class(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, support, precision, recall, f1) of every class."""
    counts = df.groupBy(F.col(label).alias("a"), F.col(predicted).alias("b")).agg(F.count("*").alias("n"))
    side = lambda c, name, extra: counts.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(name), *extra)
    hit = [F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("tp")]
    rows = side("a", "support", hit).join(side("b", "claimed", []), "class", "full").na.fill(0)
    div = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return rows.select("class", "support", div(F.col("tp"), F.col("claimed")).alias("precision"), div(F.col("tp"), F.col("support")).alias("recall"), div(2 * F.col("tp"), F.col("claimed") + F.col("support")).alias("f1"))


def indexer(column: str, out: str, unseen: str = "keep") -> StringIndexer:
    """Codes from 0 in order of frequency, equal ones by value; unseen values get the next code (keep) or raise an error (error)."""
    return StringIndexer(inputCol=column, outputCol=out, handleInvalid=unseen, stringOrderType="frequencyDesc")


def one_hot(df: DataFrame, code: str, out: str) -> DataFrame:
    """The codes as arrays with a slot for each but the last, which is that of unseen values if the indexer keeps them."""
    model = OneHotEncoder(inputCols=[code], outputCols=["_hot"]).fit(df)
    return model.transform(df).withColumn(out, vector_to_array("_hot")).drop("_hot")


def models(seed: int = 42) -> dict[str, object]:
    common = {"labelCol": "label", "featuresCol": "features"}
    return {
        "logistic": LogisticRegression(maxIter=100, regParam=0.01, **common),
        "plain_logistic": LogisticRegression(**common),
        "tree": DecisionTreeClassifier(seed=seed, **common),
        "forest": RandomForestClassifier(numTrees=100, seed=seed, **common),
        "svm": LinearSVC(**common),
        "boosted": GBTClassifier(seed=seed, **common),
    }


def pipeline(numeric: list[str], categorical: list[str], model=None, one_hot: bool = True) -> Pipeline:
    """Indexers that keep unseen values, one-hot encoders, an assembler and the model, if there is one."""
    stages: list = [indexer(c, f"{c}_ix") for c in categorical]
    names = [f"{c}_ix" for c in categorical]
    if one_hot and categorical:
        stages.append(OneHotEncoder(inputCols=names, outputCols=[f"{c}_oh" for c in categorical]))
        names = [f"{c}_oh" for c in categorical]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*numeric, *names], outputCol="features"), *([model] if model else [])])


def evaluate(train: DataFrame, test: DataFrame, flow: Pipeline) -> DataFrame:
    """One row: tp, fp, tn, fn, accuracy, precision, recall, f1, seconds of fit and scoring."""
    began = time.time()
    scored = materialise(flow.fit(train).transform(test).select("label", F.col("prediction").cast("int").alias("predicted")), "scored")
    return metrics(confusion(scored, F.col("label"), F.col("predicted"))).withColumn("seconds", F.lit(time.time() - began))


#: Instances that equal rows are left in at least, however many they are: what a weighted deviation or a bootstrap of them can differ by is below one in so many.
INSTANCES = 1 << 18


def grouped(df: DataFrame, columns: list[str], extra: list[str] | None = None) -> DataFrame:
    """(columns, label, n): the distinct rows of features and label, and how many rows each stands for."""
    return df.groupBy(*columns, "label", *(extra or [])).agg(F.count("*").alias("n"))


def instances(groups: DataFrame) -> DataFrame:
    """The groups of ``grouped`` with ``weight``: whole numbers that add up to n, each at most a share 1 / ``INSTANCES`` of all rows.

    A group of more rows is several instances. So a table of up to 2 * INSTANCES rows is fitted row by row, and a larger one by as many instances as it has
    different rows, or little more. Every row counts in any case.
    """
    most = max(1, (groups.agg(F.sum("n").alias("n")).first()["n"] or 0) // INSTANCES)
    parts = F.ceil(F.col("n") / most)
    own = groups.withColumn("_parts", parts).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_parts"))))
    size = F.floor(F.col("n") / F.col("_parts")) + (F.col("_i") <= F.col("n") % F.col("_parts")).cast("long")
    return own.withColumn("weight", size.cast("double")).drop("n", "_parts", "_i")


def cross_validate(df: DataFrame, folds: DataFrame, flow: Pipeline, k: int, id_col: str = "tx_id") -> DataFrame:
    """(fold, id, label, predicted, score): the predictions for every fold by a model of the other folds."""
    rows = materialise(df.join(folds, id_col), "folds")
    return pooled_predictions(rows, [(f"fold != {i}", f"fold = {i}") for i in range(k)], flow, id_col)


# The names and order of the feature bundle.
FOLD_FEATURES = ["tx_count", "avg_amt", "std_amt", "max_amt", "min_amt", "avg_gap", "std_gap", "max_gap", "min_gap"]


def fold_features(tx: DataFrame, folds: DataFrame, fold: int) -> DataFrame:
    """(tx_id, test, features of ``FOLD_FEATURES``) of every transfer, from the transfers outside ``fold`` alone.

    Chain, components and component features are those of the train part; a transfer that is chained to none is a component of its own. A
    train transfer has the features of its component. A test transfer is in no component: it takes those of its sender's first
    train transfer (by time, then id), sent or received, and zeros where the sender has none. Labels are no input.
    """
    slim = tx.select("tx_id", "sender", "receiver", "amount", "epoch", "is_laundering")
    rows = materialise(slim.join(hashed(folds.select("tx_id", "fold")), "tx_id"), "fold-rows")
    train = rows.filter(F.col("fold") != fold).drop("fold")
    found = connected_components(chain_hubs(train))
    component = train.select(F.col("tx_id").alias("id")).join(hashed(found), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    component = materialise(component, "fold-components")
    features = materialise(component_features(train, component).select("component", *FOLD_FEATURES), "fold-features")
    key = F.struct("epoch", "tx_id")
    seen = train.select(F.col("sender").alias("account"), key.alias("k")).unionByName(train.select(F.col("receiver").alias("account"), key.alias("k")))
    first = seen.groupBy("account").agg(F.min("k").alias("k")).select(F.col("account").alias("sender"), F.col("k.tx_id").alias("id"))
    known = component.join(hashed(first), "id").select("sender", "component")
    own = component.select(F.col("id").alias("tx_id"), F.lit(False).alias("test"), "component")
    looked_up = rows.filter(F.col("fold") == fold).select("tx_id", "sender").join(known, "sender", "left").select("tx_id", F.lit(True).alias("test"), "component")
    return own.unionByName(looked_up).join(features, "component", "left").select("tx_id", "test", *FOLD_FEATURES).na.fill(0)


def group_fold_report(tx: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """``fold_report`` of the raw columns (model raw) and of the features of ``fold_features`` (model grouped), each fold by a logistic regression of the others."""
    tx = materialise(tx.select("tx_id", "sender", "receiver", "amount", "epoch", "is_laundering"), "fold-transfers")
    labels = tx.select("tx_id", F.col("is_laundering").cast("double").alias("label"))
    raw = cross_validate(tx.select("tx_id", "amount", "epoch", F.col("is_laundering").cast("double").alias("label")), folds, pipeline(["amount", "epoch"], [], models()["plain_logistic"]), k)
    flow = pipeline(FOLD_FEATURES, [], models()["plain_logistic"])
    grouped = Growing(tx.sparkSession, "fold int, tx_id long, label double, predicted int, score double", "predictions")
    for i in range(k):
        rows = materialise(fold_features(tx, folds, i).join(labels, "tx_id"), "fold-rows")
        train, test = rows.filter("NOT test"), rows.filter("test")
        if not train.isEmpty() and not test.isEmpty():
            grouped.add(predictions(train, test, flow).select(F.lit(i).alias("fold"), "tx_id", "label", "predicted", "score"))
    return fold_report(raw).withColumn("model", F.lit("raw")).unionByName(fold_report(grouped.read()).withColumn("model", F.lit("grouped")))


def flow_seconds(tx: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """(flow, fold, train_rows, test_rows, seconds) of the two flows of ``group_fold_report``, and of their means as fold -1: what a fold takes from
    its transfers to written predictions, with all that the flow needs for it (for grouped: chain, components and features of the train part)."""
    spark, flow_of = tx.sparkSession, {"raw": ["amount", "epoch"], "grouped": FOLD_FEATURES}
    labels = materialise(tx.select("tx_id", "amount", "epoch", F.col("is_laundering").cast("double").alias("label")).join(folds, "tx_id"), "fold-rows")
    rows: list[tuple] = []
    for fold in range(k):
        for name, columns in flow_of.items():
            began = time.time()
            known = labels.withColumn("test", F.col("fold") == fold)
            if name == "grouped":
                known = materialise(fold_features(tx, folds, fold).join(labels.select("tx_id", "label"), "tx_id"), "fold-rows")
            train, test = known.filter("NOT test"), known.filter("test")
            if train.isEmpty() or test.isEmpty():
                continue
            done = materialise(predictions(train, test, pipeline(columns, [], models()["plain_logistic"])), "timed")
            rows.append((name, fold, labels.filter(F.col("fold") != fold).count(), done.count(), time.time() - began))
    for name in flow_of:
        own = [r for r in rows if r[0] == name]
        if own:
            rows.append((name, -1, *(round(sum(r[i] for r in own) / len(own)) for i in (2, 3)), sum(r[4] for r in own) / len(own)))
    return spark.createDataFrame(rows, "flow string, fold int, train_rows long, test_rows long, seconds double")


EDGE_FEATURES = ["amount", "second_of_day", "cyclic"]


def learned_risks(rows: DataFrame) -> DataFrame:
    """The rows with ``risk``: the probability of class 1 by a logistic regression of ``EDGE_FEATURES`` that is fitted to the rows of part 0 alone.

    A part 0 of one class gives every row that class as its risk.
    """
    known = rows.withColumn("second_of_day", F.pmod("epoch", F.lit(86400)))
    train = known.filter("part = 0")
    scored = predictions(train, known, pipeline(EDGE_FEATURES, [], models()["plain_logistic"])).select("tx_id", F.col("score").alias("risk"))
    return rows.join(scored, "tx_id")


def risk_group_report(rows: DataFrame) -> DataFrame:
    """(part, threshold, tp, fp, tn, fn, accuracy, precision, recall, f1) of predicting that a transfer within a group of accounts is of class 1.

    ``rows`` are transfers with part and risk. An account pair has the risk of its latest transfer; groups of all thresholds come from one tree of merges; the
    threshold of the best objective on part 1, the highest of equals, is used on part 1 and on part 2.
    """
    edges = rows.groupBy(F.col("sender").alias("src"), F.col("receiver").alias("dst")).agg(F.max_by("risk", F.struct("epoch", "tx_id")).alias("risk"))
    edges = materialise(edges, "learned-edges")
    cut = materialise(merge_tree.transfer_cuts(rows.select("tx_id", "sender", "receiver", "is_laundering", "part"), merge_tree.merge_tree(edges)), "learned-cuts")
    every = materialise(metrics(merge_tree.scores_by_cut(cut.filter("part = 1"), edges)), "thresholds")
    best = every.orderBy(F.desc(objective(F.col("recall"), F.col("f1"))), F.desc("threshold")).select("threshold").first()  # one row
    threshold = best["threshold"] if best else float("inf")
    predicted = cut.withColumn("predicted", F.coalesce((F.col("cut") >= threshold).cast("int"), F.lit(0)))
    report = lambda part: metrics(confusion(predicted.filter(F.col("part") == part), F.col("is_laundering"), F.col("predicted"))).withColumn("part", F.lit(part))
    return report(1).unionByName(report(2)).withColumn("threshold", F.lit(threshold))


def ablation(train: DataFrame, test: DataFrame, modes: dict[str, tuple[list[str], list[str]]], kinds: list[str]) -> DataFrame:
    """Every feature mode with every model: the columns of ``evaluate``, mode and model.

    Of a mode, equal rows are fitted as weighted ``instances`` and scored once; categories are numbered by all train rows.
    """
    rows = []
    for mode, (numeric, categorical) in modes.items():
        columns = [*numeric, *categorical]
        features = pipeline(numeric, categorical).fit(train.select(*columns))
        known = materialise(grouped(train, columns), "train-groups")
        fitted = materialise(features.transform(instances(known)).select("features", "label", "weight"), "train-instances")
        tested = materialise(features.transform(grouped(test, columns)).select("features", "label", "n"), "test-groups")
        for kind in kinds:
            began = time.time()
            scored = models()[kind].setWeightCol("weight").fit(fitted).transform(tested)
            counts = materialise(confusion(scored, F.col("label"), F.col("prediction").cast("int"), F.col("n")), "counts")
            rows.append(metrics(counts).withColumns({"seconds": F.lit(time.time() - began), "mode": F.lit(mode), "model": F.lit(kind)}))
    return materialise(reduce(DataFrame.unionByName, rows), "ablation")


def feature_names(assembled: DataFrame, column: str = "features") -> list[str]:
    """The names of the slots of an assembled vector, from the metadata that indexers, encoders and assembler leave."""
    groups = assembled.schema[column].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a.get("name", f"{column}_{a['idx']}")) for kind in groups.values() for a in kind)
    return [name for _, name in slots]


def importances(flow_model, df: DataFrame, k: int = 10) -> list[tuple[str, float]]:
    """The k features of greatest importance or absolute coefficient, by name: a slot of an encoded column has the column's name and the value."""
    last = flow_model.stages[-1]
    weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return sorted(zip(feature_names(flow_model.transform(df)), (abs(float(w)) for w in weights.toArray())), key=lambda x: (-x[1], x[0]))[:k]
