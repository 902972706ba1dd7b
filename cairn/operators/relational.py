"""Relational operators: null handling, chains, first and last wins, ranks, global row numbers and confusion metrics.

Null keys join nothing, are no account, and are a group of their own in aggregates; null values are left out of aggregates; empty tables
give empty tables, and counts of 0. Ties are settled by the id that the order names. Extra columns are ignored where a result lists its columns, and kept where it says the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.scratch import hashed, materialise, shuffled


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls, total) from one aggregate over the table."""
    one = df.agg(F.count("*").alias("total"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.unpivot("total", columns, "column_name", "nulls").select("column_name", "nulls", "total")


def present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that the table has."""
    return df.select(*(c for c in wanted if c in df.columns))


def temporal_chain(tx: DataFrame) -> DataFrame:
    """(src, dst): the receiver of src sends dst, and src comes strictly earlier."""
    a = tx.select(F.col("tx_id").alias("src"), F.col("receiver").alias("account"), F.col("epoch").alias("before"))
    b = tx.select(F.col("tx_id").alias("dst"), F.col("sender").alias("account"), F.col("epoch").alias("after"))
    return a.join(b, "account").filter("before < after").select("src", "dst")


def chain_base(tx: DataFrame) -> DataFrame:
    """The temporal chain without its pairs: receipts and sends of every account as one table (account, epoch, send, tx_id, _p), in chunks of (account, epoch)."""
    got = tx.select(F.col("receiver").alias("account"), "epoch", F.lit(False).alias("send"), "tx_id")
    sent = tx.select(F.col("sender").alias("account"), "epoch", F.lit(True).alias("send"), "tx_id")
    return chunked(got.unionByName(sent).filter("account IS NOT NULL AND epoch IS NOT NULL"), ["account", "epoch"], "chain")


class Chain:
    """The temporal chain of transfers: src comes before dst if the receiver of src sends dst, strictly later.

    An account with n receipts and m sends has up to n * m pairs. Here they are never made: what all earlier receipts have to say to a
    send is a running aggregate over the account's rows in order of time, so every step takes as many rows as the transfers it touches.
    Accounts whose rows lie in several chunks hand their aggregate from chunk to chunk.
    """

    def __init__(self, tx: DataFrame):
        self.base = chain_base(tx)
        self.spans = spanning(self.base, "account")
        self.tx = tx

    def ends(self) -> DataFrame:
        """(id, has_in, has_out) of every transfer: does the chain reach it, does it go on from it?"""
        by = self.base.groupBy("account").agg(F.min(F.when(~F.col("send"), F.col("epoch"))).alias("first"), F.max(F.when(F.col("send"), F.col("epoch"))).alias("last"))
        by = materialise(by, "account-ends")
        at = lambda end, value: by.select(F.col("account").alias(end), value)
        rows = self.tx.select("tx_id", "sender", "receiver", "epoch").join(at("sender", "first"), "sender", "left").join(at("receiver", "last"), "receiver", "left")
        return rows.select(F.col("tx_id").alias("id"), F.coalesce(F.col("first") < F.col("epoch"), F.lit(False)).alias("has_in"), F.coalesce(F.col("last") > F.col("epoch"), F.lit(False)).alias("has_out"))

    def _running(self, givers: DataFrame, send: bool, how, pick, later: bool) -> DataFrame:
        """(id, v) of the rows of the other kind: ``how`` over the values v of the givers (_p, account, epoch, v) of their account that are strictly earlier (or later)."""
        takers = self.base.filter(F.col("send") != send).join(givers.select("account").distinct(), "account", "left_semi")
        kind = givers.schema["v"].dataType
        rows = givers.select("_p", "account", "epoch", F.lit(None).cast("long").alias("id"), "v").unionByName(takers.select("_p", "account", "epoch", F.col("tx_id").alias("id"), F.lit(None).cast(kind).alias("v")))
        sign = F.lit(-1 if later else 1)
        here = Window.partitionBy("_p", "account").orderBy(sign * F.col("epoch")).rangeBetween(Window.unboundedPreceding, -1)
        own = givers.join(F.broadcast(self.spans), ["account", "_p"]).groupBy("account", "_p").agg(how("v").alias("s"))
        passed = how("s").over(Window.partitionBy("account").orderBy(sign * F.col("_p")).rowsBetween(Window.unboundedPreceding, -1))
        carry = self.spans.join(own, ["account", "_p"], "left").select("account", "_p", passed.alias("carry"))
        out = rows.withColumn("local", how("v").over(here)).filter("id IS NOT NULL").join(F.broadcast(carry), ["account", "_p"], "left")
        return out.select("id", pick("local", "carry").alias("v")).filter("v IS NOT NULL")

    def forward(self, values: DataFrame, how=F.min, pick=F.least) -> DataFrame:
        """(id, v): for every transfer that follows some of ``values`` (id, v) in the chain, the aggregate of their v."""
        givers = self.base.filter("NOT send").join(values.select(F.col("id").alias("tx_id"), "v"), "tx_id")
        return self._running(givers, False, how, pick, False)

    def successors(self) -> DataFrame:
        """(src, dst): every transfer's earliest successor, the least id of equals."""
        givers = self.base.filter("send").withColumn("v", F.struct("epoch", F.col("tx_id").alias("next")))
        return self._running(givers, True, F.min, F.least, True).select(F.col("id").alias("src"), F.col("v.next").alias("dst"))


def unreached(tx: DataFrame) -> DataFrame:
    """(tx_id) of the transfers that no other comes before in the chain: their sender has no earlier receipt."""
    first = tx.groupBy(F.col("receiver").alias("sender")).agg(F.min("epoch").alias("first"))
    return tx.select("tx_id", "sender", "epoch").join(first, "sender", "left").filter("first IS NULL OR first >= epoch").select("tx_id")


def chain_hubs(tx: DataFrame) -> DataFrame:
    """(src, dst) with the components of ``temporal_chain`` from at most two edges a transfer.

    Of an account, every receipt before its last send and every send after its first receipt are connected:
    the first receipt and the last send are chained to all of them.
    """
    receipts = tx.groupBy(F.col("receiver").alias("account")).agg(F.min("epoch").alias("lo"), F.min_by("tx_id", "epoch").alias("lo_tx"))  # of equals any will do
    sends = tx.groupBy(F.col("sender").alias("account")).agg(F.max("epoch").alias("hi"), F.max_by("tx_id", "epoch").alias("hi_tx"))
    hub = hashed(receipts.join(hashed(sends), "account").filter("lo < hi"))
    into = tx.select(F.col("receiver").alias("account"), "epoch", "tx_id").join(hub, "account").filter("epoch < hi").select(F.col("tx_id").alias("src"), F.col("hi_tx").alias("dst"))
    out = tx.select(F.col("sender").alias("account"), "epoch", "tx_id").join(hub, "account").filter("epoch > lo").select(F.col("lo_tx").alias("src"), F.col("tx_id").alias("dst"))
    return into.unionByName(out)


def first_send(tx: DataFrame) -> DataFrame:
    """(src, dst, account): each receipt with the account's first send, if the receipt is earlier."""
    first = tx.groupBy(F.col("sender").alias("account")).agg(F.min(F.struct("epoch", "tx_id")).alias("f"))
    got = tx.select(F.col("receiver").alias("account"), F.struct("epoch", "tx_id").alias("r"))
    return got.join(first, "account").filter("r < f").select(F.col("r.tx_id").alias("src"), F.col("f.tx_id").alias("dst"), "account")


def touching(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transfers whose sender or receiver is among the accounts (column ``account``)."""
    known = accounts.select("account").distinct()
    sends = known.select(F.col("account").alias("sender"), F.lit(True).alias("_s"))
    gets = known.select(F.col("account").alias("receiver"), F.lit(True).alias("_r"))
    return tx.join(sends, "sender", "left").join(gets, "receiver", "left").filter("_s OR _r").select(*tx.columns)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (column ``id``)."""
    known = nodes.select("id").distinct()
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def last_wins(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_wins(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def degrees(tx: DataFrame) -> DataFrame:
    """(account, out_degree, in_degree) by transfers."""
    out = tx.groupBy(F.col("sender").alias("account")).agg(F.count("*").alias("out_degree"))
    into = tx.groupBy(F.col("receiver").alias("account")).agg(F.count("*").alias("in_degree"))
    return out.join(into, "account", "full").na.fill(0, ["out_degree", "in_degree"])


def chunked(df: DataFrame, order: list[str], tag: str = "chunks") -> DataFrame:
    """The rows, written in chunks of a total order: range partitions, numbered ``_p``. Rows that are equal in ``order`` share a chunk."""
    return materialise(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), tag)


def global_row_number(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """1-based place of every row in a total order, without one task that holds all rows.

    Rows are range-partitioned and numbered within their partitions; the partitions' sizes, one number each, give the offsets.
    Nulls come first. An empty table gives an empty table.
    """
    parts = chunked(df, order, "ranges")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    offset = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_l", local).join(F.broadcast(offset), "_p").withColumn(name, F.col("_l") + F.col("_o")).drop("_p", "_l", "_o")


def spanning(parts: DataFrame, key: str) -> DataFrame:
    """(key, _p) of the keys that lie in several chunks of an order that begins with the key: two keys a chunk at most, and their chunks."""
    ends = materialise(parts.groupBy("_p").agg(F.min(key).alias("a"), F.max(key).alias("b")), "chunk-ends")
    keys = ends.select(F.col("a").alias(key)).union(ends.select("b")).groupBy(key).count().filter("count > 1").select(key)
    return materialise(parts.join(F.broadcast(keys), key, "left_semi").select(key, "_p").distinct(), "spanning-keys")


def previous(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """The rows with the ``value`` of the row before in the total order within their key; null for a key's first row.

    A key of any number of rows is spread over tasks: only the last row of each chunk is handed on. Rows without a key have no row before them.
    """
    every = chunked(df, [key, *order])
    parts = every.filter(F.col(key).isNotNull())
    spans = spanning(parts, key)
    last = parts.join(F.broadcast(spans), [key, "_p"]).groupBy(key, "_p").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_v"))
    carry = last.select(key, "_p", F.lag("_v").over(Window.partitionBy(key).orderBy("_p")).alias("_c"))
    here = Window.partitionBy("_p", key).orderBy(*order)
    rows = parts.withColumn("_first", F.row_number().over(here) == 1).withColumn("_own", F.lag(value).over(here)).join(F.broadcast(carry), [key, "_p"], "left")
    out = rows.withColumn(name, F.when(F.col("_first"), F.col(f"_c.{value}")).otherwise(F.col("_own"))).select(*df.columns, name)
    return out.unionByName(every.filter(F.col(key).isNull()).withColumn(name, F.lit(None).cast(df.schema[value].dataType)).select(*df.columns, name))


def running_totals(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """The rows with below_<value>: the sum of each value over the rows of lower ``order``, which must be unique; found chunk by chunk."""
    parts = chunked(df, [order], "running")
    every = Window.orderBy("_p")  # a row a chunk
    sums = parts.groupBy("_p").agg(*(F.sum(v).alias(v) for v in values)).select("_p", *((F.sum(v).over(every) - F.col(v)).alias(f"_o_{v}") for v in values))
    here = Window.partitionBy("_p").orderBy(order)
    local = parts.select("*", *((F.sum(v).over(here) - F.col(v)).alias(f"_l_{v}") for v in values)).join(F.broadcast(sums), "_p")
    return local.select(*df.columns, *((F.col(f"_l_{v}") + F.col(f"_o_{v}")).alias(f"below_{v}") for v in values))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of a total order, for an n of any size: rows are numbered chunk by chunk, not gathered in one task."""
    return global_row_number(df, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def top_with_ties(df: DataFrame, score: str, n: int) -> DataFrame:
    """Rows whose score is at least the n-th highest."""
    cut = df.orderBy(F.desc(score)).limit(n).agg(F.min(score).alias("c"))
    return df.filter(F.col(score) >= cut.scalar())


def weighted(by: DataFrame) -> DataFrame:
    """accuracy, weighted_precision, weighted_recall and weighted_f1, by support, of rows (class, support, precision, recall, f1)."""
    mean = lambda c: (F.sum(F.col("support") * F.col(c)) / F.sum("support"))
    return by.agg(mean("recall").alias("accuracy"), mean("precision").alias("weighted_precision"), mean("recall").alias("weighted_recall"), mean("f1").alias("weighted_f1"))


def confusion(df: DataFrame, label: Column, predicted: Column, n: Column | None = None) -> DataFrame:
    """tp, fp, tn, fn in one pass; a row counts as ``n`` rows, or as one."""
    count = lambda c: F.count_if(c) if n is None else F.coalesce(F.sum(F.when(c, n)), F.lit(0).cast("long"))
    hit = lambda a, b: count((label == a) & (predicted == b))
    return df.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))


def metrics(counts: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """accuracy, precision, recall and f1 of tp, fp, tn, fn; 0 where a denominator is 0. ``epsilon`` is added to the denominators."""
    ratio = lambda a, b: F.when(b > 0, a / (b + epsilon)).otherwise(0.0)
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return counts.select("*", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def component_features(tx: DataFrame, components: DataFrame) -> DataFrame:
    """Count, mean, sample deviation and extremes of amounts and of time gaps by component, and the highest label.

    Gaps are found chunk by chunk, so that a component of any size is the work of many tasks. Means are of exact decimals, so they are the same in any order of rows. Missing statistics are 0.
    """
    own = materialise(tx.join(shuffled(components.select(F.col("id").alias("tx_id"), "component")), "tx_id").select("tx_id", "component", "epoch", "amount", "is_laundering"), "members")
    gap = F.col("epoch") - F.col("before")
    exact = F.sum(F.col("amount").cast("decimal(18,2)")).cast("double")
    out = previous(own, "component", ["epoch", "tx_id"], "epoch", "before").withColumn("gap", gap).groupBy("component").agg(
        F.min("epoch").alias("start_ts"),
        F.count("epoch").alias("tx_count"),
        F.round(exact / F.count("amount"), 6).alias("avg_amt"),
        F.round(F.stddev_samp("amount"), 3).alias("std_amt"),
        F.max("amount").alias("max_amt"),
        F.min("amount").alias("min_amt"),
        F.round(F.sum("gap").cast("double") / F.count("gap"), 6).alias("avg_gap"),
        F.round(F.stddev_samp("gap"), 3).alias("std_gap"),
        F.max("gap").alias("max_gap"),
        F.min("gap").alias("min_gap"),
        F.max("is_laundering").alias("label"),
    )
    return out.na.fill(0)
