"""Levels and risks of the temporal chain by one sweep over blocks of time."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.relational import chunked
from cairn.operators.scratch import Growing, materialise, shuffled

#: Of an account that was paid, but by no transfer that has a level.
BLOCKED = (-1, float("-inf"))
NEVER = -(1 << 63)
NAMES = ["id", "level", "risk", "account", "next"]


def time_blocks(tx: DataFrame, block_rows: int) -> DataFrame:
    """The rows with block and ``at``: at most ``block_rows`` consecutive rows of the order (epoch, tx_id), and the place of the block in time.

    A row of a greater ``at`` is later than all rows of a lesser one. Blocks that share an instant give it a part of its own in each of them, all at one
    ``at``, so an instant may hold any share of the rows.
    """
    here = Window.partitionBy("_p").orderBy("epoch", "tx_id")
    parts = chunked(tx, ["epoch", "tx_id"], "time")
    rows = materialise(parts.withColumn("block", F.shiftleft(F.col("_p").cast("long"), 32) + F.floor((F.row_number().over(here) - 1) / block_rows)).drop("_p"), "blocks")
    ends = materialise(rows.groupBy("block").agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi")), "block-ends")
    shared = ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("epoch")).groupBy("epoch").count().filter("count > 1").select("epoch", F.lit(1).alias("shared"))
    flags = lambda end: shared.select(F.col("epoch").alias(end), F.col("shared").alias(f"{end}_shared"))
    ends = ends.join(flags("lo"), "lo", "left").join(flags("hi"), "hi", "left").na.fill(0, ["lo_shared", "hi_shared"])
    alone = F.expr("epoch = lo AND lo_shared = 1 OR epoch = hi AND hi_shared = 1")
    return rows.join(ends, "block").withColumn("at", F.when(alone, F.col("epoch")).otherwise(F.col("lo") + F.col("lo_shared"))).select(*rows.columns, "at")


def _values(rows: pa.Table, name: str, missing=None) -> list:
    """A column as a list, numbers by way of numpy; ``missing`` stands for nulls of numbers."""
    column = rows[name] if missing is None else pc.fill_null(rows[name], missing)
    return column.to_pylist() if column.null_count or pa.types.is_string(column.type) else column.to_numpy().tolist()


def _swept(rows: pa.Table, given: pa.Table) -> pa.Table:
    """(id, level, risk) of the rows of a block, and (account, level, risk, next): what the later block ``next``, by its place in time, must know of an account."""
    rows, levels, risks = rows.sort_by("epoch"), {}, {}  # of the accounts; level -1: paid, but by no transfer that has a level
    said = [*zip(*(_values(given, c) for c in ("account", "level", "risk")))]
    senders, receivers = _values(rows, "sender"), _values(rows, "receiver")
    found, now = [], None
    columns = _values(rows, "tx_id"), senders, receivers, _values(rows, "epoch"), _values(rows, "w", float("nan")), _values(rows, "has_out")
    for i, sender, receiver, epoch, w, on in zip(*columns):
        if epoch != now:  # equal times don't follow each other
            _told(levels, risks, said)
            said, now = [], epoch
        level, risk = levels.get(sender), 0.0
        if level is None:
            level = 0
        elif level < 0 or w != w:
            level, risk = BLOCKED
        else:
            level, risk = level + 1, risks[sender] + w
        if level > 0 or (on and level == 0):
            found.append((i, level, risk))
        if receiver is not None:
            said.append((receiver, level, risk))
    _told(levels, risks, said)
    later = {}
    for accounts, end in ((senders, "sender"), (receivers, "receiver")):
        later.update((a, n) for a, n in zip(accounts, _values(rows, f"{end}_next", NEVER)) if n != NEVER and a in levels)
    mail = sorted(later, key=later.get)
    ids, at_level, at_risk = zip(*found) if found else ((), (), ())
    n, kind = len(ids), lambda c: rows.schema.field(c).type
    own = pa.table([pa.array(ids, kind("tx_id")), pa.array(at_level, pa.int32()), pa.array(at_risk, pa.float64()), pa.nulls(n, kind("sender")), pa.nulls(n, pa.int64())], NAMES)
    told = [pa.nulls(len(mail), kind("tx_id")), pa.array([levels[a] for a in mail], pa.int32()), pa.array([risks[a] for a in mail], pa.float64()), pa.array(mail, kind("sender")), pa.array([later[a] for a in mail], pa.int64())]
    return pa.concat_tables([own, pa.table(told, NAMES)])


def _told(levels: dict, risks: dict, said: list) -> None:
    for account, level, risk in said:
        before = levels.get(account)
        if before is None:
            levels[account], risks[account] = level, risk
        else:
            if level > before:
                levels[account] = level
            if risk > risks[account]:
                risks[account] = risk


def routed(rows: DataFrame) -> DataFrame:
    """The rows with ``sender_next`` and ``receiver_next``: the least later ``at`` of a row that the account sends, null where it sends no more."""
    asks = rows.select(F.col("sender").alias("account"), "at", F.lit(1).alias("asks")).distinct()
    named = rows.select(F.col("receiver").alias("account"), "at", F.lit(0).alias("asks")).distinct()
    places = asks.unionByName(named).filter("account IS NOT NULL").groupBy("account", "at").agg(F.max("asks").alias("asks"))
    later = Window.partitionBy("account").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    routes = materialise(places.withColumn("next", F.min(F.when(F.col("asks") == 1, F.col("at"))).over(later)).filter("next IS NOT NULL").select("account", "at", "next"), "routes")
    to = lambda end: shuffled(routes.select(F.col("account").alias(end), "at", F.col("next").alias(f"{end}_next")))
    return rows.join(to("sender"), ["sender", "at"], "left").join(to("receiver"), ["receiver", "at"], "left")


def chain_levels(tx: DataFrame, weights: DataFrame, block_rows: int = 1 << 20) -> DataFrame:
    """(id, level, risk) of the transfers of the temporal chain: steps of the longest path to it, and the greatest sum of weights of a path from a
    transfer without predecessor, whose own weight doesn't count. ``weights`` are (id, w); the times must be whole numbers.

    Blocks of ``block_rows`` rows are swept in order of time, each once, by a task that holds one block. What a block says of an account, it writes for the next block in which the
    account sends, which is known beforehand; that block says it on. So a block reads what is meant for it, and work and written rows follow the transfers, whatever the length of paths. Blocks that share an instant
    tell each other nothing and are swept at once. No edge of the chain is made.

    A transfer without a weight, or with a null or NaN one, has no level and passes none on unless it has no predecessor. Transfers that neither follow nor are followed are left out, and
    so are those without a time. A null account pays and is paid by nobody. Repeated rows count once; an id takes the greatest of its rows.
    """
    last = tx.filter("sender IS NOT NULL AND epoch IS NOT NULL").groupBy(F.col("sender").alias("receiver")).agg(F.max("epoch").alias("last"))
    known = weights.filter("w IS NOT NULL AND NOT isnan(w)").groupBy(F.col("id").alias("tx_id")).agg(F.max("w").cast("double").alias("w"))
    slim = tx.filter("epoch IS NOT NULL").select("tx_id", "sender", "receiver", F.col("epoch").cast("long").alias("epoch")).distinct()
    slim = slim.join(shuffled(last), "receiver", "left").join(shuffled(known), "tx_id", "left").select("tx_id", "sender", "receiver", "epoch", "w", F.coalesce(F.col("last") > F.col("epoch"), F.lit(False)).alias("has_out"))
    rows = materialise(time_blocks(materialise(slim, "slim"), block_rows), "time-blocks")
    plan = materialise(routed(rows).repartition("block").sortWithinPartitions("at"), "routed")
    steps = defaultdict(list)
    for r in rows.select("at", "block").distinct().collect():  # a row a block
        steps[r["at"]].append(r["block"])
    kinds = dict(rows.dtypes)
    schema = f"id {kinds['tx_id']}, level int, risk double, account {kinds['sender']}, next long"
    swept = Growing(rows.sparkSession, schema, "swept")
    for at in sorted(steps):
        given = swept.read().filter(F.col("next") == at).select("account", "level", "risk", F.explode(F.lit(steps[at])).alias("block"))
        own = plan.filter(F.col("at") == at)
        swept.add(own.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_swept, schema))
    return swept.read().filter("id IS NOT NULL").groupBy("id").agg(F.max("level").alias("level"), F.max("risk").alias("risk"))
