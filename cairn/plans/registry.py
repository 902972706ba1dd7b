"""The queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalar
from cairn.operators import attributions, convolution, graph, learning, merge_tree, relational, strong, sweep
from cairn.operators.components import connected_components
from cairn.operators.scratch import hashed, materialise, shared_dir
from cairn.sources import transactions as source
from cairn.streaming import transfers as streaming

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "agg1_features_of_large"
#: Amounts from which transfers are few enough to fall into many components.
LARGEST = 475000

TXN = """WITH RECURSIVE txn AS (
SELECT o_orderkey AS tx_id, o_custkey AS sender, (o_custkey*7 + o_orderkey*13) % (SELECT count(*) FROM customer) AS receiver, o_totalprice AS amount,
  CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey*7919) % 86400 AS epoch, o_orderpriority AS payment_type, sc.c_mktsegment AS payment_currency,
  rc.c_mktsegment AS received_currency, sn.n_name AS sender_bank_location, rn.n_name AS receiver_bank_location,
  CASE WHEN o_orderstatus='F' AND o_orderpriority='1-URGENT' THEN 1 ELSE 0 END AS is_laundering, o_orderstatus AS laundering_type
FROM orders JOIN customer sc ON sc.c_custkey = o_custkey
JOIN customer rc ON rc.c_custkey = (o_custkey*7 + o_orderkey*13) % (SELECT count(*) FROM customer)
JOIN nation sn ON sn.n_nationkey = sc.c_nationkey JOIN nation rn ON rn.n_nationkey = rc.c_nationkey),
chain AS (SELECT a.tx_id AS src, b.tx_id AS dst, b.epoch AS dst_epoch FROM txn a JOIN txn b ON a.receiver = b.sender AND a.epoch < b.epoch),
scored AS (SELECT *, CASE WHEN is_laundering = 1 THEN 1.5 ELSE 0.0 END + CASE WHEN amount > 5000 THEN 1.0 ELSE 0.0 END
  + CASE WHEN (epoch % 86400) // 3600 < 6 OR (epoch % 86400) // 3600 > 22 THEN 0.5 ELSE 0.0 END AS risk FROM txn),
pairs AS (SELECT sender AS src, receiver AS dst, CAST(arg_max(risk, epoch * 10000000 + tx_id) AS DOUBLE) AS risk FROM scored GROUP BY ALL)
"""
#: Components of the links l(a, b) over the vertices vs(id): cc(n, c).
COMPONENTS = """, ed AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
cc(n, c) USING KEY (n) AS (
  SELECT a, min(least(a, b)) FROM ed GROUP BY a
  UNION (SELECT ed.b, min(cc.c) FROM cc JOIN ed ON cc.n = ed.a JOIN recurring.cc AS old ON old.n = ed.b WHERE cc.c < old.c GROUP BY ed.b)),
comp AS (SELECT vs.id, coalesce(cc.c, vs.id) AS component FROM vs LEFT JOIN cc ON cc.n = vs.id)
"""
RISK_GROUPS = ", l AS (SELECT src AS a, dst AS b FROM pairs WHERE risk >= 2.5), vs AS (SELECT src AS id FROM pairs UNION SELECT dst FROM pairs)" + COMPONENTS
SHAPE = RISK_GROUPS + """, shape AS (SELECT component, count(*) AS n, count(*) FILTER (id NOT IN (SELECT dst FROM pairs)) AS n_sources,
  count(*) FILTER (id NOT IN (SELECT src FROM pairs)) AS n_sinks FROM comp GROUP BY component)"""
CLOSURE = """, re(src, dst) AS (SELECT src, dst FROM pairs WHERE src <> dst UNION SELECT re.src, p.dst FROM re JOIN pairs p ON p.src = re.dst WHERE p.src <> p.dst),
loops AS (SELECT src AS id FROM re WHERE src = dst), after AS (SELECT dst AS id FROM re WHERE src IN (SELECT id FROM loops)), before AS (SELECT src AS id FROM re WHERE dst IN (SELECT id FROM loops))
"""
METRICS = """, m AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn FROM scored_rows)
SELECT tp, fp, tn, fn, (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM m"""
HIGH_RISK = 2.5
REGIONS = ["IRAN", "IRAQ", "CHINA", "RUSSIA"]


def query(sql: str | None = None, prefix: str = TXN):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = prefix + sql
        return f

    return add


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.transactions(spark, sf_dir)


def groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transfers, account edges, groups of accounts that edges of high risk join)."""
    t = tx(spark, sf_dir)
    edges = materialise(graph.account_edges(t), "account-edges")
    return t, edges, materialise(graph.risk_components(edges, HIGH_RISK), "risk-groups")


def scored(t: DataFrame) -> DataFrame:
    return t.withColumn("risk", graph.risk_rules(F.col("is_laundering"), F.col("amount"), F.col("epoch")))


# Sources and sinks


@query("SELECT * FROM txn")
def src8_transactions(spark, sf_dir):
    return tx(spark, sf_dir)


@query("SELECT * FROM txn")
def src1_csv_round_trip(spark, sf_dir):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    return source.read_csv(spark, source.write_csv(tx(spark, sf_dir), path))


@query("SELECT * FROM txn")
def src4_csv_all_strings(spark, sf_dir):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    return source.typed(source.read_csv(spark, source.write_csv(tx(spark, sf_dir), path), None))


@query("SELECT * FROM txn")
def src7_csv_batches(spark, sf_dir):
    root = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    t = tx(spark, sf_dir)
    for i in range(2):
        source.write_csv(t.filter(F.col("tx_id") % 2 == i), f"{root}/batch{i}")
    return source.read_csv(spark, f"{root}/batch*")


@query("SELECT event_id AS tx_id, user_id AS sender, CAST(json_extract_string(props, '$.k') AS BIGINT) AS receiver, value AS amount, epoch_us(ts) AS epoch FROM events", "")
def src_event_transfers(spark, sf_dir):
    return source.event_transfers(spark, sf_dir)


@query("SELECT DISTINCT sender AS src, receiver AS dst FROM txn")
def snk7_edge_list(spark, sf_dir):
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    source.write_edge_list(tx(spark, sf_dir).select(F.col("sender").alias("src"), F.col("receiver").alias("dst")).distinct(), path)
    return source.read_edge_list(spark, path)


@query("SELECT CAST(ceil(rn / 10000) AS INTEGER) AS page, count(*) AS n, min(tx_id) AS first_tx, max(tx_id) AS last_tx FROM (SELECT tx_id, row_number() OVER (ORDER BY epoch, tx_id) AS rn FROM txn) GROUP BY ALL")
def snk4_pages(spark, sf_dir):
    path = source.write_pages(tx(spark, sf_dir), ["epoch", "tx_id"], f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}")
    return spark.read.parquet(path).groupBy("page").agg(F.count("*").alias("n"), F.min("tx_id").alias("first_tx"), F.max("tx_id").alias("last_tx"))


# Projections, filters, scalars


@query("SELECT tx_id, amount FROM txn WHERE amount BETWEEN 100000 AND 300000 AND payment_type IN ('1-URGENT', '2-HIGH') AND laundering_type <> 'O'")
def flt2_range_and_lists(spark, sf_dir):
    return tx(spark, sf_dir).filter(F.col("amount").between(100000, 300000) & F.col("payment_type").isin("1-URGENT", "2-HIGH") & (F.col("laundering_type") != "O")).select("tx_id", "amount")


@query("""SELECT 'amount' AS column_name, count(*) FILTER (a IS NULL) AS nulls, count(*) AS total FROM x UNION ALL SELECT 'sender', count(*) FILTER (s IS NULL), count(*) FROM x""", TXN + ", x AS (SELECT nullif(sender, 3) AS s, CASE WHEN amount > 300000 THEN NULL ELSE amount END AS a FROM txn)\n")
def flt9_null_profile(spark, sf_dir):
    t = tx(spark, sf_dir).select(F.nullif("sender", F.lit(3)).alias("sender"), F.when(F.col("amount") <= 300000, F.col("amount")).alias("amount"))
    return relational.null_profile(t, ["amount", "sender"])


@query("SELECT tx_id, CASE WHEN amount <= 300000 THEN amount ELSE 0.0 END AS amount, sender FROM txn WHERE sender <> 3")
def flt7_drop_and_fill(spark, sf_dir):
    t = tx(spark, sf_dir).select("tx_id", F.nullif("sender", F.lit(3)).alias("sender"), F.when(F.col("amount") <= 300000, F.col("amount")).alias("amount"))
    return t.na.drop(subset=["sender"]).na.fill({"amount": 0.0})


@query("""SELECT tx_id, CAST(CASE WHEN amount > 100000 THEN 2.0 ELSE 0 END + CASE WHEN payment_type IN ('1-URGENT', '2-HIGH') THEN 1.5 ELSE 0 END + CASE WHEN payment_currency IN ('MACHINERY') THEN 1.2 ELSE 0 END
 + CASE WHEN payment_currency IN ('BUILDING', 'AUTOMOBILE') THEN 0.5 ELSE 0 END + CASE WHEN sender_bank_location IN ('IRAN', 'IRAQ', 'CHINA', 'RUSSIA') THEN 0.8 ELSE 0 END
 + CASE WHEN receiver_bank_location IN ('IRAN', 'IRAQ', 'CHINA', 'RUSSIA') THEN 0.8 ELSE 0 END AS DOUBLE) AS score FROM txn""")
def fn9_rule_score(spark, sf_dir):
    score = scalar.rule_score(*(F.col(c) for c in ("amount", "payment_type", "payment_currency", "sender_bank_location", "receiver_bank_location")), ["1-URGENT", "2-HIGH"], ["MACHINERY"], ["BUILDING", "AUTOMOBILE"], REGIONS)
    return tx(spark, sf_dir).select("tx_id", F.round(score, 6).alias("score"))


@query("SELECT tx_id, CAST(risk AS DOUBLE) AS risk, CAST((epoch % 86400) // 3600 AS BIGINT) AS hour FROM scored")
def fn10_edge_risk(spark, sf_dir):
    return scored(tx(spark, sf_dir)).select("tx_id", "risk", scalar.hour_of(F.col("epoch")).alias("hour"))


@query("""SELECT tx_id, CAST(epoch % 86400 AS BIGINT) AS seconds, 12 AS literal_hour, CAST(epoch(make_timestamp(epoch * 1000000)) AS BIGINT) AS parsed, 0 AS unparsed FROM txn""")
def fn3_time_keys(spark, sf_dir):
    when = F.timestamp_seconds("epoch")
    t = tx(spark, sf_dir).withColumns({"d": F.date_format(when, "yyyy-MM-dd"), "h": F.date_format(when, "HH:mm:ss")})
    return t.select("tx_id", scalar.seconds_of_day(F.col("h")).cast("long").alias("seconds"), scalar.hour_or_default(F.col("h")).alias("literal_hour"), scalar.time_key(F.col("d"), F.col("h")).alias("parsed"), scalar.epoch_or_zero(F.col("h")).cast("int").alias("unparsed"))


@query("SELECT tx_id, sha256(sender || '->' || receiver || '|' || CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) || '|' || epoch) AS poh FROM txn")
def hc2_transfer_hash(spark, sf_dir):
    return tx(spark, sf_dir).select("tx_id", scalar.poh_hash(*(F.col(c) for c in ("sender", "receiver", "amount", "epoch"))).alias("poh"))


# Joins


@query("SELECT src, dst FROM chain")
def join1_temporal_chain(spark, sf_dir):
    return relational.temporal_chain(tx(spark, sf_dir))


@query("SELECT h.tx_id, h.amount, coalesce(l.is_laundering, 0) AS label FROM txn h LEFT JOIN (SELECT * FROM txn WHERE is_laundering = 1) l USING (tx_id)")
def join2_label_attach(spark, sf_dir):
    t = tx(spark, sf_dir)
    labels = t.filter("is_laundering = 1").select("tx_id", F.col("is_laundering").alias("label"))
    return t.select("tx_id", "amount").join(labels, "tx_id", "left").na.fill(0, ["label"])


@query("SELECT tx_id FROM txn WHERE tx_id NOT IN (SELECT dst FROM chain)")
def join6_unreached(spark, sf_dir):
    return relational.unreached(tx(spark, sf_dir))


@query("""SELECT coalesce(o.a, i.a) AS account, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree
FROM (SELECT sender a, count(*) n FROM txn GROUP BY 1) o FULL JOIN (SELECT receiver a, count(*) n FROM txn GROUP BY 1) i ON o.a = i.a""")
def join7_degrees(spark, sf_dir):
    return relational.degrees(tx(spark, sf_dir))


@query("SELECT * FROM txn WHERE sender IN (SELECT a FROM bad) OR receiver IN (SELECT a FROM bad)", TXN + ", bad AS (SELECT sender a FROM txn WHERE is_laundering = 1 UNION SELECT receiver FROM txn WHERE is_laundering = 1)\n")
def join8_touching_accounts(spark, sf_dir):
    t = tx(spark, sf_dir)
    bad = t.filter("is_laundering = 1")
    return relational.touching(t, bad.select(F.col("sender").alias("account")).union(bad.select("receiver")))


@query("SELECT r.tx_id AS src, f.tx_id AS dst, f.sender AS account FROM txn r JOIN (SELECT sender, min((epoch, tx_id)) AS k, arg_min(tx_id, (epoch, tx_id)) AS tx_id FROM txn GROUP BY 1) f ON f.sender = r.receiver AND (r.epoch, r.tx_id) < f.k")
def join10_first_send(spark, sf_dir):
    return relational.first_send(tx(spark, sf_dir))


@query("SELECT src, dst, risk FROM pairs WHERE src IN (SELECT sender FROM txn WHERE is_laundering = 1) AND dst IN (SELECT sender FROM txn WHERE is_laundering = 1)")
def join12_induced_subgraph(spark, sf_dir):
    t = tx(spark, sf_dir)
    return relational.induced(graph.account_edges(t), t.filter("is_laundering = 1").select(F.col("sender").alias("id")))


# Aggregates


COMPONENT_SQL = ", l AS (SELECT src AS a, dst AS b FROM chain), vs AS (SELECT tx_id AS id FROM txn)" + COMPONENTS


def tx_components(t: DataFrame) -> DataFrame:
    slim = materialise(t.select("tx_id", "sender", "receiver", "epoch"), "slim-transfers")
    found = connected_components(relational.chain_hubs(slim))
    return materialise(slim.select(F.col("tx_id").alias("id")).join(hashed(found), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "components")


@query(COMPONENT_SQL + "SELECT id, component FROM comp")
def gr1_transfer_components(spark, sf_dir):
    return tx_components(tx(spark, sf_dir))


@query(COMPONENT_SQL + """, g AS (SELECT t.*, c.component, epoch - lag(epoch) OVER (PARTITION BY c.component ORDER BY epoch, tx_id) AS gap FROM txn t JOIN comp c ON c.id = t.tx_id)
SELECT component, min(epoch) AS start_ts, count(epoch) AS tx_count, round(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount), 6) AS avg_amt, coalesce(round(stddev_samp(amount), 3), 0) AS std_amt,
 max(amount) AS max_amt, min(amount) AS min_amt, coalesce(round(CAST(sum(gap) AS DOUBLE) / nullif(count(gap), 0), 6), 0) AS avg_gap, coalesce(round(stddev_samp(gap), 3), 0) AS std_gap, coalesce(max(gap), 0) AS max_gap, coalesce(min(gap), 0) AS min_gap, max(is_laundering) AS label
FROM g GROUP BY component""")
def agg1_component_features(spark, sf_dir):
    t = materialise(tx(spark, sf_dir), "transfers")
    return relational.component_features(t, tx_components(t))


@query(f""", big AS (SELECT * FROM txn WHERE amount >= {LARGEST}), l AS (SELECT a.tx_id AS a, b.tx_id AS b FROM big a JOIN big b ON a.receiver = b.sender AND a.epoch < b.epoch), vs AS (SELECT tx_id AS id FROM big)""" + COMPONENTS + """, g AS (SELECT t.*, c.component, epoch - lag(epoch) OVER (PARTITION BY c.component ORDER BY epoch, tx_id) AS gap FROM big t JOIN comp c ON c.id = t.tx_id)
SELECT component, min(epoch) AS start_ts, count(epoch) AS tx_count, round(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount), 6) AS avg_amt, coalesce(round(stddev_samp(amount), 3), 0) AS std_amt,
 max(amount) AS max_amt, min(amount) AS min_amt, coalesce(round(CAST(sum(gap) AS DOUBLE) / nullif(count(gap), 0), 6), 0) AS avg_gap, coalesce(round(stddev_samp(gap), 3), 0) AS std_gap, coalesce(max(gap), 0) AS max_gap, coalesce(min(gap), 0) AS min_gap, max(is_laundering) AS label
FROM g GROUP BY component""")
def agg1_features_of_large(spark, sf_dir):
    """Component features of the largest transfers, which fall into many components."""
    t = materialise(tx(spark, sf_dir).filter(F.col("amount") >= LARGEST), "largest")
    return relational.component_features(t, tx_components(t))


@query("""SELECT sender, count(*) AS n, count(nullif(is_laundering, 0)) AS n_flagged, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, min(amount) AS low, max(amount) AS high, max(is_laundering) AS any_flag, count(DISTINCT receiver) AS receivers,
 string_agg(CAST(tx_id AS VARCHAR), ';' ORDER BY epoch, tx_id) AS ids FROM txn GROUP BY sender""")
def agg2_account_bundle(spark, sf_dir):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "tx_id"))), lambda x: x["tx_id"].cast("string")), ";")
    mean = F.sum(F.col("amount").cast("decimal(18,2)")).cast("double") / F.count("*")
    return tx(spark, sf_dir).groupBy("sender").agg(F.count("*").alias("n"), F.count(F.nullif("is_laundering", F.lit(0))).alias("n_flagged"), mean.alias("mean"), F.min("amount").alias("low"), F.max("amount").alias("high"), F.max("is_laundering").alias("any_flag"), F.countDistinct("receiver").alias("receivers"), ids.alias("ids"))


@query(", scored_rows AS (SELECT is_laundering AS y, CAST(risk >= 1.5 AS INT) AS p FROM scored)" + METRICS)
def agg7_confusion(spark, sf_dir):
    t = scored(tx(spark, sf_dir))
    return relational.metrics(relational.confusion(t, F.col("is_laundering"), (F.col("risk") >= 1.5).cast("int")))


@query("SELECT is_laundering, count(*) AS n FROM txn GROUP BY 1")
def agg9_support(spark, sf_dir):
    return tx(spark, sf_dir).groupBy("is_laundering").agg(F.count("*").alias("n"))


@query("SELECT * FROM pairs")
def agg13_last_risk_wins(spark, sf_dir):
    return graph.account_edges(tx(spark, sf_dir))


@query("SELECT sender AS src, receiver AS dst, arg_min(tx_id, (epoch, tx_id)) AS tx_id FROM txn GROUP BY ALL")
def agg14_first_edge_wins(spark, sf_dir):
    t = tx(spark, sf_dir).select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), "epoch", "tx_id")
    return t.groupBy("src", "dst").agg(F.min_by("tx_id", F.struct("epoch", "tx_id")).alias("tx_id"))


@query("SELECT sender AS account, round(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / (max(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)) OVER () + 1e-9), 9) AS amount_share, round(count(*) / (max(count(*)) OVER () + 1e-9), 9) AS count_share, max(is_laundering) AS label FROM txn GROUP BY sender")
def agg16_account_features(spark, sf_dir):
    by = materialise(tx(spark, sf_dir).groupBy(F.col("sender").alias("account")).agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("a"), F.count("*").alias("n"), F.max("is_laundering").alias("label")), "accounts")
    top = by.agg(F.max("a").alias("a"), F.max("n").alias("n")).first()
    return by.select("account", F.round(F.col("a") / (F.lit(top["a"]) + 1e-9), 9).alias("amount_share"), F.round(F.col("n") / (F.lit(top["n"]) + 1e-9), 9).alias("count_share"), "label")


@query("SELECT sender AS account FROM txn WHERE is_laundering = 1 UNION SELECT receiver FROM txn WHERE is_laundering = 1")
def agg18_flagged_accounts(spark, sf_dir):
    bad = tx(spark, sf_dir).filter("is_laundering = 1")
    return bad.select(F.col("sender").alias("account")).union(bad.select("receiver")).distinct()


@query(RISK_GROUPS + "SELECT component, count(*) AS n FROM txn JOIN comp ON comp.id = txn.sender WHERE is_laundering = 1 GROUP BY 1")
def agg19_flagged_by_group(spark, sf_dir):
    t, _, comp = groups(spark, sf_dir)
    return t.filter("is_laundering = 1").join(comp, t.sender == comp.id).groupBy("component").agg(F.count("*").alias("n"))


# Windows, sorts, sets


@query("SELECT tx_id, row_number() OVER (ORDER BY epoch, tx_id) AS row_id FROM txn")
def win2_global_row_number(spark, sf_dir):
    return relational.global_row_number(tx(spark, sf_dir).select("epoch", "tx_id"), ["epoch", "tx_id"]).select("tx_id", "row_id")


@query("SELECT tx_id, epoch - lag(epoch) OVER (PARTITION BY sender ORDER BY epoch, tx_id) AS gap FROM txn")
def win1_gap(spark, sf_dir):
    t = tx(spark, sf_dir).select("tx_id", "sender", "epoch")
    return relational.previous(t, "sender", ["epoch", "tx_id"], "epoch", "before").select("tx_id", (F.col("epoch") - F.col("before")).alias("gap"))


@query("SELECT sender, n FROM (SELECT sender, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM txn GROUP BY 1) WHERE r <= 10")
def win5_top_with_ties(spark, sf_dir):
    return relational.top_with_ties(tx(spark, sf_dir).groupBy("sender").agg(F.count("*").alias("n")), "n", 10)


@query("SELECT tx_id, amount FROM txn ORDER BY amount DESC, tx_id LIMIT 10")
def srt3_top_k(spark, sf_dir):
    return tx(spark, sf_dir).select("tx_id", "amount").orderBy(F.desc("amount"), "tx_id").limit(10)


@query("SELECT sender, arg_max(tx_id, (amount, tx_id)) AS tx_id FROM txn GROUP BY 1")
def srt5_arg_max(spark, sf_dir):
    return tx(spark, sf_dir).groupBy("sender").agg(F.max_by("tx_id", F.struct("amount", "tx_id")).alias("tx_id"))


@query(RISK_GROUPS + "SELECT component, dense_rank() OVER (ORDER BY component) AS group_no FROM (SELECT DISTINCT component FROM comp)")
def srt6_group_numbers(spark, sf_dir):
    _, _, comp = groups(spark, sf_dir)
    return relational.global_row_number(comp.select("component").distinct(), ["component"], "group_no")


@query("SELECT (SELECT count(*) FROM (SELECT sender FROM txn INTERSECT SELECT receiver FROM txn)) AS shared, (SELECT count(*) FROM (SELECT sender FROM txn EXCEPT SELECT receiver FROM txn)) AS only_senders, (SELECT count(*) FROM (SELECT sender FROM txn UNION SELECT receiver FROM txn)) AS vertices")
def set3_account_sets(spark, sf_dir):
    t = tx(spark, sf_dir)
    s, r = t.select(F.col("sender").alias("a")), t.select(F.col("receiver").alias("a"))
    tagged = s.select("a", F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(r.select("a", F.lit(0).alias("s"), F.lit(1).alias("r"))).groupBy("a").agg(F.max("s").alias("s"), F.max("r").alias("r"))
    return tagged.agg(F.count_if((F.col("s") == 1) & (F.col("r") == 1)).alias("shared"), F.count_if(F.col("r") == 0).alias("only_senders"), F.count("*").alias("vertices"))


@query("SELECT sender, receiver FROM txn EXCEPT SELECT sender, receiver FROM txn WHERE is_laundering = 1")
def set2_except(spark, sf_dir):
    t = tx(spark, sf_dir)
    return t.select("sender", "receiver").subtract(t.filter("is_laundering = 1").select("sender", "receiver"))


# Graphs


EVENTS = """WITH ev AS (SELECT event_id AS tx_id, user_id AS sender, CAST(json_extract_string(props, '$.k') AS BIGINT) AS receiver, epoch_us(ts) AS epoch FROM events),
chain AS (SELECT a.tx_id AS src, b.tx_id AS dst FROM ev a JOIN ev b ON a.receiver = b.sender AND a.epoch < b.epoch)
"""


@query(RISK_GROUPS + "SELECT id, component FROM comp")
def gr2_account_groups(spark, sf_dir):
    return groups(spark, sf_dir)[2]


PROPAGATE = """, s AS (SELECT DISTINCT {end} AS id FROM chain WHERE {end} NOT IN (SELECT {other} FROM chain)),
p0 AS (SELECT id, id AS c FROM s), p1 AS (SELECT id, min(c) AS c FROM (SELECT * FROM p0 UNION ALL SELECT dst, c FROM chain JOIN p0 ON src = id) GROUP BY 1),
p2 AS (SELECT id, min(c) AS c FROM (SELECT * FROM p1 UNION ALL SELECT dst, c FROM chain JOIN p1 ON src = id) GROUP BY 1)
SELECT id, min(c) AS component FROM (SELECT * FROM p2 UNION ALL SELECT dst, c FROM chain JOIN p2 ON src = id) GROUP BY 1"""


@query(PROPAGATE.format(end="src", other="dst"))
def gr3_propagate_from_sources(spark, sf_dir):
    return graph.propagate_chain(relational.Chain(tx(spark, sf_dir)))


@query(PROPAGATE.format(end="src", other="dst"), EVENTS)
def gr3_propagate_events(spark, sf_dir):
    """Propagation between few and busy accounts, whose chain has far more pairs than there are events."""
    return graph.propagate_chain(relational.Chain(source.event_transfers(spark, sf_dir)))


@query("SELECT tx_id FROM ev WHERE tx_id NOT IN (SELECT dst FROM chain)", EVENTS)
def join6_unreached_events(spark, sf_dir):
    return relational.unreached(source.event_transfers(spark, sf_dir))


@query(PROPAGATE.format(end="dst", other="src"))
def gr3_propagate_from_sinks(spark, sf_dir):
    return graph.propagate_chain(relational.Chain(tx(spark, sf_dir)), "sink")


@query(""", w AS (SELECT c.src, c.dst, s.risk FROM chain c JOIN scored s ON s.tx_id = c.dst),
walk(id, k, r) AS (SELECT DISTINCT src, 0, CAST(0 AS DOUBLE) FROM chain WHERE src NOT IN (SELECT dst FROM chain) UNION SELECT w.dst, k + 1, max(r + risk) FROM walk JOIN w ON w.src = walk.id GROUP BY w.dst, k + 1)
SELECT id, max(k) AS level, max(r) AS risk FROM walk GROUP BY id""")
def gr11_levels_and_risk(spark, sf_dir):
    t = materialise(scored(tx(spark, sf_dir)).select("tx_id", "sender", "receiver", "epoch", "risk"), "scored")
    return sweep.chain_levels(t, t.select(F.col("tx_id").alias("id"), F.col("risk").alias("w")))


@query(""", nx AS (SELECT src, arg_min(dst, (dst_epoch, dst)) AS dst FROM chain GROUP BY src),
walk(id, z, hops) AS (SELECT src, dst, 1 FROM nx UNION ALL SELECT walk.id, nx.dst, hops + 1 FROM walk JOIN nx ON nx.src = walk.z)
SELECT id, arg_max(z, hops) AS sink, CAST(max(hops) AS BIGINT) AS hops FROM walk GROUP BY id""")
def gr12_first_successor_walks(spark, sf_dir):
    return graph.walks_to_sinks(relational.Chain(tx(spark, sf_dir)).successors())


LONGEST = ORACLE_SQL["gr12_first_successor_walks"].replace("SELECT id, arg_max", ", f AS (SELECT id, arg_max") + ")"


def longest_walks(walks: DataFrame, k: int = 1000) -> DataFrame:
    return walks.filter("hops >= 4").orderBy(F.desc("hops"), "id").limit(k).select("id", "hops")


@query(LONGEST + " SELECT id, hops FROM f WHERE hops >= 4 ORDER BY hops DESC, id LIMIT 1000", "")
def gr13_longest_walks(spark, sf_dir):
    return longest_walks(gr12_first_successor_walks(spark, sf_dir))


WALKS = LONGEST + """, top AS (SELECT id, hops FROM f WHERE hops >= 4 ORDER BY hops DESC, id LIMIT {k}),
path(start, id, hops) AS (SELECT id, id, 0 FROM top UNION ALL SELECT path.start, nx.dst, path.hops + 1 FROM path JOIN nx ON nx.src = path.id)"""


def walk_nodes(spark, sf_dir, k: int) -> DataFrame:
    successors = materialise(relational.Chain(tx(spark, sf_dir)).successors(), "successors")
    return graph.trace(successors, longest_walks(graph.walks_to_sinks(successors), k))


@query(WALKS.format(k=1000) + " SELECT start, id, CAST(hops AS BIGINT) AS hops FROM path", "")
def gr12_walk_nodes(spark, sf_dir):
    """The nodes of the 1000 longest walks, in order of hops."""
    return walk_nodes(spark, sf_dir, 1000)


@query(WALKS.format(k=1000) + """, own AS (SELECT * FROM txn WHERE tx_id IN (SELECT id FROM path)), pred AS (SELECT sender AS a FROM own UNION SELECT receiver FROM own),
bad AS (SELECT sender AS a FROM txn WHERE is_laundering = 1 UNION SELECT receiver FROM txn WHERE is_laundering = 1),
n AS (SELECT count(*) FILTER (p.a IS NOT NULL AND b.a IS NOT NULL) AS tp, count(*) FILTER (b.a IS NULL) AS fp, count(*) FILTER (p.a IS NULL) AS fn FROM pred p FULL JOIN bad b ON p.a = b.a),
pr AS (SELECT *, tp / (tp + fp + 1e-9) AS precision, tp / (tp + fn + 1e-9) AS recall FROM n) SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM pr""", "")
def gr13_risk_path_accounts(spark, sf_dir):
    """Accounts on the 1000 longest walks as a prediction of the flagged accounts."""
    t = tx(spark, sf_dir)
    return graph.set_metrics(graph.walk_accounts(walk_nodes(spark, sf_dir, 1000), t), agg18_flagged_accounts(spark, sf_dir))


@query(WALKS.format(k=10) + " SELECT start, count(*) AS nodes, array_to_string(list(id ORDER BY hops)[1:3], ' -> ') AS first_three, array_to_string(list(id ORDER BY hops DESC), ' <- ') AS backwards FROM path GROUP BY start", "")
def fn15_path_texts(spark, sf_dir):
    """The ten longest walks as arrays: their length, a slice, and reversed as one text."""
    path = F.transform(F.array_sort(F.collect_list(F.struct("hops", "id"))), lambda x: x["id"].cast("string"))
    rows = walk_nodes(spark, sf_dir, 10).groupBy("start").agg(path.alias("path"))
    return rows.select("start", F.size("path").cast("long").alias("nodes"), F.array_join(F.slice("path", 1, 3), " -> ").alias("first_three"), F.array_join(F.reverse("path"), " <- ").alias("backwards"))


#: Minimum spanning forest in rounds: every group takes its earliest edge to another one. Twelve rounds are enough for 4096 accounts.
FOREST = ", e0 AS (SELECT tx_id, row_number() OVER (ORDER BY epoch, tx_id) AS i, sender AS a, receiver AS b FROM txn WHERE sender <> receiver)" + "".join(f""",
p{r} AS MATERIALIZED (SELECT DISTINCT tx_id, a, b FROM (SELECT arg_min(tx_id, i) AS tx_id, arg_min(a, i) AS a, arg_min(b, i) AS b FROM (SELECT a AS g, * FROM e{r} UNION ALL SELECT b, * FROM e{r}) GROUP BY g)),
d{r} AS MATERIALIZED (SELECT a, b FROM p{r} UNION SELECT b, a FROM p{r}),
c{r}(n, c) USING KEY (n) AS (SELECT a, min(least(a, b)) FROM d{r} GROUP BY a UNION (SELECT d.b, min(t.c) FROM c{r} t JOIN d{r} d ON t.n = d.a JOIN recurring.c{r} AS old ON old.n = d.b WHERE t.c < old.c GROUP BY d.b)),
e{r + 1} AS MATERIALIZED (SELECT tx_id, i, x.c AS a, y.c AS b FROM e{r} JOIN c{r} x ON x.n = a JOIN c{r} y ON y.n = b WHERE x.c <> y.c)""" for r in range(12)) + ", forest AS (" + " UNION ".join(f"SELECT tx_id FROM p{r}" for r in range(12)) + ")\n"


@query(FOREST + "SELECT tx_id FROM forest")
def gr8_temporal_forest(spark, sf_dir):
    return graph.temporal_forest(tx(spark, sf_dir))


@query(FOREST + """, fo AS (SELECT sender AS src, receiver AS dst, risk FROM scored JOIN forest USING (tx_id)),
walk(id, k, r) AS (SELECT DISTINCT src, 0, CAST(0 AS DOUBLE) FROM fo WHERE src NOT IN (SELECT dst FROM fo) UNION ALL SELECT fo.dst, k + 1, r + risk FROM walk JOIN fo ON fo.src = walk.id)
SELECT id, CAST(max(k) AS BIGINT) AS level, max(r) AS risk FROM walk GROUP BY id""")
def gr5_forest_levels(spark, sf_dir):
    """Levels and greatest risks of the accounts in the temporal forest, whose edges go from sender to receiver."""
    t = scored(tx(spark, sf_dir))
    edges = t.join(graph.temporal_forest(t), "tx_id").select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), "risk")
    return graph.relax(edges, "risk")


@query(CLOSURE + "SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT src FROM pairs UNION SELECT dst FROM pairs)) AS vertices, count(*) FILTER (src = dst) AS self_loops, CAST(max(risk) AS DOUBLE) AS top_risk, NOT EXISTS (SELECT 1 FROM loops) AND count(*) FILTER (src = dst) = 0 AS dag FROM pairs")
def gr10_graph_stats(spark, sf_dir):
    e = materialise(graph.account_edges(tx(spark, sf_dir)), "account-edges")
    vertices = e.select("src").union(e.select("dst")).distinct().count()
    return e.agg(F.count("*").alias("edges"), F.lit(vertices).cast("long").alias("vertices"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"), F.max("risk").alias("top_risk"), F.lit(graph.is_dag(e)).alias("dag"))


@query(SHAPE + "SELECT *, n_sources <= 3 AND n_sinks >= 10 AS high, n_sources = 0 OR n_sinks = 0 AS severed, n_sources <= 5 AND n_sinks <= 5 AND n >= 15 AS medium FROM shape")
def gr16_tiers_independent(spark, sf_dir):
    _, edges, comp = groups(spark, sf_dir)
    return graph.tiers_independent(graph.group_shape(edges, comp))


@query(SHAPE + "SELECT *, CASE WHEN n_sources = 0 AND n_sinks >= 10 THEN 'severed' WHEN n_sources <= 3 AND n_sinks >= 10 THEN 'high' WHEN n_sources <= 3 AND n_sinks <= 3 THEN 'medium' ELSE 'low' END AS tier FROM shape")
def gr16_tiers_exclusive(spark, sf_dir):
    _, edges, comp = groups(spark, sf_dir)
    return graph.tiers_exclusive(graph.group_shape(edges, comp))


@query(SHAPE + """, sev AS (SELECT id FROM comp JOIN shape USING (component) WHERE n_sources = 0 OR n_sinks = 0)
SELECT count(*) AS transfers, CAST(coalesce(sum(is_laundering), 0) AS BIGINT) AS flagged FROM txn WHERE sender IN (SELECT id FROM sev) OR receiver IN (SELECT id FROM sev)""")
def gr17_tier_coverage(spark, sf_dir):
    t, edges, comp = groups(spark, sf_dir)
    severed = graph.tiers_independent(graph.group_shape(edges, comp)).filter("severed")
    hit = relational.touching(t, comp.join(severed, "component", "left_semi").select(F.col("id").alias("account")))
    return hit.agg(F.count("*").alias("transfers"), F.coalesce(F.sum("is_laundering"), F.lit(0)).alias("flagged"))


@query(RISK_GROUPS + """, sizes AS (SELECT component, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM comp GROUP BY 1)
SELECT s.component, s.n, count(t.tx_id) FILTER (t.is_laundering = 1) AS flagged FROM sizes s JOIN comp c USING (component) LEFT JOIN txn t ON t.sender = c.id WHERE r <= 3 GROUP BY ALL""")
def gr18_top_groups(spark, sf_dir):
    t, _, comp = groups(spark, sf_dir)
    top = relational.top_with_ties(materialise(comp.groupBy("component").agg(F.count("*").alias("n")), "sizes"), "n", 3)
    bad = t.filter("is_laundering = 1").join(comp, t.sender == comp.id).groupBy("component").agg(F.count("*").alias("flagged"))
    return top.join(bad, "component", "left").na.fill(0, ["flagged"])


@query(RISK_GROUPS + ", scored_rows AS (SELECT is_laundering AS y, CAST(a.component = b.component AS INT) AS p FROM txn JOIN comp a ON a.id = sender JOIN comp b ON b.id = receiver)" + METRICS)
def gr20_same_group_prediction(spark, sf_dir):
    t, _, comp = groups(spark, sf_dir)
    return relational.metrics(relational.confusion(graph.same_group(t, comp), F.col("is_laundering"), F.col("predicted")))


@query(""", cuts AS (SELECT DISTINCT risk AS cut FROM pairs UNION SELECT CAST('inf' AS DOUBLE)), vs AS (SELECT src AS id FROM pairs UNION SELECT dst FROM pairs),
ed AS (SELECT cut, src AS a, dst AS b FROM pairs, cuts WHERE risk >= cut UNION SELECT cut, dst, src FROM pairs, cuts WHERE risk >= cut),
cc(cut, n, c) USING KEY (cut, n) AS (SELECT cut, a, min(least(a, b)) FROM ed GROUP BY ALL
  UNION (SELECT ed.cut, ed.b, min(cc.c) FROM cc JOIN ed ON cc.n = ed.a AND cc.cut = ed.cut JOIN recurring.cc AS old ON old.n = ed.b AND old.cut = ed.cut WHERE cc.c < old.c GROUP BY ed.cut, ed.b)),
g AS (SELECT cuts.cut, vs.id, coalesce(cc.c, vs.id) AS c FROM vs CROSS JOIN cuts LEFT JOIN cc ON cc.n = vs.id AND cc.cut = cuts.cut),
y AS (SELECT a.cut, is_laundering AS y, CAST(a.c = b.c AS INT) AS p FROM txn JOIN g a ON a.id = sender JOIN g b ON b.id = receiver AND b.cut = a.cut),
m AS (SELECT cut, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM y GROUP BY 1),
v AS (SELECT cut AS threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM m)
SELECT *, 0.6 * recall + 0.4 * f1 AS objective FROM v""")
def gr21_threshold_scores(spark, sf_dir):
    t = tx(spark, sf_dir)
    return merge_tree.threshold_scores(t, materialise(graph.account_edges(t), "account-edges"))


@query()
def gr21_threshold_search(spark, sf_dir):
    scores = gr21_threshold_scores(spark, sf_dir).select("threshold", "precision", "recall", "f1", "objective")
    path = graph.tabu_search([tuple(r) for r in scores.collect()])  # a row a cut
    return spark.createDataFrame([(i, *row) for i, row in enumerate(path)], "step int, threshold double, precision double, recall double, f1 double, objective double, best double")


WALKERS = RISK_GROUPS + """, inner_edges AS (SELECT sender AS src, receiver AS dst, epoch FROM txn JOIN comp a ON a.id = sender JOIN comp b ON b.id = receiver WHERE a.component = b.component),
members AS (SELECT DISTINCT sender AS id, component FROM txn JOIN comp ON comp.id = sender),
w0 AS (SELECT component, w, arg_min(id, struct_pack(u := CAST(CAST('0x' || substr(md5('7:' || w || ':' || id), 1, 13) AS BIGINT) AS DOUBLE), i := id)) AS id, CAST(NULL AS BIGINT) AS t FROM members, (SELECT unnest(range(1, 101)) AS w) GROUP BY ALL),
w1 AS (SELECT w0.component, w0.w, arg_min(e.dst, struct_pack(u := CAST(CAST('0x' || substr(md5('7:' || '0' || ':' || w0.component || ':' || w0.w || ':' || e.dst || ':' || e.epoch), 1, 13) AS BIGINT) AS DOUBLE), d := e.dst, t := e.epoch)) AS id, arg_min(e.epoch, struct_pack(u := CAST(CAST('0x' || substr(md5('7:' || '0' || ':' || w0.component || ':' || w0.w || ':' || e.dst || ':' || e.epoch), 1, 13) AS BIGINT) AS DOUBLE), d := e.dst, t := e.epoch)) AS t
  FROM w0 JOIN inner_edges e ON e.src = w0.id AND (w0.t IS NULL OR e.epoch > w0.t) GROUP BY ALL),
w2 AS (SELECT w1.component, w1.w, arg_min(e.dst, struct_pack(u := CAST(CAST('0x' || substr(md5('7:' || '1' || ':' || w1.component || ':' || w1.w || ':' || e.dst || ':' || e.epoch), 1, 13) AS BIGINT) AS DOUBLE), d := e.dst, t := e.epoch)) AS id, arg_min(e.epoch, struct_pack(u := CAST(CAST('0x' || substr(md5('7:' || '1' || ':' || w1.component || ':' || w1.w || ':' || e.dst || ':' || e.epoch), 1, 13) AS BIGINT) AS DOUBLE), d := e.dst, t := e.epoch)) AS t
  FROM w1 JOIN inner_edges e ON e.src = w1.id AND (w1.t IS NULL OR e.epoch > w1.t) GROUP BY ALL),
w3 AS (SELECT w2.component, w2.w, arg_min(e.dst, struct_pack(u := CAST(CAST('0x' || substr(md5('7:' || '2' || ':' || w2.component || ':' || w2.w || ':' || e.dst || ':' || e.epoch), 1, 13) AS BIGINT) AS DOUBLE), d := e.dst, t := e.epoch)) AS id, arg_min(e.epoch, struct_pack(u := CAST(CAST('0x' || substr(md5('7:' || '2' || ':' || w2.component || ':' || w2.w || ':' || e.dst || ':' || e.epoch), 1, 13) AS BIGINT) AS DOUBLE), d := e.dst, t := e.epoch)) AS t
  FROM w2 JOIN inner_edges e ON e.src = w2.id AND (w2.t IS NULL OR e.epoch > w2.t) GROUP BY ALL),
w4 AS (SELECT w3.component, w3.w, arg_min(e.dst, struct_pack(u := CAST(CAST('0x' || substr(md5('7:' || '3' || ':' || w3.component || ':' || w3.w || ':' || e.dst || ':' || e.epoch), 1, 13) AS BIGINT) AS DOUBLE), d := e.dst, t := e.epoch)) AS id, arg_min(e.epoch, struct_pack(u := CAST(CAST('0x' || substr(md5('7:' || '3' || ':' || w3.component || ':' || w3.w || ':' || e.dst || ':' || e.epoch), 1, 13) AS BIGINT) AS DOUBLE), d := e.dst, t := e.epoch)) AS t
  FROM w3 JOIN inner_edges e ON e.src = w3.id AND (w3.t IS NULL OR e.epoch > w3.t) GROUP BY ALL),
visits AS (SELECT component, id, count(*) AS visits FROM (SELECT component, id FROM w0 UNION ALL SELECT component, id FROM w1 UNION ALL SELECT component, id FROM w2 UNION ALL SELECT component, id FROM w3 UNION ALL SELECT component, id FROM w4) GROUP BY ALL)
"""


@query(WALKERS + "SELECT component, id, visits, visits / sum(visits) OVER (PARTITION BY component) AS rate FROM visits")
def gr22_monte_carlo_walks(spark, sf_dir):
    t, _, comp = groups(spark, sf_dir)
    edges = materialise(t.select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), "epoch"), "walk-edges")
    return graph.monte_carlo(edges, comp)


U = "CAST(CAST('0x' || substr(md5('7:' || {}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"


@query(RISK_GROUPS + f""", ie AS (SELECT tx_id, sender AS src, receiver AS dst, epoch FROM txn JOIN comp a ON a.id = sender JOIN comp b ON b.id = receiver WHERE a.component = b.component),
e AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY epoch, tx_id) AS r FROM ie), deg AS (SELECT src, count(*) AS n FROM ie GROUP BY 1),
arr AS (SELECT e.tx_id, count(x.tx_id) AS passed FROM e LEFT JOIN e x ON x.src = e.dst AND x.epoch <= e.epoch GROUP BY 1),
ranked AS (SELECT e.src, e.r, e.dst, arr.passed, coalesce(deg.n, 0) AS degree FROM e JOIN arr USING (tx_id) LEFT JOIN deg ON deg.src = e.dst),
members AS (SELECT id, component, row_number() OVER (PARTITION BY component ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY component) AS n FROM (SELECT DISTINCT sender AS id FROM txn) JOIN comp USING (id)),
walk(component, w, k, id, passed, degree) AS (
  SELECT m.component, w, 0, m.id, CAST(0 AS BIGINT), coalesce(deg.n, 0) FROM members m JOIN (SELECT unnest(range(1, 101)) AS w) q ON m.place = CAST(floor(({U.format("m.component || ':' || w")}) * m.n) AS BIGINT) LEFT JOIN deg ON deg.src = m.id
  UNION ALL SELECT walk.component, w, k + 1, ranked.dst, ranked.passed, ranked.degree FROM walk JOIN ranked ON ranked.src = walk.id AND ranked.r = walk.passed + 1 + CAST(floor(({U.format("k || ':' || walk.component || ':' || w")}) * (walk.degree - walk.passed)) AS BIGINT) WHERE k < 4 AND walk.degree > walk.passed),
visits AS (SELECT component, id, count(*) AS visits FROM walk GROUP BY ALL)
SELECT component, id, visits, visits / sum(visits) OVER (PARTITION BY component) AS rate FROM visits""")
def gr22_ranked_walks(spark, sf_dir):
    t, _, comp = groups(spark, sf_dir)
    edges = materialise(t.select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), "epoch", "tx_id"), "walk-edges")
    return graph.ranked_walks(edges, comp)


@query(RISK_GROUPS + """, d AS (SELECT a AS id, count(*) AS degree FROM (SELECT src a, dst b FROM pairs WHERE src <> dst UNION SELECT dst, src FROM pairs WHERE src <> dst) GROUP BY 1),
e AS (SELECT component, count(*) AS m, count(q.src) AS k FROM pairs p JOIN comp ON comp.id = p.src LEFT JOIN pairs q ON q.src = p.dst AND q.dst = p.src GROUP BY 1)
SELECT comp.id, coalesce(degree, 0) AS degree, count(*) OVER (PARTITION BY component) AS group_node_count, coalesce(m, 0) AS group_edge_count, coalesce(k / m, 0) AS group_bidirect_ratio FROM comp LEFT JOIN d USING (id) LEFT JOIN e USING (component)""")
def gr25_account_columns(spark, sf_dir):
    _, edges, comp = groups(spark, sf_dir)
    return graph.account_columns(edges, comp)


@query(CLOSURE + """SELECT src, dst FROM pairs WHERE src <> dst AND src IN (SELECT id FROM after) AND src IN (SELECT id FROM before) AND dst IN (SELECT id FROM after) AND dst IN (SELECT id FROM before)""")
def gr4_cycle_core(spark, sf_dir):
    return graph.cycle_core(graph.account_edges(tx(spark, sf_dir)))


@query()
def gr24_graph_convolution(spark, sf_dir):
    t = tx(spark, sf_dir)
    edges = graph.account_edges(t)
    flags = t.groupBy(F.col("sender").alias("id")).agg(F.sum("amount").alias("amount"), F.count("*").cast("double").alias("n"), F.max("is_laundering").alias("label"))
    x = graph.smoothed_features(edges, flags.select("id", F.log1p("amount").alias("amount"), "n"), ["amount", "n"])
    rows = learning.random_split(x.join(flags.select("id", "label"), "id"), [0.7, 0.3], id_col="id")
    rows = materialise(rows, "gcn")
    return learning.evaluate(rows.filter("part = 0"), rows.filter("part = 1"), learning.pipeline(["amount", "n"], [], learning.models()["logistic"])).drop("seconds")


@query()
def gr24_trained_convolution(spark, sf_dir):
    """Two-layer graph convolution (3, 64 and 2 units), 20 epochs: accounts by amount sent, transfers sent and cyclic ones among them, each over its maximum; metrics of the accounts that were not trained on, and the loss at both ends."""
    t = materialise(tx(spark, sf_dir), "transfers")
    edges = materialise(t.select(F.col("sender").alias("src"), F.col("receiver").alias("dst")).distinct(), "account-pairs")
    cyclic = strong.cyclic_edges(edges).select(F.col("src").alias("sender"), F.col("dst").alias("receiver"), "cyclic")
    sent = t.join(cyclic, ["sender", "receiver"]).groupBy(F.col("sender").alias("id")).agg(F.sum("amount").alias("amount"), F.count("*").cast("double").alias("n"), F.sum("cyclic").cast("double").alias("cycles"), F.max("is_laundering").alias("label"))
    accounts = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(sent, "id", "left").na.fill(0)
    names = ["amount", "n", "cycles"]
    top = accounts.agg(*(F.max(n).alias(n) for n in names)).first()
    nodes = materialise(accounts.select("id", "label", *((F.col(n) / ((top[n] or 0.0) + 1e-9)).alias(n) for n in names)), "accounts")
    parts = learning.stratified_split(nodes, [0.7, 0.3], id_col="id", label="label")
    model = convolution.Convolution(nodes.join(parts, "id").withColumn("train", F.col("part") == 0), edges, names).fit()
    scored = model.probabilities().filter("NOT train").select(F.col("label").cast("int").alias("label"), (F.col("score") >= 0.5).cast("int").alias("predicted"))
    report = relational.metrics(relational.confusion(scored, F.col("label"), F.col("predicted")))
    return report.withColumns({"first_loss": F.lit(model.losses[0]), "last_loss": F.lit(model.losses[-1])})


@query(", o AS (SELECT row_number() OVER (ORDER BY epoch, tx_id) AS i, tx_id, CAST(sender AS VARCHAR) || CAST(receiver AS VARCHAR) || CAST(tx_id AS VARCHAR) AS x FROM txn),\nh(i, tx_id, block, poh) AS (SELECT i, tx_id, (i - 1) // 1024, sha256(x) FROM o WHERE (i - 1) % 1024 = 0 UNION ALL SELECT o.i, o.tx_id, h.block, sha256(h.poh || o.x) FROM h JOIN o ON o.i = h.i + 1 AND (o.i - 1) // 1024 = h.block)\nSELECT tx_id, block, poh FROM h")
def hc1_hash_chain(spark, sf_dir):
    t = tx(spark, sf_dir)
    return graph.chained_hashes(t, relational.global_row_number(t.select("epoch", "tx_id"), ["epoch", "tx_id"]))


@query(ORACLE_SQL["hc1_hash_chain"].replace("\nSELECT tx_id, block, poh FROM h", "") + ", f AS (SELECT sender, min((epoch, tx_id)) AS k, arg_min(tx_id, (epoch, tx_id)) AS tx_id FROM txn GROUP BY 1)\nSELECT a.poh AS from_poh, b.poh AS to_poh, f.sender AS account FROM txn r JOIN f ON f.sender = r.receiver AND (r.epoch, r.tx_id) < f.k JOIN h a ON a.tx_id = r.tx_id JOIN h b ON b.tx_id = f.tx_id", "")
def hc3_linked_list(spark, sf_dir):
    hashes = materialise(hc1_hash_chain(spark, sf_dir), "hashes")
    at = lambda end: hashes.select(F.col("tx_id").alias(end), F.col("poh").alias(f"{end}_poh"))
    links = relational.first_send(tx(spark, sf_dir)).join(at("src"), "src").join(at("dst"), "dst")
    return links.select(F.col("src_poh").alias("from_poh"), F.col("dst_poh").alias("to_poh"), "account")


SEALS = ORACLE_SQL["hc1_hash_chain"].replace("1024", "64").replace("\nSELECT tx_id, block, poh FROM h", "") + """, lv(level, place, hash, n) AS (
  SELECT 0, block, arg_max(poh, i), CAST((SELECT max(block) + 1 FROM h) AS BIGINT) FROM h GROUP BY block
  UNION ALL SELECT max(level) + 1, place // 2, CASE WHEN count(*) = 1 THEN min(hash) ELSE sha256(string_agg(hash, '' ORDER BY place)) END, (max(n) + 1) // 2 FROM lv WHERE n > 1 GROUP BY place // 2)
"""


def _sealed(spark, sf_dir) -> DataFrame:
    """The tree of seals of the transfers in blocks of 64."""
    t = materialise(tx(spark, sf_dir).select("tx_id", "sender", "receiver", "epoch"), "transfers")
    seals = materialise(graph.block_seals(relational.global_row_number(t, ["epoch", "tx_id"]), 64), "block-seals")
    return graph.seal_tree(seals)


@query(SEALS + "SELECT CAST(level AS INTEGER) AS level, CAST(place AS BIGINT) AS place, hash FROM lv", "")
def hc1_seal_tree(spark, sf_dir):
    """The tree of hashes over the seals of all blocks; its last level is the root."""
    return _sealed(spark, sf_dir)


@query(SEALS + "SELECT CAST(place AS BIGINT) AS place, hash AS seal, (SELECT hash FROM lv ORDER BY level DESC LIMIT 1) AS root FROM lv WHERE level = 0", "")
def hc3_proofs_to_root(spark, sf_dir):
    """Every block's seal with the root that its path of siblings leads to, which is the same for all."""
    found = graph.seal_proofs(_sealed(spark, sf_dir))
    return found.select("place", "seal", graph.sealed_root(F.col("seal"), F.col("path")).alias("root"))


# Learning


@query("SELECT tx_id, CAST((row_number() OVER (ORDER BY is_laundering, md5('42:' || tx_id), tx_id) - 1) % 10 AS INTEGER) AS fold FROM txn")
def ml12_stratified_folds(spark, sf_dir):
    return learning.stratified_folds(tx(spark, sf_dir), 10)


@query("SELECT tx_id, CASE WHEN u < 0.7 THEN 0 WHEN u < 0.7 + 0.2 THEN 1 ELSE 2 END AS part FROM (SELECT tx_id, CAST(CAST('0x' || substr(md5('42:' || tx_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM txn)")
def ml13_random_split(spark, sf_dir):
    return learning.random_split(tx(spark, sf_dir).select("tx_id"), [0.7, 0.2, 0.1])


@query("SELECT tx_id, CASE WHEN r <= CAST(floor((SELECT count(*) FROM txn) * 0.7) AS BIGINT) THEN 0 WHEN r <= CAST(floor((SELECT count(*) FROM txn) * 0.85) AS BIGINT) THEN 1 ELSE 2 END AS part FROM (SELECT tx_id, row_number() OVER (ORDER BY epoch, tx_id) AS r FROM txn)")
def ml14_time_split(spark, sf_dir):
    return learning.time_split(tx(spark, sf_dir).select("epoch", "tx_id"), [0.7, 0.15, 0.15], ["epoch", "tx_id"]).select("tx_id", "part")


@query(""", p AS (SELECT (row_number() OVER (ORDER BY epoch, tx_id) - 1) // ((SELECT count(*) FROM txn) // 6) AS s, is_laundering AS y FROM txn)
SELECT k.f AS fold, count(*) FILTER (s <= k.f) AS train_rows, count(*) FILTER (s = k.f + 1) AS test_rows, CAST(sum(y) FILTER (s <= k.f) AS BIGINT) AS train_positive, CAST(sum(y) FILTER (s = k.f + 1) AS BIGINT) AS test_positive FROM p, (SELECT unnest(range(5)) AS f) k GROUP BY 1""")
def ml15_expanding_windows(spark, sf_dir):
    return learning.expanding_windows(tx(spark, sf_dir), 5, ["epoch", "tx_id"])


@query("SELECT sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM (SELECT p, q, sum(q) OVER (ORDER BY s) - q AS below FROM (SELECT round(amount / 1000) AS s, count(*) FILTER (is_laundering = 1) AS p, count(*) FILTER (is_laundering = 0) AS q FROM txn GROUP BY 1))")
def ml9_auc(spark, sf_dir):
    return learning.auc(tx(spark, sf_dir).select("is_laundering", F.rint(F.col("amount") / 1000).alias("score")), "is_laundering", "score")


@query("""SELECT c AS class, count(*) FILTER (y = c) AS support, count(*) FILTER (y = c AND p = c) / count(*) FILTER (p = c) AS precision, count(*) FILTER (y = c AND p = c) / count(*) FILTER (y = c) AS recall,
 2 * count(*) FILTER (y = c AND p = c) / (count(*) FILTER (p = c) + count(*) FILTER (y = c)) AS f1 FROM (SELECT is_laundering AS y, CAST(risk >= 1.5 AS INT) AS p FROM scored), (SELECT unnest([0, 1]) AS c) GROUP BY 1""")
def ml10_by_class(spark, sf_dir):
    t = scored(tx(spark, sf_dir)).withColumn("p", (F.col("risk") >= 1.5).cast("int"))
    return learning.by_class(t, "is_laundering", "p")


@query("SELECT payment_type, dense_rank() OVER (ORDER BY payment_type) - 1 AS code FROM (SELECT DISTINCT payment_type FROM txn)")
def ml4_label_codes(spark, sf_dir):
    kinds = tx(spark, sf_dir).select("payment_type").distinct()
    return relational.global_row_number(kinds, ["payment_type"], "n").select("payment_type", (F.col("n") - 1).alias("code"))


def _labelled(spark, sf_dir):
    return tx(spark, sf_dir).withColumn("label", F.col("is_laundering").cast("double"))


@query()
def ml5_logistic_time_split(spark, sf_dir):
    rows = materialise(learning.time_split(_labelled(spark, sf_dir), [0.8, 0.2], ["epoch", "tx_id"]), "split")
    flow = learning.pipeline(["amount"], ["payment_type", "payment_currency", "received_currency"], learning.models()["logistic"])
    return learning.evaluate(rows.filter("part = 0"), rows.filter("part = 1"), flow).drop("seconds")


@query()
def ml16_cross_validation(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    flow = learning.pipeline(["amount", "epoch"], [], learning.models()["logistic"])
    return learning.fold_report(learning.cross_validate(rows, learning.stratified_folds(rows, 3), flow, 3))


FOLD_OF = ", fold_of AS (SELECT tx_id, (row_number() OVER (ORDER BY is_laundering, md5('42:' || tx_id), tx_id) - 1) % 3 AS fold FROM txn)"


@query(FOLD_OF + """, tr AS (SELECT txn.* FROM txn JOIN fold_of USING (tx_id) WHERE fold <> 0), l AS (SELECT a.tx_id AS a, b.tx_id AS b FROM tr a JOIN tr b ON a.receiver = b.sender AND a.epoch < b.epoch), vs AS (SELECT tx_id AS id FROM tr)""" + COMPONENTS + """,
g AS (SELECT tr.*, c.component, epoch - lag(epoch) OVER (PARTITION BY c.component ORDER BY epoch, tx_id) AS gap FROM tr JOIN comp c ON c.id = tr.tx_id),
feat AS (SELECT component, count(epoch) AS tx_count, round(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount), 6) AS avg_amt, coalesce(round(stddev_samp(amount), 3), 0) AS std_amt,
 max(amount) AS max_amt, min(amount) AS min_amt, coalesce(round(CAST(sum(gap) AS DOUBLE) / nullif(count(gap), 0), 6), 0) AS avg_gap, coalesce(round(stddev_samp(gap), 3), 0) AS std_gap, coalesce(max(gap), 0) AS max_gap, coalesce(min(gap), 0) AS min_gap FROM g GROUP BY component),
seen AS (SELECT sender AS account, epoch, tx_id FROM tr UNION ALL SELECT receiver, epoch, tx_id FROM tr),
known AS (SELECT s.account, c.component FROM (SELECT account, arg_min(tx_id, (epoch, tx_id)) AS tx_id FROM seen GROUP BY 1) s JOIN comp c ON c.id = s.tx_id),
rows_of AS (SELECT id AS tx_id, false AS test, component FROM comp UNION ALL SELECT txn.tx_id, true, k.component FROM txn JOIN fold_of f ON f.tx_id = txn.tx_id AND f.fold = 0 LEFT JOIN known k ON k.account = txn.sender)
SELECT tx_id, test, coalesce(tx_count, 0) AS tx_count, coalesce(avg_amt, 0) AS avg_amt, coalesce(std_amt, 0) AS std_amt, coalesce(max_amt, 0) AS max_amt, coalesce(min_amt, 0) AS min_amt, coalesce(avg_gap, 0) AS avg_gap, coalesce(std_gap, 0) AS std_gap, coalesce(max_gap, 0) AS max_gap, coalesce(min_gap, 0) AS min_gap
FROM rows_of LEFT JOIN feat USING (component)""")
def ml16_fold_features(spark, sf_dir):
    """Features of every transfer for the first of three folds, from the other two alone."""
    t = tx(spark, sf_dir)
    return learning.fold_features(t, learning.stratified_folds(t, 3), 0)


@query()
def ml16_leak_aware_validation(spark, sf_dir):
    """Three folds of logistic regression on raw columns and on fold features that only the train part makes."""
    t = tx(spark, sf_dir)
    return learning.group_fold_report(t, materialise(learning.stratified_folds(t, 3), "fold-of"), 3)


def grouped_rows(spark, sf_dir) -> DataFrame:
    t = materialise(tx(spark, sf_dir), "grouped-transfers")
    spread = graph.propagate_chain(relational.Chain(t))
    component = t.select(F.col("tx_id").alias("id")).join(spread, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return materialise(relational.component_features(t, component).withColumn("label", F.col("label").cast("double")), "grouped-rows")


@query()
def ml5_grouped_logistic(spark, sf_dir):
    """Ten stratified folds of logistic regression over the features of the groups that three rounds of propagation make."""
    rows = grouped_rows(spark, sf_dir)
    folds = learning.stratified_folds(rows, 10, id_col="component", label="label")
    flow = learning.pipeline(learning.FOLD_FEATURES, [], learning.models()["logistic"])
    return learning.fold_report(learning.cross_validate(rows, folds, flow, 10, "component"))


def window_predictions(spark, sf_dir) -> DataFrame:
    rows = materialise(learning.window_slices(_labelled(spark, sf_dir).select("tx_id", "epoch", "amount", "payment_type", "label"), 5, ["epoch", "tx_id"]), "slices")
    flow = learning.pipeline(["amount", "epoch"], ["payment_type"], learning.models()["logistic"])
    return learning.pooled_predictions(rows, [(f"slice <= {i}", f"slice = {i + 1}") for i in range(5)], flow)


@query()
def ml15_expanding_training(spark, sf_dir):
    """Logistic regression on growing windows of time, each tested on the next; fold -1 pools the predictions of all windows."""
    return learning.fold_report(window_predictions(spark, sf_dir))


@query("SELECT CAST((row_number() OVER (ORDER BY epoch, tx_id) - 1) // ((SELECT count(*) FROM txn) // 6) - 1 AS INTEGER) AS fold, tx_id, CAST(is_laundering AS DOUBLE) AS label FROM txn QUALIFY fold BETWEEN 0 AND 4")
def agg22_pooled_rows(spark, sf_dir):
    """The rows of the pooled out-of-fold predictions: every row after the first window, once, in its fold."""
    return window_predictions(spark, sf_dir).select("fold", "tx_id", "label")


@query("""SELECT threshold, p / tp AS tpr, q / tq AS fpr FROM (SELECT s AS threshold, sum(p) OVER w AS p, sum(q) OVER w AS q, sum(p) OVER () AS tp, sum(q) OVER () AS tq
FROM (SELECT round(amount / 1000) AS s, count(*) FILTER (is_laundering = 1) AS p, count(*) FILTER (is_laundering = 0) AS q FROM txn GROUP BY 1) WINDOW w AS (ORDER BY s DESC))""")
def ml9_roc_points(spark, sf_dir):
    return learning.roc_points(tx(spark, sf_dir).select("is_laundering", F.rint(F.col("amount") / 1000).alias("score")), "is_laundering", "score")


WEIGHTED = """, c AS (SELECT unnest([0, 1]) AS k), y AS (SELECT is_laundering AS y, CAST(risk >= 1.5 AS INT) AS p FROM scored),
b AS (SELECT k, count(*) FILTER (y = k) AS n, count(*) FILTER (y = k AND p = k) AS tp, count(*) FILTER (p = k) AS claimed FROM y, c GROUP BY 1)
SELECT sum(tp) / sum(n) AS accuracy, sum(n * CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END) / sum(n) AS weighted_precision, sum(tp) / sum(n) AS weighted_recall, sum(n * 2 * tp / (claimed + n)) / sum(n) AS weighted_f1 FROM b WHERE n + claimed > 0"""


@query(WEIGHTED)
def ml10_weighted(spark, sf_dir):
    t = scored(tx(spark, sf_dir)).withColumn("p", (F.col("risk") >= 1.5).cast("int"))
    return relational.weighted(learning.by_class(t, "is_laundering", "p"))


@query("""SELECT tx_id, CASE WHEN i < floor(n * 0.7) THEN 0 WHEN i < floor(n * (0.7 + 0.2)) THEN 1 ELSE 2 END AS part
FROM (SELECT tx_id, row_number() OVER (PARTITION BY is_laundering ORDER BY md5('42:' || tx_id), tx_id) - 1 AS i, count(*) OVER (PARTITION BY is_laundering) AS n FROM txn)""")
def ml13_stratified_split(spark, sf_dir):
    return learning.stratified_split(tx(spark, sf_dir), [0.7, 0.2, 0.1])


@query()
def ml17_ablation(spark, sf_dir):
    t, edges, comp = groups(spark, sf_dir)
    columns = graph.account_columns(edges, comp)
    wanted = ["amount", "payment_type", "degree", "group_node_count", "group_bidirect_ratio"]
    rows = _labelled(spark, sf_dir).join(columns.withColumnRenamed("id", "sender"), "sender").select("tx_id", "epoch", "label", *wanted)
    rows = materialise(learning.time_split(rows, [0.8, 0.2], ["epoch", "tx_id"]), "split")
    modes = {"transfer": (["amount"], ["payment_type"]), "graph": (["degree", "group_node_count", "group_bidirect_ratio"], []), "both": (["amount", "degree", "group_node_count"], ["payment_type"])}
    return learning.ablation(rows.filter("part = 0"), rows.filter("part = 1"), modes, ["logistic", "tree", "forest", "svm"]).drop("seconds")


@query("SELECT payment_type, CAST(row_number() OVER (ORDER BY count(*) DESC, payment_type) - 1 AS DOUBLE) AS code FROM txn GROUP BY 1")
def ml2_frequency_codes(spark, sf_dir):
    t = tx(spark, sf_dir).select("payment_type")
    return learning.indexer("payment_type", "code").fit(t).transform(t.distinct()).select("payment_type", "code")


@query("""SELECT payment_type, array_to_string(list_transform(range(n - 1), lambda x: CASE WHEN x = r - 1 THEN '1' ELSE '0' END), ',') AS slots
FROM (SELECT payment_type, row_number() OVER (ORDER BY count(*) DESC, payment_type) AS r, count(*) OVER () AS n FROM txn GROUP BY 1)""")
def ml3_one_hot(spark, sf_dir):
    t = tx(spark, sf_dir).select("payment_type")
    coded = learning.indexer("payment_type", "code", "error").fit(t).transform(t.distinct())
    return learning.one_hot(coded, "code", "hot").select("payment_type", F.array_join(F.transform("hot", lambda x: x.cast("int").cast("string")), ",").alias("slots"))


def _fold_metrics(spark, sf_dir) -> DataFrame:
    t = scored(tx(spark, sf_dir))
    folds = learning.stratified_folds(t, 10)
    hit = lambda a, b: F.count_if((F.col("is_laundering") == a) & ((F.col("risk") >= 1.5).cast("int") == b))
    counts = t.join(folds, "tx_id").groupBy("fold").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    return relational.metrics(counts)


FOLDS = """, r AS (SELECT CAST((row_number() OVER (ORDER BY is_laundering, md5('42:' || tx_id), tx_id) - 1) % 10 AS INTEGER) AS fold, is_laundering AS y, CAST(risk >= 1.5 AS INT) AS p FROM scored),
m AS (SELECT fold, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn FROM r GROUP BY 1),
v AS (SELECT CAST(fold AS VARCHAR) AS fold, (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM m)
"""


@query(FOLDS + "SELECT fold, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM v UNION ALL SELECT 'avg', round(avg(accuracy), 9), round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9) FROM v")
def snk3_fold_table(spark, sf_dir):
    rows = materialise(_fold_metrics(spark, sf_dir), "fold-metrics")
    names = ["accuracy", "precision", "recall", "f1"]
    mean = rows.agg(*(F.avg(n).alias(n) for n in names)).withColumn("fold", F.lit("avg"))
    return rows.withColumn("fold", F.col("fold").cast("string")).select("fold", *names).unionByName(mean).select("fold", *(F.round(n, 9).alias(n) for n in names))


@query()
def ml11_importances(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    flow = learning.pipeline(["amount", "epoch"], ["payment_type", "payment_currency"], learning.models()["forest"])
    return spark.createDataFrame(learning.importances(flow.fit(rows), rows), "feature string, importance double")


@query()
def ml7_boosted_trees(spark, sf_dir):
    rows = materialise(learning.time_split(_labelled(spark, sf_dir), [0.8, 0.2], ["epoch", "tx_id"]), "split")
    flow = learning.pipeline(["amount"], ["payment_type", "payment_currency"], learning.models()["boosted"], one_hot=False)
    return learning.evaluate(rows.filter("part = 0"), rows.filter("part = 1"), flow).drop("seconds")


@query()
def ml7_attributions(spark, sf_dir):
    """(feature, mean_attribution, mean_size, margin_error): how boosted trees use each feature on the test rows, and the greatest gap between a row's margin and the sum of its attributions."""
    columns = ["amount", "payment_type", "payment_currency"]
    rows = materialise(learning.time_split(_labelled(spark, sf_dir).select("tx_id", "epoch", "label", *columns), [0.8, 0.2], ["epoch", "tx_id"]), "split")
    features = learning.pipeline(columns[:1], columns[1:], one_hot=False).fit(rows.filter("part = 0"))
    groups = materialise(learning.grouped(rows, columns, ["part"]), "split-groups")  # equal rows are fitted by weight and attributed once
    fitted = materialise(features.transform(learning.instances(groups.filter("part = 0"))).select("features", "label", "weight"), "train-instances")
    model = learning.models()["boosted"].setWeightCol("weight").fit(fitted)
    test = features.transform(groups.filter("part = 1"))
    names = learning.feature_names(test)
    found = materialise(attributions.attribute(test, attributions.trees_of(spark, model), names, "n"), "attributions")
    gap = F.abs(F.col("margin") - F.col("mean") - sum(F.col(n) for n in names))
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    means = found.agg(F.max(gap).alias("margin_error"), *(mean(F.col(n)).alias(f"a_{n}") for n in names), *(mean(F.abs(n)).alias(f"s_{n}") for n in names)).first()  # one row
    return spark.createDataFrame([(n, means[f"a_{n}"], means[f"s_{n}"], means["margin_error"]) for n in names], "feature string, mean_attribution double, mean_size double, margin_error double")


@query()
def ml18_flow_seconds(spark, sf_dir):
    """Seconds of each of three folds for the raw flow and the grouped one, and their means."""
    t = materialise(tx(spark, sf_dir), "transfers")
    return learning.flow_seconds(t, materialise(learning.stratified_folds(t, 3), "fold-of"), 3)


def edge_rows(spark, sf_dir) -> DataFrame:
    """Transfers with the flag of edges on cycles, and part: 70, 20 and 10 percent of each label."""
    t = materialise(_labelled(spark, sf_dir), "edge-rows")
    flags = strong.cyclic_edges(t.select(F.col("sender").alias("src"), F.col("receiver").alias("dst")))
    parts = learning.stratified_split(t, [0.7, 0.2, 0.1])
    return materialise(t.join(flags.select(F.col("src").alias("sender"), F.col("dst").alias("receiver"), "cyclic"), ["sender", "receiver"]).join(parts, "tx_id"), "edge-rows")


@query()
def ml5_learned_edge_risks(spark, sf_dir):
    """A regression on edges, its probabilities as risks, groups of accounts at the threshold that is best on the validation part, and same-group metrics of validation and test part."""
    return learning.risk_group_report(materialise(learning.learned_risks(edge_rows(spark, sf_dir)), "learned-risks"))


# Risk paths, group details and lookups


NODES = ORACLE_SQL["gr11_levels_and_risk"].replace("SELECT id, max(k) AS level", ", node AS (SELECT id, max(k) AS level") + ")\n"


@query(NODES + "SELECT id, level, row_number() OVER (ORDER BY level, id) AS place FROM node", "")
def gr5_topological_order(spark, sf_dir):
    nodes = gr11_levels_and_risk(spark, sf_dir).select("level", "id")
    return relational.global_row_number(nodes, ["level", "id"], "place").select("id", "level", "place")


@query(CLOSURE + "SELECT 'accounts' AS edges, NOT EXISTS (SELECT 1 FROM loops) AND NOT EXISTS (SELECT 1 FROM pairs WHERE src = dst) AS dag UNION ALL SELECT 'later accounts', NOT EXISTS (SELECT 1 FROM pairs WHERE src < dst AND dst < src)")
def gr6_is_dag(spark, sf_dir):
    """The account graph, and its edges that go to a greater account, which have no cycle."""
    edges = materialise(graph.account_edges(tx(spark, sf_dir)), "account-edges")
    tables = {"accounts": edges, "later accounts": edges.filter("src < dst")}
    return spark.createDataFrame([(name, graph.is_dag(e)) for name, e in tables.items()], "edges string, dag boolean")


@query(NODES + """, best AS (SELECT dst AS id, arg_max(src, (risk, -src)) AS pred FROM chain JOIN node ON node.id = chain.src GROUP BY dst),
tr(id, hops) AS (SELECT arg_max(id, (risk, -id)), CAST(0 AS BIGINT) FROM node UNION ALL SELECT pred, hops + 1 FROM tr JOIN best ON best.id = tr.id) SELECT id, hops FROM tr""", "")
def gr14_trace_of_top_risk(spark, sf_dir):
    nodes = materialise(gr11_levels_and_risk(spark, sf_dir), "nodes")
    top = nodes.orderBy(F.desc("risk"), "id").limit(1).select("id")
    return graph.trace(graph.chain_predecessor(relational.Chain(tx(spark, sf_dir)), nodes), top).select("id", "hops")


@query(NODES + ", scored_rows AS (SELECT t.is_laundering AS y, CAST(n.risk >= 5 AS INT) AS p FROM node n JOIN txn t ON t.tx_id = n.id)" + METRICS, "")
def gr15_risk_threshold(spark, sf_dir):
    nodes = gr11_levels_and_risk(spark, sf_dir)
    rows = tx(spark, sf_dir).join(nodes.select(F.col("id").alias("tx_id"), (F.col("risk") >= 5).cast("int").alias("p")), "tx_id")
    return relational.metrics(relational.confusion(rows, F.col("is_laundering"), F.col("p")))


@query(RISK_GROUPS + """, big AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), mem AS (SELECT id FROM comp JOIN big USING (component))
SELECT sender AS src, receiver AS dst, count(*) AS n, max(is_laundering) AS flagged FROM txn WHERE sender IN (SELECT id FROM mem) AND receiver IN (SELECT id FROM mem) GROUP BY ALL""")
def gr19_group_flow(spark, sf_dir):
    t, _, comp = groups(spark, sf_dir)
    largest = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    members = comp.join(largest, "component", "left_semi").select("id")
    flow = relational.induced(t.select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), "is_laundering"), members)
    return flow.groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("is_laundering").alias("flagged"))


@query(SHAPE + "SELECT component, n, n_sources, n_sinks FROM shape")
def agg11_group_shape(spark, sf_dir):
    _, edges, comp = groups(spark, sf_dir)
    return graph.group_shape(edges, comp)


@query(SHAPE + "SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_accounts, count(*) FILTER (n_sources = 0) AS without_source, count(*) FILTER (n_sinks = 0) AS without_sink, max(n) AS largest FROM shape")
def agg21_group_totals(spark, sf_dir):
    return agg11_group_shape(spark, sf_dir).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_accounts"), F.count_if(F.col("n_sources") == 0).alias("without_source"), F.count_if(F.col("n_sinks") == 0).alias("without_sink"), F.max("n").alias("largest"))


@query("SELECT t.tx_id, coalesce(CAST(p.risk AS DOUBLE), 0) AS risk FROM txn t LEFT JOIN (SELECT * FROM pairs WHERE risk >= 1.5) p ON p.src = t.receiver AND p.dst = t.sender")
def join11_lookup_or_default(spark, sf_dir):
    back = graph.account_edges(tx(spark, sf_dir)).filter("risk >= 1.5").select(F.col("src").alias("receiver"), F.col("dst").alias("sender"), "risk")
    return tx(spark, sf_dir).select("tx_id", "sender", "receiver").join(back, ["sender", "receiver"], "left").select("tx_id", F.coalesce("risk", F.lit(0.0)).alias("risk"))


@query(", s AS (SELECT sender AS a, max(CAST(risk AS DOUBLE)) AS r FROM scored GROUP BY 1) SELECT tx_id, greatest(coalesce(u.r, 0), coalesce(v.r, 0)) AS risk FROM txn LEFT JOIN s u ON u.a = sender LEFT JOIN s v ON v.a = receiver")
def fn11_endpoint_risk(spark, sf_dir):
    t = tx(spark, sf_dir)
    own = materialise(scored(t).groupBy("sender").agg(F.max("risk").alias("r")), "account-risk")
    at = lambda end: own.select(F.col("sender").alias(end), F.col("r").alias(f"{end}_r"))
    joined = t.join(at("sender"), "sender", "left").join(at("receiver"), "receiver", "left")
    return joined.select("tx_id", F.greatest(F.coalesce("sender_r", F.lit(0.0)), F.coalesce("receiver_r", F.lit(0.0))).alias("risk"))


@query("SELECT tx_id, amount FROM scored WHERE is_laundering = 1 AND risk < 2.5")
def flt3_missed(spark, sf_dir):
    return scored(tx(spark, sf_dir)).filter("is_laundering = 1 AND risk < 2.5").select("tx_id", "amount")


@query("SELECT tx_id, epoch FROM txn ORDER BY epoch, tx_id LIMIT 250000")
def flt10_row_cap(spark, sf_dir):
    return relational.first_rows(tx(spark, sf_dir).select("tx_id", "epoch"), ["epoch", "tx_id"], 250_000)


@query("SELECT * FROM txn ORDER BY epoch, tx_id LIMIT 1000")
def src5_first_rows(spark, sf_dir):
    return relational.first_rows(tx(spark, sf_dir), ["epoch", "tx_id"], 1000)


@query("SELECT account, count(*) AS n FROM (SELECT sender AS account FROM txn UNION ALL SELECT receiver FROM txn) GROUP BY 1")
def set1_both_ends(spark, sf_dir):
    t = tx(spark, sf_dir)
    return t.select(F.col("sender").alias("account")).unionByName(t.select(F.col("receiver").alias("account"))).groupBy("account").agg(F.count("*").alias("n"))


@query("SELECT sender AS id FROM txn UNION SELECT receiver FROM txn")
def set4_vertices(spark, sf_dir):
    t = tx(spark, sf_dir)
    return t.select(F.col("sender").alias("id")).union(t.select("receiver")).distinct()


@query(RISK_GROUPS + "SELECT count(*) AS overlapping FROM (SELECT id FROM comp GROUP BY 1 HAVING count(DISTINCT component) > 1)")
def set5_groups_are_disjoint(spark, sf_dir):
    _, _, comp = groups(spark, sf_dir)
    return comp.groupBy("id").agg(F.count_distinct("component").alias("k")).filter("k > 1").agg(F.count("*").alias("overlapping"))


def graphml(spark, sf_dir) -> str:
    edges = tx(spark, sf_dir).select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), F.col("epoch").alias("ts"))
    return source.write_graphml(set4_vertices(spark, sf_dir), edges, f"{shared_dir(spark)}/graphml-{uuid.uuid4().hex}")


@query("SELECT CAST(sender AS VARCHAR) AS src, CAST(receiver AS VARCHAR) AS dst, CAST(epoch AS VARCHAR) AS ts FROM txn")
def snk6_graphml_round_trip(spark, sf_dir):
    return source.read_graphml_edges(spark, graphml(spark, sf_dir))


@query("SELECT CAST(sender AS VARCHAR) AS id FROM txn UNION SELECT CAST(receiver AS VARCHAR) FROM txn")
def snk6_graphml_nodes(spark, sf_dir):
    return source.read_graphml_nodes(spark, graphml(spark, sf_dir))


# Flags, projections, reports


FLAGGED = ", flagged AS (SELECT tx_id, is_laundering, CAST((receiver, sender) IN (SELECT (src, dst) FROM pairs) AS INTEGER) AS mutual FROM txn)\n"


def mutual_flags(t: DataFrame) -> DataFrame:
    """tx_id, is_laundering, mutual: 1 if the receiver has sent to the sender too."""
    back = t.select(F.col("receiver").alias("sender"), F.col("sender").alias("receiver"), F.lit(1).alias("mutual")).distinct()
    return t.select("tx_id", "sender", "receiver", "is_laundering").join(back, ["sender", "receiver"], "left").select("tx_id", "is_laundering", F.coalesce("mutual", F.lit(0)).alias("mutual"))


@query(FLAGGED + "SELECT tx_id, mutual FROM flagged")
def fn13_pair_flag(spark, sf_dir):
    return mutual_flags(tx(spark, sf_dir)).select("tx_id", "mutual")


@query(FLAGGED + "SELECT tx_id, greatest(is_laundering, mutual) AS label FROM flagged")
def fn12_label_or_flag(spark, sf_dir):
    return mutual_flags(tx(spark, sf_dir)).select("tx_id", F.greatest("is_laundering", "mutual").alias("label"))


@query(""", re(src, dst) AS (SELECT src, dst FROM pairs UNION SELECT re.src, e.dst FROM re JOIN pairs e ON e.src = re.dst)
SELECT tx_id, cyclic, greatest(is_laundering, cyclic) AS label FROM (SELECT *, CAST((receiver, sender) IN (SELECT (src, dst) FROM re) OR sender = receiver AS INTEGER) AS cyclic FROM txn)""")
def gr4_cyclic_transfers(spark, sf_dir):
    """Transfers whose edge lies on a cycle of transfers: to oneself, or within a strongly connected component; and the label or that flag."""
    t = materialise(tx(spark, sf_dir), "transfers")
    flags = strong.cyclic_edges(t.select(F.col("sender").alias("src"), F.col("receiver").alias("dst")))
    flags = flags.select(F.col("src").alias("sender"), F.col("dst").alias("receiver"), "cyclic")
    return t.join(flags, ["sender", "receiver"]).select("tx_id", "cyclic", F.greatest("is_laundering", "cyclic").alias("label"))


@query(""", re(src, dst) AS (SELECT src, dst FROM pairs UNION SELECT re.src, e.dst FROM re JOIN pairs e ON e.src = re.dst),
both_ways AS (SELECT a.src AS id, a.dst AS other FROM re a JOIN re b ON a.src = b.dst AND a.dst = b.src UNION SELECT src, src FROM pairs UNION SELECT dst, dst FROM pairs)
SELECT id, min(other) AS component FROM both_ways GROUP BY 1""")
def gr4_strong_components(spark, sf_dir):
    t = tx(spark, sf_dir)
    return strong.strong_components(t.select(F.col("sender").alias("src"), F.col("receiver").alias("dst")))


@query(RISK_GROUPS + ", d AS (SELECT component, count(*) AS n, sum(is_laundering) AS flagged FROM txn JOIN comp ON comp.id = sender GROUP BY 1) SELECT component, n, CAST(flagged AS BIGINT) AS flagged, row_number() OVER (ORDER BY flagged DESC, component) AS place FROM d")
def srt4_groups_by_flagged(spark, sf_dir):
    """Groups in order of their flagged transfers."""
    t, _, comp = groups(spark, sf_dir)
    by = t.join(comp, t.sender == comp.id).groupBy("component").agg(F.count("*").alias("n"), F.sum("is_laundering").alias("flagged"))
    return relational.global_row_number(by.withColumn("_less", -F.col("flagged")), ["_less", "component"], "place").drop("_less")


@query("SELECT tx_id, amount, payment_type FROM txn")
def prj5_present_columns(spark, sf_dir):
    return relational.present(tx(spark, sf_dir), ["tx_id", "amount", "hour", "payment_type", "channel"])


@query("SELECT t.*, p.risk FROM txn t JOIN pairs p ON p.src = t.sender AND p.dst = t.receiver")
def prj7_star_of_one_side(spark, sf_dir):
    t = tx(spark, sf_dir)
    a, p = t.alias("a"), graph.account_edges(t).alias("p")
    return a.join(p, (F.col("a.sender") == F.col("p.src")) & (F.col("a.receiver") == F.col("p.dst"))).select("a.*", "p.risk")


@query("SELECT * FROM (VALUES (0, 'tx_id', 'bigint'), (1, 'sender', 'bigint'), (2, 'receiver', 'bigint'), (3, 'amount', 'double'), (4, 'epoch', 'bigint'), (5, 'payment_type', 'string'), (6, 'payment_currency', 'string'), (7, 'received_currency', 'string'), (8, 'sender_bank_location', 'string'), (9, 'receiver_bank_location', 'string'), (10, 'is_laundering', 'int'), (11, 'laundering_type', 'string')) AS t(position, name, type)", "")
def src12_schema(spark, sf_dir):
    return source.schema_table(tx(spark, sf_dir))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation", "")
def src11_from_pandas(spark, sf_dir):
    frame = source.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).toPandas()  # 25 rows
    return source.from_pandas(spark, frame, "id int, name string")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation", "")
def src9_paths(spark, sf_dir):
    """Tables by the paths that the file system's scheme makes of them."""
    at = lambda name: spark.read.parquet(sf_dir + f"/{name}.parquet" if "://" in sf_dir else f"file://{sf_dir}/{name}.parquet")
    return at("region").select("r_regionkey", "r_name").union(at("nation").select("n_nationkey", "n_name"))


@query("SELECT * FROM txn")
def snk1_csv_byte_order_mark(spark, sf_dir):
    return source.read_csv(spark, source.write_csv(tx(spark, sf_dir), f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}", bom=True))


@query("SELECT count(*) AS n, count(*) FILTER (is_laundering = 1) AS flagged, max(epoch) AS latest FROM txn")
def snk12_observed_counts(spark, sf_dir):
    """Counts of the rows of a table, observed by the job that writes it."""
    t = tx(spark, sf_dir)
    seen = source.write_observed(t, f"{shared_dir(spark)}/observed-{uuid.uuid4().hex}", n=F.count(F.lit(1)), flagged=F.count_if(F.col("is_laundering") == 1), latest=F.max("epoch"))
    return spark.createDataFrame([(seen["n"], seen["flagged"], seen["latest"])], "n long, flagged long, latest long")


@query(", n AS (SELECT count(*) FILTER (is_laundering = 1 AND risk >= 1.5) AS tp, count(*) FILTER (is_laundering = 0 AND risk >= 1.5) AS fp, count(*) FILTER (is_laundering = 0 AND risk < 1.5) AS tn, count(*) FILTER (is_laundering = 1 AND risk < 1.5) AS fn FROM scored)\nSELECT *, (tp + tn) / (tp + tn + fp + fn + 1e-6) AS accuracy, tp / (tp + fp + 1e-6) AS precision, tp / (tp + fn + 1e-6) AS recall, 2 * tp / (2 * tp + fp + fn + 1e-6) AS f1 FROM n")
def agg8_smoothed_metrics(spark, sf_dir):
    t = scored(tx(spark, sf_dir))
    return relational.metrics(relational.confusion(t, F.col("is_laundering"), (F.col("risk") >= 1.5).cast("int")), 1e-6)


@query(""", un AS (SELECT src AS a, dst AS b FROM pairs WHERE src <> dst UNION SELECT dst, src FROM pairs WHERE src <> dst), vs AS (SELECT src AS id FROM pairs UNION SELECT dst FROM pairs),
chosen AS (SELECT id FROM vs ORDER BY md5('42:' || id), id LIMIT 16), bfs(start, n, d) USING KEY (start, n) AS (SELECT id, id, CAST(0 AS BIGINT) FROM chosen UNION (SELECT bfs.start, un.b, min(bfs.d + 1) FROM bfs JOIN un ON un.a = bfs.n
  LEFT JOIN recurring.bfs AS old ON old.start = bfs.start AND old.n = un.b WHERE old.d IS NULL GROUP BY ALL))
SELECT vs.id, count(d) AS reached, CAST(coalesce(sum(d), 0) AS BIGINT) AS distance, coalesce(count(d) / sum(d), 0) AS closeness FROM vs LEFT JOIN bfs ON bfs.n = vs.id AND bfs.d > 0 GROUP BY vs.id""")
def gr25_pivot_closeness(spark, sf_dir):
    return graph.pivot_closeness(graph.account_edges(tx(spark, sf_dir)))


# Streams


@query()
def gr25_pivot_betweenness(spark, sf_dir):
    return graph.pivot_betweenness(graph.account_edges(tx(spark, sf_dir)))


def _delivered(spark, sf_dir, copies: int = 1) -> tuple[str, DataFrame]:
    """(folder, table): the transfers as files of a folder, as a producer leaves them."""
    path, t = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}", tx(spark, sf_dir)
    for _ in range(copies):
        t.write.mode("append").parquet(path)
    return path, t


@query("""SELECT e // 86400 * 86400 AS window_start, payment_type, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (SELECT *, epoch AS e FROM txn)
WHERE e // 86400 * 86400 + 86400 <= (SELECT max(epoch) FROM txn) - 3600 GROUP BY 1, 2""")
def stm1_closed_windows(spark, sf_dir):
    path, t = _delivered(spark, sf_dir)
    totals = streaming.windowed_totals(streaming.read_transfers(spark, path, t.schema))
    return streaming.drain(totals, streaming.folder(spark, uuid.uuid4().hex)).withColumn("total", F.col("total").cast("double"))


@query("SELECT sender, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM txn GROUP BY 1")
def stm2_running_totals(spark, sf_dir):
    path, t = _delivered(spark, sf_dir)
    arrivals = streaming.read_transfers(spark, path, t.schema, files_per_batch=4)
    return streaming.accumulate(arrivals, ["sender"], streaming.folder(spark, uuid.uuid4().hex)).withColumn("total", F.col("total").cast("double"))


@query("SELECT tx_id, amount FROM txn")
def stm3_first_deliveries(spark, sf_dir):
    path, t = _delivered(spark, sf_dir, copies=2)
    kept = streaming.first_deliveries(streaming.read_transfers(spark, path, t.schema))
    return streaming.drain(kept.select("tx_id", "amount"), streaming.folder(spark, uuid.uuid4().hex))


@query("SELECT tx_id, sender, amount FROM txn WHERE sender IN (SELECT sender FROM txn WHERE is_laundering = 1)")
def stm4_flagged_senders(spark, sf_dir):
    path, t = _delivered(spark, sf_dir)
    bad = materialise(t.filter("is_laundering = 1").select(F.col("sender").alias("account")), "flagged-accounts")
    hits = streaming.flagged(streaming.read_transfers(spark, path, t.schema), bad)
    return streaming.drain(hits.select("tx_id", "sender", "amount"), streaming.folder(spark, uuid.uuid4().hex))
