"""Transactions: the fixed schema, readers, writers, and the adapters that derive transfers from other tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = """tx_id long, sender long, receiver long, amount double, epoch long, payment_type string, payment_currency string, received_currency string,
sender_bank_location string, receiver_bank_location string, is_laundering int, laundering_type string"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers from orders: one a row, keyed by the order key, between customers."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n = customers.agg(F.count("*").alias("n")).scalar()
    party = lambda p: customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias(p), F.col("c_mktsegment").alias(f"{p}_segment"), F.col("n_name").alias(f"{p}_nation"))
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tx_id"),
        F.col("o_custkey").alias("sender"),
        ((F.col("o_custkey") * 7 + F.col("o_orderkey") * 13) % n).alias("receiver"),
        F.col("o_totalprice").alias("amount"),
        (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") * 7919) % 86400).alias("epoch"),
        F.col("o_orderpriority").alias("payment_type"),
        "o_orderstatus",
    )
    flag = ((F.col("o_orderstatus") == "F") & (F.col("payment_type") == "1-URGENT")).cast("int")
    return (
        base.join(party("sender"), "sender")
        .join(party("receiver"), "receiver")
        .select("tx_id", "sender", "receiver", "amount", "epoch", "payment_type", F.col("sender_segment").alias("payment_currency"), F.col("receiver_segment").alias("received_currency"), F.col("sender_nation").alias("sender_bank_location"), F.col("receiver_nation").alias("receiver_bank_location"), flag.alias("is_laundering"), F.col("o_orderstatus").alias("laundering_type"))
    )


def event_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers from events: user to the number in the properties. Accounts are few and busy."""
    receiver = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("tx_id"), F.col("user_id").alias("sender"), receiver.alias("receiver"), F.col("value").alias("amount"), F.unix_micros(F.col("ts").cast("timestamp")).alias("epoch"))


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = SCHEMA) -> DataFrame:
    """CSV with a header; types are never inferred. ``path`` may be a list or hold wildcards; schema None reads strings."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def typed(df: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """All-string columns to the types of ``schema``; what doesn't parse becomes null."""
    pairs = [p.split() for p in schema.replace("\n", " ").split(",")]
    return df.select(*(F.expr(f"try_cast(`{name}` AS {kind})").alias(name) for name, kind in pairs))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", bom: bool = False) -> str:
    """CSV with a header; ``bom`` begins every file with a byte-order mark, which ``read_csv`` with a schema skips with the header."""
    named = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if bom else df
    named.write.mode(mode).option("header", True).csv(path)
    return path


def from_pandas(spark: SparkSession, frame, schema: str = SCHEMA) -> DataFrame:
    """A pandas frame, which the driver holds whole, as a table of the fixed schema: for small inputs such as lists of accounts."""
    return spark.createDataFrame(frame, schema)


def write_edge_list(edges: DataFrame, path: str) -> str:
    """``src dst`` lines."""
    edges.select(F.concat_ws(" ", F.col("src"), F.col("dst")).alias("value")).write.text(path)
    return path


def write_observed(df: DataFrame, path: str, mode: str = "errorifexists", **measures: Column) -> dict:
    """Writes Parquet and returns aggregates of the rows written, which the write itself observes: no second scan.

    ``measures`` are named aggregates; without any, the number of rows (``n``). They are seen after the last shuffle, where each task counts once however often it was tried. An empty table
    gives counts of 0 and null for other aggregates. The write runs in a session of its own that sees the plan as a global view: a session that once observed
    can't ship pyspark.ml models with a summary any more (Spark 4.1.2), and the caller's never does.
    """
    spark, name, seen = df.sparkSession, f"observed_{uuid.uuid4().hex}", Observation()
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        own.conf.set(key, spark.conf.get(key))
    df.createGlobalTempView(name)
    try:
        measured = [c.alias(k) for k, c in measures.items()] or [F.count(F.lit(1)).alias("n")]
        own.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{name}").observe(seen, *measured).write.mode(mode).parquet(path)
        return seen.get
    finally:
        spark.catalog.dropGlobalTempView(name)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", " ")
    return spark.read.text(path).select(part[0].cast("long").alias("src"), part[1].cast("long").alias("dst"))


def read_graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a GraphML file: source, target and the edge's first data value, as strings."""
    rows = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, data array<struct<_VALUE:string,_key:string>>").load(path)
    return rows.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("data")[0]["_VALUE"].alias("ts"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """One GraphML document of nodes (id) and edges (src, dst, ts), as the lines of a folder's files in order of their names.

    The document begins with its declarations and ends with the last file; lines are dealt out by range, so files are as many as there are partitions.
    """
    text = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    line = lambda df, part, *pieces: df.select(F.lit(part).alias("part"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces)).alias("value"))
    one = nodes.sparkSession.range(1)
    begin = line(one, 0, '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="ts" for="edge" attr.name="timestamp" attr.type="string"/>\n<graph edgedefault="directed">')
    own = line(nodes.select("id").distinct(), 1, '<node id="', text("id"), '"/>')
    links = line(edges, 2, '<edge source="', text("src"), '" target="', text("dst"), '"><data key="ts">', F.coalesce(text("ts"), F.lit("")), "</data></edge>")
    rows = begin.unionByName(own).unionByName(links).unionByName(line(one, 3, "</graph>\n</graphml>"))
    rows.repartitionByRange("part", "value").sortWithinPartitions("part", "value").select("value").write.text(path)
    return path


def read_graphml_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "node").schema("_id string").load(path).select(F.col("_id").alias("id"))


def write_pages(df: DataFrame, order: list[str], path: str, page_rows: int = 10_000) -> str:
    """One folder a page of ``page_rows`` rows, all in one job."""
    from cairn.operators.relational import global_row_number

    numbered = global_row_number(df, order, "_rn")
    numbered.withColumn("page", F.ceil(F.col("_rn") / page_rows)).drop("_rn").write.partitionBy("page").parquet(path)
    return path


def schema_table(df: DataFrame) -> DataFrame:
    """(position, name, type) of the columns."""
    return df.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "position int, name string, type string")
