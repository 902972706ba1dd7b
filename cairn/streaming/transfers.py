"""Transfers as a stream: totals of closed windows, first deliveries, and running totals from batches that may be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.operators.scratch import shared_dir


def read_transfers(spark: SparkSession, folder: str, schema: str | StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive in ``folder``; a column ``at`` holds the time of the transfer."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn("at", F.timestamp_seconds("epoch"))


def windowed_totals(stream: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(window_start, payment_type, n, total) of every window; state is kept until ``delay`` after its end."""
    by = stream.withWatermark("at", delay).groupBy(F.window("at", width).alias("w"), "payment_type")
    totals = by.agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("total"))
    return totals.select(F.unix_timestamp("w.start").alias("window_start"), "payment_type", "n", "total")


def first_deliveries(stream: DataFrame, key: str = "tx_id", delay: str = "1 day") -> DataFrame:
    """The rows without those whose key was delivered before, at most ``delay`` apart."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark([key])


def flagged(stream: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transfers whose sender is in the table of accounts (column ``account``), which is read anew in every batch."""
    return stream.join(accounts.select(F.col("account").alias("sender")).distinct(), "sender", "left_semi")


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Appends all that has arrived to ``path``, exactly once, and returns the table. A later call goes on where this one ended."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def accumulate(stream: DataFrame, keys: list[str], path: str) -> DataFrame:
    """(keys, n, total): running totals of all batches so far.

    Each batch writes its partial totals to a folder of its own, which a repeated batch overwrites, so no batch counts twice and
    no state grows with the keys. Amounts are added as decimals.
    """

    spark = stream.sparkSession
    schema = "".join(f"`{k}` {stream.schema[k].dataType.simpleString()}, " for k in keys) + "n long, total decimal(28,2)"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/parts/batch=-1")

    def add(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("total"))
        part.write.mode("overwrite").parquet(f"{path}/parts/batch={batch_id}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.schema(schema).parquet(f"{path}/parts")
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def folder(spark: SparkSession, name: str) -> str:
    """A folder for the progress and the rows of a stream, in the shared folder."""
    return f"{shared_dir(spark)}/stream-{name}"
