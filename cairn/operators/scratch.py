"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else, on one machine, a folder in the warehouse; a cluster must name the folder that its machines share."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cairn_scratch").rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Within it, intermediate tables go to a database of their own in the shared folder; at its end, also after an error, they are deleted.

    Results that are read lazily from them must be written or collected before the end. Without a scope the tables stay in the shared folder.
    """
    name = f"cairn_scratch_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_dir(spark)}/{name}'")
    _open.append(name)
    try:
        yield name
    finally:
        _open.remove(name)
        spark.sql(f"DROP DATABASE {name} CASCADE")


def table_name(tag: str) -> str:
    """A new table name, in the open scope's database if there is one."""
    name = re.sub(r"\W", "_", f"cairn_{tag}_{uuid.uuid4().hex}")
    return f"{_open[-1]}.{name}" if _open else name


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    if _open:
        name = table_name(tag)
        df.write.format("parquet").option("compression", "zstd").saveAsTable(name)
        return spark.table(name)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not collect it in the driver.

    Spark judges a written table by the size of its files, and one row of dense ids and few groups may take a byte there but dozens in a broadcast.
    """
    return df.hint("shuffle_merge")


def hashed(df: DataFrame) -> DataFrame:
    """``df``, of one row a key, for a join that hashes its part of each partition and lets the other side stream past, neither sorted nor held; never collected in the driver."""
    return df.hint("shuffle_hash")


#: Rows from which ``sided`` hashes a side within partitions; a smaller one Spark may broadcast by its measured size.
MANY = 50000


def sided(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of one row a key and about ``rows`` rows, for a join with a large table that is neither to be sorted nor moved for a few rows."""
    return hashed(df) if rows > MANY else df


def bucketed(df: DataFrame, key: str, tag: str) -> DataFrame:
    """Like ``materialise``, in as many buckets of ``key`` as shuffles have partitions: a join by it moves only the other side. Outside a scope the session's catalog keeps the table's name."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), table_name(tag)
    writer = df.repartition(n, key).write.format("parquet").option("compression", "zstd").bucketBy(n, key)
    (writer if _open else writer.option("path", f"{shared_dir(spark)}/{name}")).saveAsTable(name)
    return spark.table(name)


class Growing:
    """A table in the shared folder to which rounds append, so that a result of many rounds is one scan and not a union of many tables."""

    def __init__(self, spark: SparkSession, schema: str, tag: str):
        self.spark, self.schema, self.name = spark, schema, table_name(tag)
        self.path = None if _open else f"{shared_dir(spark)}/{self.name}"
        self.add(spark.createDataFrame([], schema))

    def add(self, df: DataFrame) -> None:
        writer = df.write.mode("append").format("parquet")
        writer.save(self.path) if self.path else writer.saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self.path else self.spark.table(self.name)
