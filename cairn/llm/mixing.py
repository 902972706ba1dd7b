"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone.

A document of source s is wanted ``rate(s) = weight(s) / sum of weights * rows / rows(s)`` times. Its
count is a Poisson draw of that mean, made by inverting the distribution at a uniform number that is a
hash of seed and document id: the same document gets the same count in any run, order or partitioning.
Each document is exploded by its count, and the copies are dealt out by another hash and sorted by it
within partitions, which is a uniform global shuffle without range sampling.

A mean above ``SPLIT`` is drawn as a sum of independent draws of smaller means, so that exp() never
underflows and the table of cumulative probabilities stays short.

Defined cases: a null source is a source of its own; a source absent from ``weights`` has weight 0 and
leaves; weights that sum to 0 give no rows; a null id hashes as the empty string; repeated rows get
the same count each; an empty table gives an empty result; extra columns pass through. The added columns are ``copy`` (from 1) and
``mix_rate``; input columns of these names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialise

SPLIT = 16.0
#: Entries of a table of cumulative probabilities; beyond them less than 2**-53 is left at a mean of SPLIT.
TABLE = 96


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, alpha: float) -> DataFrame:
    """_source, n_draws, mix_rate, cdf; ``weights`` by source, else the number of rows to the power ``alpha``."""
    sizes = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_s string, w double")
        sizes = sizes.join(F.broadcast(table), sizes["_source"].eqNullSafe(table["_s"]), "left").withColumn("w", F.coalesce("w", F.lit(0.0))).drop("_s")
    sizes = materialise(sizes, "source-sizes")
    total = sizes.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    scale = float(total["n"]) / total["w"] if total["w"] else 0.0
    rate = sizes.select("_source", (F.col("w") * F.lit(scale) / F.col("n")).alias("mix_rate")).filter("mix_rate > 0")
    rate = rate.withColumn("n_draws", F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / SPLIT)).cast("int")).withColumn("m", F.col("mix_rate") / F.col("n_draws"))
    first = F.struct(F.exp(-F.col("m")).alias("p"), F.array(F.exp(-F.col("m"))).alias("cdf"))
    step = lambda acc, k: F.struct((acc["p"] * F.col("m") / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("m") / k)).alias("cdf"))
    return rate.select("_source", "mix_rate", "n_draws", F.aggregate(F.sequence(F.lit(1), F.lit(TABLE)), first, step)["cdf"].alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, seed: int = 42, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mixture: the columns of ``docs``, mix_rate and copy, globally shuffled."""
    docs = docs.drop("copy", "mix_rate")
    # a written table has a known size: Spark broadcasts it below spark.sql.autoBroadcastJoinThreshold and joins by shuffle above
    table = materialise(rates(docs, source_col, weights, alpha), "mix-rates")
    joined = docs.join(table, docs[source_col].eqNullSafe(table["_source"]))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = lambda i: uniform(F.lit(str(seed)), key, i.cast("string"))
    numbers = F.transform(F.sequence(F.lit(1), F.col("n_draws")), u)  # drawn before the table is searched, so once each
    draws = F.transform(numbers, lambda x: F.size(F.filter("cdf", lambda c: c <= x)))
    counted = joined.withColumn("_count", F.aggregate(draws, F.lit(0), lambda a, b: a + b)).filter("_count > 0").drop("_source", "n_draws", "cdf")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count")))).drop("_count")
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col("copy"))
    return copies.withColumn("_place", place).repartition("_place").sortWithinPartitions("_place").drop("_place")
