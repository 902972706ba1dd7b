"""Exact dedup by content-defined chunk recipes, in DataFrame operations alone.

A text is normalised (every character of ``[\\x20\\x09-\\x0D]`` deleted) and cut where its own content
says so: a chunk ends at the first cut character after ``min_chunk`` characters, or at ``max_chunk``.
Distinct chunks get identifiers, and a text becomes its recipe: the ordered list of the identifiers.
Identifiers are verified over the whole corpus: the distinct chunks are counted per identifier, and
when two different chunks share one, every identifier is widened by one more independent hash word
until none do. Equal recipes then mean equal texts, and only recipes move from there on; the text of
a long document crosses the network once, as chunks that are deduplicated before the shuffle.

Defined cases: a null text counts as empty; empty and all-blank texts are equal to each other. A null
id sorts after every other id. Rows that repeat an id and a text share their verdict in ``exact_groups``; ``drop_copies`` leaves exactly one
row of a group. Ties in length go to the smallest id. Extra columns are ignored by ``exact_groups`` and kept by ``drop_copies``. An
empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialise, numbered

MIN_CHUNK, MAX_CHUNK = 256, 2048
#: Share of the rows from which a group is joined in parts, and their number.
HOT_SHARE, SALTS = 0.001, 32
#: Characters after which a chunk may end.
CUTS = r".,;:!?)|\]>。、！？"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunks_of(text: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """The chunks of a normalised text, in order; an empty text has none."""
    cut = f"(?s).{{{min_chunk - 1},{max_chunk - 1}}}?[{CUTS}]|(?s).{{1,{max_chunk}}}"
    return F.regexp_extract_all(text, F.lit(cut), 0)


def chunk_id(chunk: Column, words: int, bits: int = 64) -> list[Column]:
    """``words`` independent hashes of a chunk, each of ``bits`` bits."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(seed), chunk), 64 - bits) for seed in range(words)]


def verified_width(chunks: DataFrame, bits: int = 64, most: int = 16) -> int:
    """The least number of hash words by which no two different chunks of the corpus share an identifier."""
    distinct = chunks.select("chunk").distinct()
    for words in range(1, most + 1):
        ids = distinct.select(*(c.alias(f"w{i}") for i, c in enumerate(chunk_id(F.col("chunk"), words, bits))))
        if ids.groupBy(*ids.columns).count().filter("count > 1").isEmpty():
            return words
    raise ValueError(f"chunks still collide under {most} words of {bits} bits")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, bits: int = 64, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """One row per document: _id, _row (of ``row_col``, or 0), n_chars, text_sha256, recipe (verified chunk identifiers in order)."""
    row = F.col(row_col) if row_col else F.lit(0).cast("long")
    base = docs.select(F.col(id_col).alias("_id"), row.alias("_row"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"), normalised(F.col(text_col)).alias("norm"))
    cut = base.select("_id", "_row", "n_chars", "norm", chunks_of(F.col("norm"), min_chunk, max_chunk).alias("chunks"))
    words = verified_width(cut.select(F.explode("chunks").alias("chunk")), bits)
    recipe = F.flatten(F.transform("chunks", lambda c: F.array(*chunk_id(c, words, bits))))
    return cut.select("_id", "_row", "n_chars", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), recipe.alias("recipe"))


def _grouped(rows: DataFrame, hot_share: float, salts: int) -> DataFrame:
    """The rows of ``recipes`` with the best row of their group (n, z, i, r) and group_size.

    A recipe of more than ``hot_share`` of the rows is joined in ``salts`` parts. There are at most 1 / hot_share of them,
    so their hashes fit a list.
    """
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_row").alias("r")))
    # recipes are the keys, combined before the shuffle; texts stay where they are
    groups = materialise(rows.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size")), "recipe-groups")
    total = groups.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    hot = [r["h"] for r in groups.filter(F.col("group_size") > max(1.0, hot_share * total)).select(F.xxhash64("recipe").alias("h")).distinct().collect()]
    is_hot = F.xxhash64("recipe").isin(hot) if hot else F.lit(False)
    salted = groups.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    dealt = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("_id", "_row"), F.lit(salts)).cast("int")).otherwise(0))
    return dealt.join(salted, ["recipe", "salt"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = HOT_SHARE, salts: int = SALTS, **chunking) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, n_chars.

    The longest original text of a group stays, then the smallest id.
    """
    joined = _grouped(materialise(recipes(docs, id_col, text_col, **chunking), "recipes"), hot_share, salts)
    return joined.select(F.col("_id").alias(id_col), F.col("best.i").alias("keep_id"), "group_size", (F.col("_id").eqNullSafe(F.col("best.i")) & (F.col("n_chars") == -F.col("best.n"))).alias("kept"), "text_sha256", "n_chars")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = HOT_SHARE, salts: int = SALTS, **chunking) -> DataFrame:
    """One row of each group, with all its columns.

    The rows are written once under numbers of their own. Only recipes are compared, and only the numbers of the rows that leave come back to the
    documents: a written table, broadcast below spark.sql.autoBroadcastJoinThreshold; above it the documents are shuffled once.
    """
    row = f"_row_{uuid.uuid4().hex}"
    rows = numbered(docs, row)
    found = _grouped(materialise(recipes(rows, id_col, text_col, row, **chunking).drop("text_sha256"), "recipes"), hot_share, salts)
    gone = materialise(found.filter(F.col("_row") != F.col("best.r")).select(F.col("_row").alias(row)), "exact-copies")
    return rows.join(gone, row, "left_anti").drop(row)
