"""Corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination and source mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontaminate, exact_dedup, langid, mixing, near_dedup
from cairn.operators.scratch import materialise


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a learned language, each judged by its own text; those without one (``und``) go.

    A null text, one without a letter, or every text where no language could be learned, is ``und``. Repeated rows are judged alike,
    equal code lengths go to the first language by name, and a null label or id does not matter. An empty table gives an empty table.
    """
    return langid.known_rows(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest before normalisation, then the smallest id, a null id last.

    Null, empty and blank texts are equal; of rows that repeat id and text one stays. An empty table gives an empty table.
    """
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, a null id last, then by the digest of the text.

    Texts without a word are near nothing and stay; of rows that repeat id and text one stays. An empty table gives an empty table.
    """
    return near_dedup.drop_near_copies(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item, each judged by its own text.

    Null and empty texts stay; items without words hit nothing; repeated rows are judged alike. An empty table gives an empty table.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources replicated to their target weights, globally shuffled, with copy and mix_rate.

    A null source is a source; a null id draws as the empty string; repeated rows get the same count each; input columns named
    copy and mix_rate are replaced. An empty table gives an empty table.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mix_stage),
]

#: Language ID and near-dedup are not SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
