"""Fill-in-the-middle rewriting of texts, in DataFrame operations alone.

A text is cut into units, ``[A-Za-z]+|[^A-Za-z]`` from left to right over code points, so a word is never split. Two numbers from the SHA-256 of the
document's id say where its prefix and its middle end, two more which form it takes: ``plain`` leaves the text as it is, ``psm`` puts
prefix, suffix and middle behind their sentinels, ``spm`` suffix, prefix and middle. ``restored`` reads the text back from output and form.

A text that holds a sentinel stays plain. In any other, the first occurrence of each sentinel in an output is the one that was put there: a sentinel
begins with ``<``, which no sentinel holds at another place, so none arises across a seam.

Every row is rewritten by itself: no shuffle, and a task's memory follows its longest text.

Defined cases: a null text counts as empty; an empty text is plain and has no unit; a null id draws as the empty string; rows that repeat an id draw
alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are rewritten, and of these the percent in suffix-prefix-middle form.
RATE, SPM_RATE = 90, 20
SEED = "1"


def draws(id_: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 that depend on seed and id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> DataFrame:
    """One row per document: id, n (units), form, prefix, middle, suffix, output; prefix, middle and suffix are null in plain form."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), *(h.alias(f"_h{k}") for k, h in enumerate(draws(F.col(id_col), seed), 1)))
    cut = cut.withColumn("_units", F.regexp_extract_all("_text", F.lit(UNITS), 0)).withColumn("n", F.size("_units").cast("long"))
    a, b = (F.col(h) % (F.col("n") + 1) for h in ("_h1", "_h2"))
    marked = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | marked | (F.col("_h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_rate, "spm").otherwise("psm")
    placed = cut.select("_id", "_text", "_units", "n", form.alias("form"), F.least(a, b).cast("int").alias("_a"), F.greatest(a, b).cast("int").alias("_b"))

    def part(start: Column, size: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start, size), ""))

    n = F.col("n").cast("int")
    parts = placed.select("_id", "_text", "n", "form", part(F.lit(1), F.col("_a")).alias("prefix"), part(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("middle"), part(F.col("_b") + 1, n - F.col("_b")).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text"))
    return parts.select(F.col("_id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form, by parsing the sentinels."""

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring(output, F.lit(len(left) + 1), F.length(output)), right, 1)

    def after(mark: str) -> Column:
        return F.substring(output, F.locate(mark, output) + len(mark), F.length(output))

    first = F.when(form == "psm", between(PREFIX, SUFFIX)).otherwise(between(SUFFIX, PREFIX))
    second = F.when(form == "psm", F.substring_index(after(SUFFIX), MIDDLE, 1)).otherwise(F.substring_index(after(PREFIX), MIDDLE, 1))
    whole = F.when(form == "psm", F.concat(first, after(MIDDLE), second)).otherwise(F.concat(second, after(MIDDLE), first))
    return F.when(form == "plain", output).otherwise(whole)
