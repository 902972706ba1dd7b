"""Token counts by source, language and tokenizer version, maintained by signed deltas.

A batch of changes (insert, delete, revise) becomes additive deltas: an insert adds a document's tokens,
a delete takes them away, a revision takes the old count away and adds the new one, where source or
language may change too. A batch is aggregated on the executors and written to a folder of its own; then one row in
the commit log names batch and folder. Only folders in the log count, one a batch id, so a commit that died half-way
changes nothing and is simply run again, and a repeated commit is left alone.

Every ``merge_after`` commits the totals and the ids of all batches so far are written as a snapshot, and a new log begins. Totals are the snapshot plus the folders of
the last two logs that it does not cover, so they read a bounded number of folders after any number of commits; a commit that was on its way while a snapshot was made is
found in the log before. Of two snapshots made at once one counts, and what only the other covered is still in the logs.

Texts are tokenized by a public byte-level BPE whose rank file is a parameter; the driver reads the ranks (under 1 MB) and broadcasts them.

Defined cases: a null text has 0 tokens and still counts as a document; null source or language is a group of its
own; repeated rows count each; an empty batch commits as empty; without a commit the totals are empty; groups whose counts come to 0 stay
visible only if some total is not 0; a change of another kind than the three, or a revision without its old row, raises an error
when the batch is written, and nothing is committed; extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenization pattern of the public byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"
LOG = "batch string, folder string"
SNAPSHOTS = "generation int, folder string"
MERGE_AFTER = 32

_encoders: dict[str, object] = {}


def token_counts(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, tokenizer_file: str = TOKENIZER_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, n_bytes of every whole text."""
    spark = docs.sparkSession
    with open(f"{tokenizer_dir}/{tokenizer_file}", "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    key = uuid.uuid4().hex
    base = docs.select(F.col(id_col).alias("_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        if key not in _encoders:
            _encoders.clear()
            table = {base64.b64decode(a): int(n) for a, n in (line.split() for line in ranks.value.splitlines() if line)}
            _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        encode = _encoders[key].encode_ordinary
        for b in batches:
            texts = b.column(3)
            n = np.fromiter((len(encode(t.as_py())) if t.is_valid else 0 for t in texts), np.int64, len(texts))
            size = np.fromiter((t.as_buffer().size if t.is_valid else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n), pa.array(size)], ["_id", "source", "lang", "n_tokens", "n_bytes"])

    kind = base.schema["_id"].dataType.simpleString()
    out = base.mapInArrow(count, f"_id {kind}, source string, lang string, n_tokens long, n_bytes long")
    return out.select(F.col("_id").alias("doc_id"), "source", "lang", F.lit(tokenizer_file).alias("tokenizer"), "n_tokens", "n_bytes")


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Additive deltas by key of changes: op (insert, delete, revise), the keys, n_tokens, n_bytes, and for a revision old: struct<source, lang, tokenizer, n_tokens, n_bytes>."""
    row = lambda sign, at: F.struct(*(F.col(at + k).alias(k) for k in KEYS), F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.col(at + "n_tokens")).alias("tokens"), (F.lit(sign) * F.col(at + "n_bytes")).alias("bytes"))
    signed = F.when(F.col("op") == "insert", F.array(row(1, ""))).when(F.col("op") == "delete", F.array(row(-1, "")))
    if "old" in changes.columns:
        signed = signed.when((F.col("op") == "revise") & F.col("old").isNotNull(), F.array(row(1, ""), row(-1, "old.")))
    known = signed.otherwise(F.raise_error(F.concat(F.lit("a change without a delta: "), F.coalesce("op", F.lit("null")))))
    flat = changes.select(F.explode(known).alias("d")).select("d.*")
    return flat.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))


class TokenRollup:
    """The rollup kept under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, merge_after: int = MERGE_AFTER):
        self.spark, self.root, self.merge_after = spark, root.rstrip("/"), merge_after
        self._append("snapshots", [], SNAPSHOTS)
        self._append("log-0", [], LOG)

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        """One task writes one file, which appears whole or not at all."""
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def _latest(self) -> tuple[int, str | None]:
        """(generation, folder) of the snapshot that counts; generation 0 has none."""
        found = self.spark.read.schema(SNAPSHOTS).parquet(f"{self.root}/snapshots").agg(F.max(F.struct("generation", "folder")).alias("s")).first()["s"]
        return (found["generation"], found["folder"]) if found else (0, None)

    def _read(self, schema: str, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def _covered(self, folder: str | None) -> DataFrame:
        return self._read("batch string", *([f"{folder}/ids"] if folder else []))

    def _open(self, generation: int, folder: str | None) -> DataFrame:
        """(batch, folder) of the commits that the snapshot does not cover. Where two commits of one id ran at once, the least folder counts."""
        logs = self._read(LOG, *(f"log-{g}" for g in range(max(0, generation - 1), generation + 1)))
        return logs.join(self._covered(folder), "batch", "left_anti").groupBy("batch").agg(F.min("folder").alias("folder"))

    def _rows(self, generation: int, folder: str | None) -> tuple[DataFrame, list[str]]:
        """The additive rows whose sums are the totals, and the batches among them that no snapshot covers, some ``merge_after``."""
        left = {r["batch"]: r["folder"] for r in self._open(generation, folder).collect()}
        return self._read(DELTAS, *([f"{folder}/totals"] if folder else []), *sorted(left.values())), sorted(left)

    def batches(self) -> dict[str, str]:
        """Folder by batch id of the commits that no snapshot covers."""
        return {r["batch"]: r["folder"] for r in self._open(*self._latest()).collect()}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before."""
        generation, snapshot = self._latest()
        left = self._open(generation, snapshot)
        if not left.filter(F.col("batch") == batch_id).isEmpty() or not self._covered(snapshot).filter(F.col("batch") == batch_id).isEmpty():
            return False
        folder = f"deltas-{uuid.uuid4().hex}"
        signed_deltas(changes).write.parquet(f"{self.root}/{folder}")
        self._append(f"log-{generation}", [(batch_id, folder)], LOG)
        if left.count() >= self.merge_after:
            self.merge()
        return True

    def merge(self) -> None:
        """Writes a snapshot of all commits and begins a new log."""
        generation, old = self._latest()
        rows, left = self._rows(generation, old)
        folder = f"snapshot-{uuid.uuid4().hex}"
        rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("docs", "tokens", "bytes"))).write.parquet(f"{self.root}/{folder}/totals")
        self._covered(old).unionByName(self.spark.createDataFrame([(b,) for b in left], "batch string")).write.parquet(f"{self.root}/{folder}/ids")
        self._append(f"log-{generation + 1}", [], LOG)
        self._append("snapshots", [(generation + 1, folder)], SNAPSHOTS)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_bytes over all committed batches."""
        rows, _ = self._rows(*self._latest())
        out = rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"), F.sum("bytes").alias("n_bytes"))
        return out.filter("n_docs != 0 OR n_tokens != 0 OR n_bytes != 0")
