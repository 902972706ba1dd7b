"""Queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, exact_dedup, fill_in_middle, html_extract, langid, mixing, near_dedup, order_minhash, quality_crf, spelling, suffix_dedup, token_rollup, url_filter
from cairn.llm.common import materialise, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False))
    return langid.identify(docs, held).select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "lang", "n_chars", "text")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = url_filter.read_vocabulary(url_filter.vocabulary_table(spark))
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), vocabulary=vocabulary)


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False))
    return quality_crf.classify(docs, labels, ~held).select("doc_id", held.alias("held_out"), "score", "predicted", "n_lines")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup after documents arrived in an unknown language, were revised to their language, half of them withdrawn and put back, and the revisions were delivered twice."""
    counts = materialise(token_rollup.token_counts(_table(spark, sf_dir, "documents")), "token-counts")
    unknown = F.struct("source", F.lit(None).cast("string").alias("lang"), "tokenizer", "n_tokens", "n_bytes")
    revised = counts.withColumns({"op": F.lit("revise"), "old": unknown})
    withdrawn = counts.filter(_remainder("doc_id", 2) == 0)
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    rollup.commit("arrival", counts.withColumns({"op": F.lit("insert"), "lang": F.lit(None).cast("string")}))
    rollup.commit("languages", revised)
    rollup.commit("withdrawal", withdrawn.withColumn("op", F.lit("delete")))
    rollup.commit("languages", revised)
    rollup.commit("return", withdrawn.withColumn("op", F.lit("insert")))
    return rollup.totals()


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.word_counts(_table(spark, sf_dir, "documents"), edit_one_in=97))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.with_next(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the rewritten texts and of the texts rebuilt from them."""
    found = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_mix_sources, op4_minhash_dedup, op5_html_extract, op6_url_filter, op7_quality_crf, op8_exact_dedup, op9_token_counts, op10_decontaminate, op11_spelling_variants, op12_order_minhash, op13_fill_in_middle)}

ORACLE_SQL = {
    "op10_decontaminate": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM (
  SELECT item_id, w[i:i + least(len(w), 10) - 1] AS g FROM iw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
found AS (SELECT d.doc_id, d.i, d.n, w.item_id FROM (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)) d JOIN windows w ON w.n = d.n AND w.g = d.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits h ON h.doc_id = dw.doc_id LEFT JOIN items i ON i.doc_id = dw.doc_id
""",
    "op11_spelling_variants": r"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS k FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY doc_id, run),
keyed AS (SELECT run, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(ord(c) - 64 AS BIGINT)] END)) AS bytes FROM runs),
hashed AS (SELECT run, k, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM keyed, steps),
edited AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (
  SELECT a.word, b.word AS other FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word
  UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word),
near AS (SELECT p.word, count(*) AS n_near, max(o.n) AS best_n, arg_min(p.other, (-o.n, p.other)) AS best FROM pairs p JOIN v o ON o.word = p.other GROUP BY p.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN near ON near.word = v.word),
walk AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, walk.root FROM walk JOIN f ON f.form = walk.word)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word
""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""",
    "op3_mix_sources": f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY source),
rate AS (SELECT source, w * ((SELECT sum(n) FROM sizes) / (SELECT sum(w) FROM sizes)) / n AS r FROM sizes),
draw AS (SELECT source, greatest(1, CAST(ceil(r / {mixing.SPLIT}) AS BIGINT)) AS k, r / greatest(1, ceil(r / {mixing.SPLIT})) AS m FROM rate),
cdf(source, i, m, p, c) AS (
  SELECT source, 0, m, exp(-m), exp(-m) FROM draw
  UNION ALL SELECT source, i + 1, m, p * m / (i + 1), c + p * m / (i + 1) FROM cdf WHERE i < {mixing.TABLE}),
u AS (SELECT d.doc_id, d.source, t.j, CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || CAST(t.j AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM documents d JOIN draw ON d.source IS NOT DISTINCT FROM draw.source, LATERAL (SELECT unnest(range(1, draw.k + 1)) AS j) t),
counts AS (SELECT u.doc_id, sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND cdf.c <= u.u)) AS n FROM u GROUP BY u.doc_id)
SELECT d.doc_id, d.source, CAST(x.copy AS INTEGER) AS copy, d.lang, d.n_chars, d.text
FROM documents d JOIN counts c ON c.doc_id = d.doc_id, LATERAL (SELECT unnest(range(1, CAST(c.n AS BIGINT) + 1)) AS copy) x
""",
    "op8_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY len DESC, doc_id) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
""",
}
