"""URL filter: weighted vocabulary of strict and soft terms found by one Aho-Corasick automaton, and rules.

Terms are looked for in the url as it stands and, where it holds percent escapes, in the url with the escapes decoded (twice at most). A hit counts only when no ASCII
letter or digit touches it on either side. A url is rejected by one strict hit, or by at least ``soft_limit`` distinct
soft terms whose weights, 1 to 3 each, reach ``weight_limit`` together (by default 3: two terms of weight 1 are no reason yet). Allow and block rules for a host (with its subdomains) and a
path prefix come before the vocabulary, and the longest fitting rule wins.

The vocabulary is a table (term, kind, weight, category, version) of which ``read_vocabulary`` reads one version; ``vocabulary_table`` is the default, made of the stems
of seven categories by rule: plurals, and for strict terms spellings in which digits stand for letters. Rows without a term, or of another kind than strict and soft, are skipped; a null weight counts as 0.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged
by whatever terms it holds (null: allowed); escapes that are no UTF-8 decode to the replacement character. Repeated rows are judged alike. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default vocabulary: stems by category, kind and weight. ``vocabulary`` makes the terms of them.
STEMS = {
    ("adult", "strict", 0): "bdsm camgirl camsex creampie cumshot escort fetish gangbang hardcoreporn hentai jailbait lolita milf nude porn porno pornhub pornography sexcam sexchat sexshop stripclub swingers upskirt webcamsex xnxx xvideos xxx",
    ("adult", "soft", 3): "adult camshow erotic erotica nsfw sex sexy",
    ("adult", "soft", 2): "dating hookup singles",
    ("adult", "soft", 1): "hot x",
    ("gambling", "strict", 0): "blackjack casino jackpot onlinecasino roulette slotmachine",
    ("gambling", "soft", 3): "baccarat betting gambling lottery poker slots sportsbook sweepstake",
    ("gambling", "soft", 2): "bet lotto prize",
    ("gambling", "soft", 1): "win winner",
    ("pharmacy", "strict", 0): "cialis pills viagra xanax",
    ("fraud", "strict", 0): "deepfake fakepassport fullz malware phishing ransomware spam",
    ("fraud", "soft", 3): "replica upvote",
    ("fraud", "soft", 2): "bitcoindoubler getrich giveaway loan makemoney payday workfromhome",
    ("piracy", "strict", 0): "cracksoftware keygen warez",
    ("piracy", "soft", 3): "torrent",
    ("piracy", "soft", 2): "crack cracked",
    ("marketing", "soft", 2): "cheap coupon forex megadeal promo",
    ("marketing", "soft", 1): "bonus buy click deal discount earn exclusive farm free limited offer sale trial unlock",
    ("adverts", "soft", 2): "ad adclick affiliate clickbait popunder",
    ("adverts", "soft", 1): "popup redirect track tracker traffic",
}
#: Digits that stand for letters in disguised spellings.
DISGUISES = (("a", "4"), ("e", "3"), ("i", "1"), ("o", "0"))
VOCABULARY_VERSION = 3


def _forms(stem: str, strict: bool) -> Iterator[str]:
    """The stem, its plural and, for a strict one of five letters or more, both with one letter, or all letters, written as digits."""
    plain = [stem] if stem[-1] in "sxyz" or len(stem) < 2 else [stem, stem + "s"]
    for word in plain:
        yield word
        if strict and len(stem) >= 5:
            for letters in (*(d for d, _ in DISGUISES), "".join(d for d, _ in DISGUISES)):
                yield word.translate({ord(d): digit for d, digit in DISGUISES if d in letters})


def vocabulary() -> list[tuple[str, str, int, str, int]]:
    """(term, kind, weight, category, version) of all forms of the stems, each once."""
    out = {}
    for (category, kind, weight), stems in STEMS.items():
        for stem in stems.split():
            for term in _forms(stem, kind == "strict"):
                out.setdefault(term, (term, kind, weight, category, VOCABULARY_VERSION))
    return list(out.values())


def vocabulary_table(spark: SparkSession) -> DataFrame:
    """The default vocabulary as a table."""
    return spark.createDataFrame(vocabulary(), "term string, kind string, weight int, category string, version int")


VOCABULARY = tuple((term, kind, weight, version) for term, kind, weight, _, version in vocabulary())
# The rules (verdict, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SOFT_LIMIT = 2
#: Two soft terms of the least weight don't reach it; three do, and so does one of them with a heavier one.
WEIGHT_LIMIT = 3

_automata: dict[tuple, object] = {}


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits; null where none does."""
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def read_vocabulary(table: DataFrame, version: int | None = None) -> tuple:
    """The rows (term, kind, weight, version) of one version of a vocabulary table, the latest by default. A vocabulary is a list of terms, so it fits the driver."""
    rows = table.select(F.lower("term").alias("term"), "kind", F.coalesce(F.col("weight").cast("int"), F.lit(0)).alias("weight"), F.col("version").cast("int").alias("version")).filter("term <> '' AND kind IN ('strict', 'soft')")
    rows = rows.filter(F.col("version") == (F.lit(version) if version is not None else table.agg(F.max("version")).scalar()))
    return tuple(tuple(r) for r in rows.distinct().orderBy("term", "kind").collect())


def _automaton(vocabulary: tuple):
    import ahocorasick

    if vocabulary not in _automata:
        a = ahocorasick.Automaton()
        for term, kind, weight, _ in sorted(vocabulary, key=lambda v: v[1] == "strict"):  # a term of both kinds is strict
            a.add_word(term.lower(), (kind, term.lower(), weight))
        a.make_automaton()
        _automata[vocabulary] = a
    return _automata[vocabulary]


def _decoded(url: str) -> Iterator[str]:
    """The url in lower case, and again for each of up to two levels of escapes."""
    yield url.lower()
    for _ in range(2):
        plain = unquote(url)
        if plain == url:
            return
        url = plain
        yield url.lower()


def term_hits(url: str | None, vocabulary: tuple = VOCABULARY) -> tuple[int, dict[str, int], list[str]]:
    """(strict hits in the reading of the url that has most, weights of the distinct soft terms of all readings, terms found, sorted)."""
    strict, soft, terms = 0, {}, set()
    edge = lambda c: not (c.isascii() and c.isalnum())
    for text in _decoded(url or ""):
        n = 0
        for end, (kind, term, weight) in _automaton(vocabulary).iter(text):
            start = end - len(term) + 1
            if (start == 0 or edge(text[start - 1])) and (end + 1 == len(text) or edge(text[end + 1])):
                terms.add(term)
                if kind == "strict":
                    n += 1
                else:
                    soft[term] = weight
        strict = max(strict, n)
    return strict, soft, sorted(terms)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", vocabulary: tuple = VOCABULARY, rules=RULES, soft_limit: int = SOFT_LIMIT, weight_limit: int = WEIGHT_LIMIT) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, n_strict, n_soft (distinct), weight (of the soft terms), terms."""
    vocabulary = tuple(tuple(v) for v in vocabulary)
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [term_hits(u, vocabulary) for u in b.column(1).to_pylist()]
            numbers = [pa.array(x, pa.int32()) for x in ([h for h, _, _ in hits], [len(s) for _, s, _ in hits], [sum(s.values()) for _, s, _ in hits])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *numbers, pa.array([t for _, _, t in hits], pa.list_(pa.string()))], ["_id", "_url", "n_strict", "n_soft", "weight", "terms"])

    counted = base.mapInArrow(count, f"_id {base.schema['_id'].dataType.simpleString()}, _url string, n_strict int, n_soft int, weight int, terms array<string>")
    placed = counted.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= soft_limit) & (F.col("weight") >= weight_limit), "block").otherwise("allow")
    return placed.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_strict", "n_soft", "weight", "terms")
