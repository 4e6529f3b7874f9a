"""URL filters: host and path rules, then a weighted vocabulary.

A url without a rule is judged by the vocabulary: one pass of an Aho-Corasick
automaton over the lower-cased url finds all terms; a hit counts where the
characters beside it aren't ASCII letters or digits. Each term has a weight: strict
terms weigh as much as the limit, soft ones less, and a url is rejected where the
distinct terms found in it weigh LIMIT or more together: one strict term, or two soft
ones, however often each occurs.

The vocabulary is a parameter, a mapping of terms to weights, which ``read_terms`` takes
from a file; it is sent to the tasks with the function, which bounds it at what a task
can hold. One pass over the url column, no shuffle, no other column read.

Defined results: a null url, and one without ``://``, has an empty host and an
empty path, fits no rule and is allowed; an empty url likewise, unless terms are
found in it; repeated rows each give a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm._shared import ascii_lower

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
LIMIT = 2
_STRICT = """
porn porno pornstar xxx xxxvideos hentai milf bdsm camgirl camgirls escort escorts hardcore nsfw nude nudes striptease
casino casinos jackpot roulette sportsbook baccarat
spam malware phishing ransomware keylogger botnet spyware trojan
warez keygen keygens serialz nulled cracked
viagra cialis levitra tramadol xanax
"""
_SOFT = """
adult sexy hot naked dating singles hookup webcam erotic fetish lingerie
free win winner bonus bet bets betting poker slots lottery bingo odds wager
crack torrent torrents serial patch rip leaked unlock
pills cheap discount deal deals offer offers sale coupon pharmacy meds dose
ref aff affiliate click track redirect promo popup banner adserver
loan loans credit payday crypto bitcoin forex profit income rich
"""
TERMS = dict.fromkeys(_STRICT.split(), LIMIT) | dict.fromkeys(_SOFT.split(), 1)


def read_terms(spark: SparkSession, path: str) -> dict[str, int]:
    """A vocabulary from a file of lines with a term and its weight."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x")).filter("size(x) = 2")
    return {r["x"][0].lower(): int(r["x"][1]) for r in rows.toLocalIterator()}


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, else null."""
    found = None
    for verdict, at, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule = F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
    return found


def vocabulary_counter(weights: dict[str, int], limit: int = LIMIT):
    """A column function: url -> struct (n_strict, n_soft, weight) of the distinct terms found."""

    @F.pandas_udf("n_strict int, n_soft int, weight int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        terms = ahocorasick.Automaton()
        for word, weight in weights.items():
            terms.add_word(word.lower(), (weight, word.lower()))
        if weights:
            terms.make_automaton()

        def bounded(text: str, start: int, end: int) -> bool:
            beside = text[max(0, start - 1) : start] + text[end : end + 1]
            return not any(c.isascii() and c.isalnum() for c in beside)

        def judged(url: str | None) -> tuple[int, int, int]:
            text = (url or "").lower()
            hits = {hit for end, hit in terms.iter(text) if bounded(text, end + 1 - len(hit[1]), end + 1)} if weights else set()
            strict = sum(weight >= limit for weight, _ in hits)
            return strict, len(hits) - strict, sum(weight for weight, _ in hits)

        for urls in batches:
            yield pd.DataFrame([judged(x) for x in urls], columns=["n_strict", "n_soft", "weight"]).astype("int32")

    return count


def url_verdicts(pages: DataFrame, rules=RULES, terms: dict[str, int] = TERMS, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft for every row of pages."""
    read = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        vocabulary_counter(terms, limit)("url").alias("hits"),
    )
    fitting = read.withColumn("fitting", rule_of(F.col("host"), F.col("path"), rules))
    return fitting.select(
        "page_id",
        "host",
        "path",
        F.col("fitting.rule").alias("rule"),
        F.coalesce(F.col("fitting.verdict"), F.when(F.col("hits.weight") >= limit, "block").otherwise("allow")).alias("verdict"),
        F.col("hits.n_strict").alias("n_strict"),
        F.col("hits.n_soft").alias("n_soft"),
    )


def oracle() -> str:
    def found(words) -> str:
        tests = (rf"CAST(regexp_matches(low, '(^|[^a-z0-9]){w}($|[^a-z0-9])') AS INTEGER)" for w in words)
        return " + ".join(tests)

    cases = "\n".join(
        f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return rf"""
WITH parts AS (
  SELECT page_id, lower(coalesce(url, '')) AS low,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE
{cases}
    END AS fit, {found(_STRICT.split())} AS n_strict, {found(_SOFT.split())} AS n_soft
  FROM parts)
SELECT page_id, host, path, substr(fit, 7) AS rule,
  coalesce(left(fit, 5), CASE WHEN n_strict >= 1 OR n_soft >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n_strict AS INTEGER) AS n_strict, CAST(n_soft AS INTEGER) AS n_soft
FROM judged
"""
