"""URL filter by a blocked Bloom filter and an exact hash join (operator 6), DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from awardgrid.llm.common import Scratch

#: (rule, host, path, verdict); the longest rule that fits wins.
RULES = (
    ("net/", "net", "/", "block"),
    ("example.net/en/", "example.net", "/en/", "allow"),
    ("example.com/de/", "example.com", "/de/", "block"),
    ("org/fr/", "org", "/fr/", "allow"),
)
WORDS_PER_BLOCK = 4
FILTER_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., and path without ``.html`` and closing slashes; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(?:\.html)?/*$", "")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits and its verdict, both null without one."""
    rule = verdict = None
    for text, on, under, says in sorted(rules, key=lambda r: -len(r[0])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def _bits(url: Column, blocks: int) -> list[Column]:
    """The block, and one bit in each of its words."""
    h, g = F.xxhash64(url, F.lit(1)), F.xxhash64(url, F.lit(2))
    word = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(g, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [F.pmod(h, F.lit(blocks)).alias("block"), *[word(i).alias(f"bit{i}") for i in range(WORDS_PER_BLOCK)]]


def filter_urls(
    spark: SparkSession,
    pages: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    rules=RULES,
    urls_per_block: int = 16,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """(id, host, path, rule, verdict, listed, maybe_listed) of every page; blocked if a rule or the list says so.

    A blocked Bloom filter is a table of blocks of four 64-bit words; a listed canonical URL sets
    one bit in each word of one block, so a probe touches one row. A page whose four bits are all
    set may be listed (``maybe_listed``): only such pages ask the exact hash join with the list by
    their URL, which removes the false positives. Pages are read once. The filter's size follows
    from the length of the list and is checked: up to ``filter_bytes`` it is broadcast, beyond that
    it is joined by block in a shuffle; so is the list, at 200 bytes a URL. Pages with equal URLs need
    no care: the list is distinct, so the join adds no rows, and Spark may split its large partitions.

    Null url, or one without ``://``: empty host and path, no rule, ``allow``. Repeated rows are
    kept; very long URLs are read whole. Empty tables work on both sides. Only the named columns are
    read, whatever the others are called.
    """
    scratch = Scratch(spark, "urls")
    host, path = url_host(F.col(listed_col)), url_path(F.col(listed_col))
    keys = scratch.keep(listed.select(canonical(host, path).alias("key")).where("key is not null").distinct(), "keys")
    n = keys.count()
    blocks = max(1, math.ceil(n / urls_per_block))
    words = [f"w{i}" for i in range(WORDS_PER_BLOCK)]
    bloom = keys.select(*_bits(F.col("key"), blocks)).groupBy("block").agg(*[F.bit_or(f"bit{i}").alias(w) for i, w in enumerate(words)])
    if blocks * (8 + 8 * WORDS_PER_BLOCK) <= filter_bytes:
        bloom = F.broadcast(bloom)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    probed = (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"))
        .select("id", url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path"))
        .withColumn("key", canonical(F.col("host"), F.col("path")))
        .select("id", "host", "path", "key", rule.alias("rule"), says.alias("says"), *_bits(F.col("key"), blocks))
        .join(bloom, "block", "left")
    )
    hit = F.col("key").isNotNull()
    for i, w in enumerate(words):
        hit = hit & (F.col(w).bitwiseAND(F.col(f"bit{i}")) != 0)
    # what the filter rules out looks for a key that no list has, another one for each page, so it
    # neither finds anything nor gathers in one partition
    asked = F.when(F.coalesce(hit, F.lit(False)), F.col("key")).otherwise(F.concat(F.lit("\n"), F.hash("id", "host", "path").cast("string")))
    known = keys.select(F.col("key").alias("asked"), F.lit(True).alias("found"))
    if n * 200 <= filter_bytes:
        known = F.broadcast(known)
    found = probed.withColumn("asked", asked).join(known, "asked", "left")
    listed_in = F.coalesce("found", F.lit(False))
    verdict = F.coalesce("says", F.when(listed_in, "block").otherwise("allow"))
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), listed_in.alias("listed"), F.coalesce(hit, F.lit(False)).alias("maybe_listed"))
