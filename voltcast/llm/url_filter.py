"""URL filter: host rules, then a blocked Bloom filter in front of an exact join. DataFrame functions only.

Listed URLs and judged URLs are brought to one canonical form. The filter has
512-bit blocks of eight words; a key sets one bit in each word of its block, so
a block is built by bitwise-or aggregates and probed with eight bit tests. It
is one row per block, at most ``MAX_BLOCKS`` rows, and so is broadcast whatever
the size of the list (a longer list lets more false hits through, which the
exact join removes). Only possible hits are shuffled to the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 18
KEYS_PER_BLOCK = 32
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content ref fbclid gclid".split()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m. and default port, path without index page, .html and trailing slashes, sorted parameters without tracking; null without ://."""
    bare = F.regexp_replace(F.regexp_replace(host(url), "^(www|m)\\.", ""), ":(80|443)$", "")
    page = F.regexp_replace(F.regexp_replace(path(url), "(/index)?\\.html?$", ""), "/+$", "")
    params = F.filter(F.split(F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")), "&"),
                      lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(bare, page, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(rules: list[tuple[str, str, str]], h: Column, p: Column) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest of (verdict, host, path prefix) rules that fits the host or a domain above it; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        name, verdict = F.when(fits, rh + rp).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _key_columns(url: str, n_blocks: int) -> list[Column]:
    """Block of a key and its bit in each of the block's words."""
    bits = [F.expr(f"shiftleft(1L, cast(shiftright(xxhash64({url}, 1), {6 * w}) & 63 as int))").alias(f"b{w}") for w in range(8)]
    return [F.pmod(F.xxhash64(url), F.lit(n_blocks)).alias("block"), *bits]


def bloom(listed: DataFrame, url: str) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of the distinct values of a column: (one row per used block, number of blocks)."""
    n_blocks = min(MAX_BLOCKS, max(1, -(-listed.count() // KEYS_PER_BLOCK)))
    keyed = listed.select(*_key_columns(url, n_blocks))
    return keyed.groupBy("block").agg(*[F.bit_or(f"b{w}").alias(f"w{w}") for w in range(8)]), n_blocks


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", listed_url: str = "url") -> DataFrame:
    """Per row: key, host, path, rule, verdict and the canonical URL.

    A rule's verdict stands; without one, a URL whose canonical form is listed
    is blocked and any other allowed. Defined cases: null URLs and URLs without
    :// have empty host and path, no canonical form, and are allowed; null
    entries of the list are ignored and repeated ones count once; rows are
    judged one by one; other columns are ignored; an empty list blocks nothing.
    """
    u = F.col("url")
    name, verdict = rule_of(rules, F.col("host"), F.col("path"))
    rows = (pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
            .select("key", host(u).alias("host"), path(u).alias("path"), canonical(u).alias("canonical"))
            .withColumn("rule", name).withColumn("verdict", verdict))
    names = listed.select(canonical(F.col(listed_url).cast("string")).alias("entry")).where("entry is not null").distinct()
    table, n_blocks = bloom(names, "entry")
    open_rows = rows.where("verdict is null and canonical is not null")
    probed = open_rows.select("*", *_key_columns("canonical", n_blocks)).join(F.broadcast(table), "block", "left")
    hit = F.lit(True)
    for w in range(8):
        hit = hit & (F.coalesce(F.col(f"w{w}"), F.lit(0)).bitwiseAND(F.col(f"b{w}")) != 0)
    probed = probed.select(*rows.columns, hit.alias("maybe"))
    sure = rows.where("verdict is not null or canonical is null").unionByName(probed.where("not maybe").drop("maybe"))
    exact = (probed.where("maybe").drop("maybe", "verdict").join(names.withColumn("verdict", F.lit("block")), F.col("canonical") == F.col("entry"), "left")
             .drop("entry"))
    return (sure.unionByName(exact).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
            .select(F.col("key").alias(key), "host", "path", "rule", "verdict", "canonical"))
