"""URL verdicts: rules by host and path, and a list of canonical URLs.

The list may be far larger than memory.  A blocked Bloom filter of it (512 bits a
block, one bit in each of eight words, so one look-up touches one block) is an
aggregate of the list; urls that miss it are settled at once, the few possible
hits meet the exact list in a hash join that removes the false positives.  Rules
are a small configuration and become expressions on the row.

Defined cases: a url that is null or has no ``://`` has an empty host and path,
fits no rule and is on no list; null, repeated and unparsable list entries are
ignored; repeated or null page ids are separate rows; further columns are carried
unless the operator makes a column of that name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import small_or_merge
from metricloom.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
#: Query parameters that do not change the page.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
WORDS, BITS = 8, 64
MADE = ("host", "path", "rule", "listed", "verdict")
Rule = tuple[str, str, str]


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, group), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def canonical(url: Column) -> Column:
    """Host and path without a closing slash, then the other parameters in order;
    null for a url without a host."""
    kept = F.filter(F.split(F.substr(_part(url, 3), F.lit(2)), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    base = F.concat(host(url), F.rtrim(path(url), F.lit("/")))
    return F.when(host(url) != "", F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _rule(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits the columns host and path."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):  # later ones win
        fits = ((F.col("host") == domain) | F.col("host").endswith(f".{domain}")) & F.col("path").startswith(prefix)
        rule, action = F.when(fits, domain + prefix).otherwise(rule), F.when(fits, verdict).otherwise(action)
    return rule, action


def _hashes(key: str, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and the bit of each of its words."""
    second = F.xxhash64(key, F.lit(1))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(BITS - 1)).cast("int") for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the column ``url_key``: bits combined before the shuffle."""
    block, bits = _hashes("url_key", blocks)
    words = [F.bit_or(F.expr("shiftleft(1L, b%d)" % i)).alias(f"w{i}") for i in range(WORDS)]
    return listed.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)]).groupBy("block").agg(*words)


def possible_hits(urls: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """``urls`` with ``maybe``: false means surely not listed."""
    block, bits = _hashes("url_key", blocks)
    probed = urls.withColumns({"_block": block} | {f"_b{i}": b for i, b in enumerate(bits)})
    joined = probed.join(filter_blocks, F.col("_block") == F.col("block"), "left")
    every = reduce(lambda a, b: a & b, [F.expr(f"shiftrightunsigned(w{i}, _b{i}) & 1L") == 1 for i in range(WORDS)])
    made = ["block", "_block", *[f"_b{i}" for i in range(WORDS)], *[f"w{i}" for i in range(WORDS)]]
    return joined.withColumn("maybe", F.coalesce(every, F.lit(False))).drop(*made)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], bits_per_url: int = 16) -> DataFrame:
    """``pages`` (url, ...) with host, path, rule, listed and verdict.

    ``listed`` has a column ``url``.  The verdict is the rule's, else ``block`` for
    a listed url and ``allow`` for any other.
    """
    keys = cut_lineage(listed.select(canonical(F.col("url")).alias("url_key")).filter("url_key is not null").distinct())
    count = keys.count()
    blocks = max(1, -(-count * bits_per_url // (WORDS * BITS)))
    table = small_or_merge(bloom_blocks(keys, blocks), blocks, 9 * WORDS)
    carried = [c for c in pages.columns if c not in MADE]
    # the caller's columns travel in one, so no name of theirs meets one made here
    parsed = pages.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("url_key"))
    rule, action = _rule(rules)
    probed = possible_hits(parsed, table, blocks)
    misses = probed.filter(~F.col("maybe")).withColumn("listed", F.lit(False))
    exact = small_or_merge(keys.withColumn("_on_list", F.lit(True)), count, 100, 8 << 20)
    hits = probed.filter("maybe").join(exact, "url_key", "left").withColumn("listed", F.coalesce("_on_list", F.lit(False)))
    judged = misses.select("row", "host", "path", "listed").unionByName(hits.select("row", "host", "path", "listed"))
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(*[F.col(f"row.`{c}`") for c in carried], "host", "path", rule.alias("rule"), "listed", verdict.alias("verdict"))
