"""URL filters: ordered host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 256-bit blocks.  A URL's hash names one block and one
bit in each of its eight words, so a probe is a look-up of one row: an equality
join on the block number and a test of masks.  Up to ``broadcast_bytes`` the
blocks go to every task; a larger filter is joined by a shuffle of block
numbers.  Only possible hits go on to the exact hash join with the list, which
takes the false positives out again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.words import ascii_lower
from corpusloom.llm.workspace import cut

BLOCK_BITS = 256
#: Bytes that a block takes in a broadcast table, with its number and row.
BLOCK_ROW = 64


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class FilterSpec:
    bits_per_key: int = 12
    broadcast_bytes: int = 64 << 20


def _rest(url: Column) -> Column:
    """What follows the first ://; empty for null and for URLs without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m. and default port, path without index page, .html and trailing slash, sorted query without tracking; null without ://."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]*|ref|fbclid|gclid)(=|$)"))
    text = F.array_join(F.array_sort(kept), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit(""))))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (by host and path together, then by host), else null.

    A rule fits its host and all subdomains where the path starts with its own.
    rules is a hand-written list; it becomes one expression.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r.host)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _place(key: Column, blocks: int) -> list[Column]:
    """Block number and four 64-bit masks of a key: one bit in each 32-bit word."""
    h, bits = F.xxhash64(key), F.xxhash64(key, F.lit("bits"))
    at = [F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int") for i in range(8)]
    masks = []
    for i in range(0, 8, 2):
        low, high = F.expr("1L"), F.expr("1L")
        masks.append(F.call_function("shiftleft", low, at[i]).bitwiseOR(F.call_function("shiftleft", high, at[i + 1] + 32)))
    return [F.pmod(h, F.lit(blocks)).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(masks)]]


def bloom_blocks(keys: DataFrame, n: int, spec: FilterSpec = FilterSpec()) -> tuple[DataFrame, int]:
    """(block, b0..b3) of n distinct keys(key), and the number of blocks; empty blocks have no row."""
    blocks = max(1, math.ceil(n * spec.bits_per_key / BLOCK_BITS))
    placed = keys.select(*_place(F.col("key"), blocks))
    return placed.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"b{i}") for i in range(4)]), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], spec: FilterSpec = FilterSpec()) -> DataFrame:
    """(page_id, url, host, path, canonical, possible, listed, rule, verdict) for every row of pages(page_id, url, ...).

    listed(url) has the URLs to block, in any form; repeats, nulls and URLs
    without :// in it are ignored.  A rule's verdict stands; else a listed URL
    is blocked and any other allowed.  A null url, or one without ://, has empty
    host and path, fits no rule and is not listed.  Repeated rows all return;
    an empty list blocks nothing; other columns are ignored.
    """
    keys = listed.select(canonical(F.col("url")).alias("key")).filter("key is not null").distinct()
    n = keys.count()
    table, blocks = bloom_blocks(keys, n, spec)
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    placed = base.select("*", *_place(F.col("canonical"), blocks))
    if blocks * BLOCK_ROW <= spec.broadcast_bytes:
        table = F.broadcast(table)
    tested = F.lit(True)
    for i in range(4):
        tested = tested & (F.col(f"b{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    # kept, as possible hits and the rest go on apart: the pages are read and parsed once
    probed = cut(placed.join(table, "block", "left").select(*base.columns, F.coalesce(tested & F.col("canonical").isNotNull(), F.lit(False)).alias("possible")))
    held = keys.select(F.col("key"), F.lit(True).alias("hit"))
    hits = probed.filter("possible").join(held.hint("shuffle_hash"), F.col("canonical") == F.col("key"), "left").select(*probed.columns, F.coalesce("hit", F.lit(False)).alias("listed"))
    judged = hits.unionByName(probed.filter("not possible").withColumn("listed", F.lit(False)))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return judged.select("*", name.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
