"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join, in DataFrame functions.

A listed entry is a host with a path prefix.  A URL's canonical candidates are its host's suffixes at label
boundaries, each with the URL path cut to the entries' path lengths.  The filter holds one 64-bit word per
block; a candidate passes if its block has all its bits.  What passes meets the entries in an equality join,
which removes false positives; the longest entry wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._spark import hot_keys, salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str


#: Rules of the query; they come before the list.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Canonical URLs that the method itself blocks, as (host, path prefix).
LISTED = (("spam-farm.example.org", "/"), ("cheap-pills.example.org", "/"), ("malware.example.org", "/"))

BITS_PER_KEY, BITS_SET = 16, 4
#: Filters of up to so many blocks (16 bytes each) and lists of up to so many entries are broadcast; larger ones
#: are joined by shuffle.
MAX_BROADCAST_BLOCKS, MAX_BROADCAST_ENTRIES = 1 << 16, 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no `://`."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def _blocks(n_entries: int) -> int:
    """A power of two that gives each entry about BITS_PER_KEY bits."""
    need = max(1, n_entries * BITS_PER_KEY // 64)
    return 1 << max(0, (need - 1).bit_length())


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(n))


def _mask(key: Column) -> Column:
    """BITS_SET bits of a word, from disjoint parts of a second hash."""
    h = F.xxhash64(F.lit(2), key)
    bits = []
    for k in range(BITS_SET):
        bits.append(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def entries_table(spark: SparkSession, rules: Sequence[Rule], listed: Sequence[tuple[str, str]]) -> DataFrame:
    """host, path, verdict, is_rule of rules and listed URLs; made of literals, so that no Python worker reads it."""
    rows = [(r.host, r.path, r.verdict, 1) for r in rules] + [(h, p, "block", 0) for h, p in listed]
    names = ("host", "path", "verdict", "is_rule")
    items = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*items)))


def filter_urls(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    ``entries`` has host, path, verdict and is_rule: 1 for rules, which come first and give ``rule`` (host and path
    as one string), 0 for listed URLs, which only decide where no rule fits.  An entry fits its host and all
    subdomains if the URL's path starts with its path.  The longest entry wins, then the smaller string; no entry:
    verdict allow, rule null, listed null.

    A null URL or one without `://` has empty host and path and fits nothing.  Null ids stay null, repeated rows
    are repeated, an empty table gives no rows and an empty list allows everything.  Null or empty entry hosts or
    paths are dropped; of equal entries the one with the smallest verdict stays.  Other columns are not read.
    """
    key = F.concat_ws("\x01", "host", "path")
    exact = entries.filter("host <> '' AND path <> ''").groupBy("host", "path", "is_rule").agg(F.min("verdict").alias("verdict"))
    exact = exact.select(key.alias("key"), "host", "path", "verdict", "is_rule")
    sizes = exact.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lens")).first()
    n, lengths = sizes["n"], sorted(sizes["lens"])
    n_blocks = _blocks(n)
    bloom = exact.groupBy(_block(F.col("key"), n_blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("word"))

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    # A verdict depends on host and path alone: each pair is judged once and joined back.
    pairs = rows.groupBy("host", "path").agg(F.count("*").alias("pages"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths])) if lengths else F.array().cast("array<string>")
    cand = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\x01"), p))))
    tried = pairs.filter("host <> ''").select("host", "path", F.explode(F.array_distinct(cand)).alias("key"))
    order = F.struct("is_rule", (F.length("r_host") + F.length("r_path")).alias("len"), "r_host", "r_path", "verdict")
    listed = exact.withColumnsRenamed({"host": "r_host", "path": "r_path"}).groupBy("key").agg(F.max(order).alias("best"))
    small = n_blocks <= MAX_BROADCAST_BLOCKS and n <= MAX_BROADCAST_ENTRIES
    # Large lists: each distinct candidate is held against filter and list once, whatever the number of its pages.
    asked = tried if small else tried.groupBy("key").agg(F.count("*").alias("times"))
    possible = asked.withColumns({"block": _block(F.col("key"), n_blocks), "mask": _mask(F.col("key"))}).join(F.broadcast(bloom) if small else bloom, "block")
    possible = possible.filter(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).drop("block", "mask", "word")
    hits = possible.join(F.broadcast(listed) if small else listed, "key")
    if not small:
        hits = salted_join(tried, hits.drop("times"), ["key"], hot_keys(hits, ["key"], "times"), ["host", "path"])
    best = hits.groupBy("host", "path").agg(F.max("best").alias("best"))
    out = salted_join(rows, best, ["host", "path"], hot_keys(pairs, ["host", "path"], "pages"), ["page_id"], "left")
    name = F.concat("best.r_host", "best.r_path")
    return out.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.is_rule") == 1, name).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("best.is_rule") == 0, name).alias("listed"),
    )


def oracle() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    by_len = sorted(RULES, key=lambda r: (-len(r.host + r.path), r.host))
    rule = " ".join(f"WHEN {fits(r.host, r.path)} THEN '{r.host}{r.path}'" for r in by_len)
    verdict = " ".join(f"WHEN {fits(r.host, r.path)} THEN '{r.verdict}'" for r in by_len)
    listed = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p in sorted(LISTED, key=lambda x: -len(x[0] + x[1])))
    return rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(r, '') AS r FROM rest)
), ruled AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS rv, CASE {listed} END AS l FROM parts
)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN l IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN rule IS NULL THEN l END AS listed
FROM ruled"""
