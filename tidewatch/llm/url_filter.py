"""URL filter: longest fitting rule, else a blocked Bloom filter and an exact hash join.

DataFrame functions only. The filter is one row of 64 bits for each block; its size has a
fixed upper bound, so it may be broadcast at any length of the list. A longer list only
raises the share of false positives, which the exact join takes out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import table

#: Fixed values of the query's contract: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Words that put the URLs of a host on the list, where one stands in a label by itself or
#: between hyphens: gambling, pharmacy, adult, spam and advertising hosts of any domain.
LISTED_WORDS = (
    "casino", "bets", "poker", "lottery", "pills", "viagra", "adult", "xxx", "spam", "ads",
)
LISTED_HOST = r"(^|[.-])(" + "|".join(LISTED_WORDS) + r")([.-]|$)"
URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Bloom:
    """Bits for each listed URL, bits set for each, and the most blocks (of 64 bits)."""

    bits_per_url: int = 16
    probes: int = 6
    max_blocks: int = 1 << 20


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, group), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 2), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 3)


def canonical(url: Column) -> Column:
    """Scheme, ``www.``, fragment, tracking parameters and trailing slashes taken off.

    Null where the URL is null or has no ``://``.
    """
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    pairs = F.split(F.substring(_part(url, 4), 2, 1 << 30), "&")
    kept = F.array_join(F.filter(pairs, lambda p: ~p.rlike(TRACKING) & (p != "")), "&")
    whole = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; of equally long ones the longer host's,
    then the one that blocks. Null without a rule."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in reversed(order):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _address(key: Column, blocks: int, probes: int) -> tuple[Column, Column]:
    """Block of a key, and its bits within the block."""
    second = F.xxhash64(key, F.lit("bits"))
    bits = F.lit(0).cast("long")
    for i in range(probes):
        at = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), bits


def bloom_filter(listed: DataFrame, blocks: int, bloom: Bloom) -> DataFrame:
    """Rows (block, filled) of the filter over ``listed.key``."""
    block, bits = _address(F.col("key"), blocks, bloom.probes)
    return listed.groupBy(block.alias("block")).agg(F.bit_or(bits).alias("filled"))


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules=RULES, bloom: Bloom = Bloom(), url: str = "url"
) -> DataFrame:
    """Add host, path, rule and verdict to ``pages``; those names are replaced if present.

    ``listed`` has a column ``url``. A page that no rule fits is blocked if its canonical URL
    is listed. A null URL or one without ``://`` has an empty host and path and is allowed.
    Repeated rows stay, an empty list blocks nothing, an empty table gives none.
    """
    keys = listed.select(canonical(F.col("url")).alias("key")).filter("key is not null").distinct()
    blocks = min(bloom.max_blocks, max(1, -(-keys.count() * bloom.bits_per_url // 64)))
    # One row, whatever columns the caller has: the whole input travels as a struct.
    own = F.col(f"page.`{url}`")
    rows = pages.select(F.struct("*").alias("page"))
    rows = rows.withColumn("host", host_of(own)).withColumn("path", path_of(own))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("verdict", verdict)
    rows = rows.withColumn("key", F.when(F.col("rule").isNull(), canonical(own)))
    block, bits = _address(F.col("key"), blocks, bloom.probes)
    probed = rows.withColumn("block", block).withColumn("bits", bits)
    probed = probed.join(F.broadcast(bloom_filter(keys, blocks, bloom)), "block", "left")
    possible = F.coalesce(
        F.col("key").isNotNull() & (F.col("filled").bitwiseAND(F.col("bits")) == F.col("bits")),
        F.lit(False),
    )
    # Only possible hits are shuffled to the list; all other rows are judged where they are.
    hits = probed.filter(possible).join(keys.withColumn("found", F.lit(True)), "key", "left")
    judged = probed.filter(~possible).withColumn("found", F.lit(None).cast("boolean"))
    out = judged.unionByName(hits.select(judged.columns))
    by_list = F.when(F.col("found"), "block").otherwise("allow")
    added = ("host", "path", "rule", "verdict")
    kept = [F.col(f"page.`{c}`") for c in pages.columns if c.lower() not in added]
    return out.select(
        *kept, "host", "path", "rule", F.coalesce("verdict", by_list).alias("verdict")
    )


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list: URLs of hosts with one of the listed words in a label."""
    return pages.select("url").filter(host_of(F.col("url")).rlike(LISTED_HOST))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, listed_urls(pages)).select(
        "page_id", "host", "path", "rule", "verdict"
    )


OP8_SQL = rf"""
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '{URL}', 2), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '{URL}', 3), '') AS path,
    coalesce(regexp_extract(url, '{URL}', 4), '') AS query
  FROM pages),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
    regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') ||
    coalesce('?' || nullif(array_to_string(list_filter(string_split(substr(query, 2), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}')), '&'), ''), '') END AS key,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com')
           AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com')
           AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM p),
l AS (SELECT DISTINCT key FROM c WHERE regexp_matches(host, '{LISTED_HOST}'))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN key IN (SELECT key FROM l WHERE key IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
