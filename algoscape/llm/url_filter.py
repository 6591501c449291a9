"""URL filters: rules by host suffix and path prefix, then a list of canonical URLs behind a blocked Bloom filter.

A rule ``host/path`` fits its host and all subdomains where the url's path starts with the rule's path; the longest
fitting rule gives the verdict. Urls without a rule are blocked if their canonical form is listed. The list is a table
of any size: its blocked Bloom filter (one 256-bit block a key, one bit in each of its four words) is built by a
distributed bit_or per block, and only possible hits go on to the exact hash join that removes false positives. The filter
is broadcast while it has at most ``MAX_BROADCAST_BLOCKS`` blocks of 40 bytes, and joined by a shuffle on the
block beyond that. All of it is DataFrame functions in the JVM.

The canonical form drops scheme, a leading ``www.``, default ports, fragment, trailing slashes and tracking parameters.

A url without a rule is blocked or allowed by the list; of equally long rules the first in the list holds.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule, is never listed and is
allowed; very long urls are read whole; texts and html are not read; repeated rows and repeated list entries change nothing else; a null page id is judged as others; an empty
pages table gives an empty result, an empty list blocks nothing; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fixed rules of the contract: (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Hosts whose pages make up the list in the query, as a stand-in for an outside list of urls.
LISTED_HOSTS = r"(^|\.)(spam|[^.]*-farm|[^.]*casino[^.]*)\."
#: Bits of the filter per listed url.
BITS_PER_KEY = 16
MAX_BROADCAST_BLOCKS = 800_000
_WORDS = 4
_TRACKING = r"^(utm_[a-z]*|ref|fbclid|gclid)(=|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ://, null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Canonical form of a url; null where it has none."""
    rest = _after_scheme(url)
    plain_host = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    plain_path = F.regexp_replace(path(url), "/+$", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    own = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(_TRACKING)), "&")
    return F.when(rest.isNotNull(), F.concat(plain_host, plain_path, F.when(own != "", F.concat(F.lit("?"), own)).otherwise(F.lit(""))))


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (null for none) and its verdict; equally long rules: the first in the list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, _, prefix = text.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _shift(bits: Column, by: Column) -> Column:
    return F.call_function("shiftleft", bits, by)


def _masks(key: Column) -> list[Column]:
    """One bit in each word of a block, from six bits of the key's second hash each."""
    h = F.xxhash64(key, F.lit(2))
    return [_shift(F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(_WORDS)]


class BloomFilter:
    """Blocked Bloom filter as a table (block, w0..w3)."""

    def __init__(self, keys: DataFrame, key: str, scratch: Scratch, bits_per_key: int = BITS_PER_KEY):
        self.count = keys.count()
        self.blocks = max(1, -(-self.count * bits_per_key // (64 * _WORDS)))
        k = F.col(key)
        words = [F.bit_or(m).alias(f"__w{i}") for i, m in enumerate(_masks(k))]
        self.table = scratch.save(keys.groupBy(self.block(k).alias("__block")).agg(*words), "bloom")

    def block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(self.blocks))

    def possible(self, df: DataFrame, key: str) -> DataFrame:
        """Rows of df with __possible: whether the filter passes the key (null keys never pass)."""
        table = F.broadcast(self.table) if self.blocks <= MAX_BROADCAST_BLOCKS else self.table
        k = F.col(key)
        hit = reduce(lambda a, b: a & b, [F.col(f"__w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(k))])
        # keys that are null get one of many blocks that no table has
        nowhere = -1 - F.pmod(F.xxhash64(*(F.col(c) for c, kind in df.dtypes if not kind.startswith("map"))), F.lit(1 << 20))
        at = F.when(k.isNotNull(), self.block(k)).otherwise(nowhere)
        out = df.withColumn("__block", at).join(table, "__block", "left")
        return out.select(*df.columns, F.coalesce(hit & k.isNotNull(), F.lit(False)).alias("__possible"))


def filter_urls(pages: DataFrame, listed: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, possible (the Bloom filter's answer) and listed, for every page.

    ``listed`` has a column ``url``; both sides are made canonical here. Urls with a rule are not looked up.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    keys = scratch.save(listed.select(canonical(F.col("url")).alias("__key")).where("__key is not null").distinct(), "listed")
    u = F.col(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host(u).alias("host"), path(u).alias("path"), canonical(u).alias("__canon"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "__says": says}).withColumn("__look", F.when(F.col("rule").isNull(), F.col("__canon")))
    asked = BloomFilter(keys, "__key", scratch).possible(rows, "__look")
    maybe = asked.where("__possible")
    exact = maybe.join(keys.withColumn("listed", F.lit(True)).hint("shuffle_hash"), F.col("__look") == F.col("__key"), "left")
    done = exact.drop("__key").unionByName(asked.where("not __possible").withColumn("listed", F.lit(None).cast("boolean")))
    is_listed = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("__says", F.when(is_listed, F.lit("block")).otherwise(F.lit("allow")))
    return done.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("__possible").alias("possible"), is_listed.alias("listed"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns page_id, host, path, rule, verdict; the list holds the urls of pages on LISTED_HOSTS."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = pages.select("url").where(host(F.col("url")).rlike(LISTED_HOSTS))
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


_PARTS = """
  SELECT page_id, rest, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)"""
OP1_SQL = f"""
WITH parts AS ({_PARTS}),
canon AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN own <> '' THEN '?' || own ELSE '' END END AS key
  FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(coalesce(rest, ''), '^[^?#]*\\?([^#]*)', 1), '&'),
          lambda x: x <> '' AND NOT regexp_matches(x, '{_TRACKING}')), '&') AS own FROM parts)),
listed AS (SELECT DISTINCT key FROM canon WHERE regexp_matches(host, '{LISTED_HOSTS}') AND key IS NOT NULL),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM canon)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  rule IS NULL AND l.key IS NOT NULL AS listed
FROM ruled LEFT JOIN listed l ON l.key = ruled.key
"""
