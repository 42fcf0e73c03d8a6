"""URL filter: rules first, then a blocked Bloom filter of listed canonical URLs and an exact join of its hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS_LOWER, LETTERS_UPPER, durable, only

#: (verdict, host, path prefix): fixed values of the filter.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: What the list of the query is made of: sites, subdomains, top domains, sections, endings and numbers (fixed values).
SITES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
SUBDOMAINS, TOPS, SECTIONS, ENDINGS, NUMBERS = ("", "m.", "blog."), ("com", "net"), ("de", "en", "es", "fr"), ("", ".html"), 1000
#: A block is one cache line: 8 words of 64 bits, of which a URL sets one bit each.
WORDS = 8


def lowered(c: Column) -> Column:
    return F.translate(c, LETTERS_UPPER, LETTERS_LOWER)


def parts(url: Column) -> dict[str, Column]:
    """Host, path and canonical form; null or without ``://``: all empty.

    Canonical: the host without a leading ``www.``, the path without its last ``/``, and the query without ``utm_``
    parameters, if any is left. The scheme and the fragment do not count.
    """
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(after, "^[^?#]*", 0)
    query = F.regexp_extract(after, "^[^?#]*\\?([^#]*)", 1)
    wanted = F.array_join(F.filter(F.split(query, "&", -1), lambda x: ~x.startswith("utm_") & (x != "")), "&")
    canonical = F.concat(F.regexp_replace(lowered(host), "^www\\.", ""), F.regexp_replace(path, "/$", ""), F.when(wanted != "", F.concat(F.lit("?"), wanted)).otherwise(""))
    return {"host": lowered(host), "path": path, "canonical": canonical}


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> dict[str, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for says, of, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest ends outermost
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(of + prefix)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return {"rule": rule, "ruled": verdict}


def listed_urls(spark: SparkSession) -> DataFrame:
    """(canonical): the list of the query, by rule and not from the pages: numbers that 3 does not divide, on every site."""
    out = spark.range(1, NUMBERS + 1).where("id % 3 <> 0").select(F.col("id").cast("string").alias("n"))
    for name, values in (("sub", SUBDOMAINS), ("site", SITES), ("top", TOPS), ("section", SECTIONS), ("ending", ENDINGS)):
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.select(F.concat("sub", "site", F.lit(".example."), "top", F.lit("/"), "section", F.lit("/"), "n", "ending").alias("canonical"))


def positions(canonical: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a URL, and the bit that it sets in each of the block's words."""
    spread = F.xxhash64(canonical, F.lit("bits"))
    return F.pmod(F.xxhash64(canonical), F.lit(blocks)), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the filter as a table, one row per block that has a URL."""
    block, bits = positions(F.col("canonical"), blocks)
    return listed.select(block.alias("block"), *[b.alias(f"b{k}") for k, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"w{k}") for k in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, bits_per_url: int = 16, salts: int = 8) -> DataFrame:
    """(id, host, path, rule, verdict, possible, listed) for every page.

    The longest fitting rule decides; without one, listed pages are blocked and others allowed. ``listed`` has the
    column ``canonical``. The filter is a table of 512-bit blocks, sized by the count of listed URLs and joined by block
    number; pages whose bits are all set go to the exact join with the list. Both are left joins in one pass over the
    pages: Spark broadcasts the filter and the list while they are under the session's threshold and shuffles beyond, so
    a list of any size works. Then a URL that a third of all pages share is spread by ``salts`` copies of its block and
    of its entry, and pages that cannot match are spread by their ids instead of meeting in one task.

    Null urls and urls without ``://`` have an empty host and path, fit no rule, are not listed and are allowed. Repeated
    pages give repeated results; null or repeated listed URLs do no harm; empty tables give empty results or no hits.
    """
    known = durable(listed.select("canonical").where(F.col("canonical").isNotNull()).distinct())
    blocks = max(1, -(-known.count() * bits_per_url // (64 * WORDS)))
    block, bits = positions(F.col("canonical"), blocks)
    source = only(pages, id=id_col, url=url_col).select("id", *[c.alias(k) for k, c in parts(F.col("url")).items()])
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    apart = -1 - F.pmod(F.xxhash64("id", "path"), F.lit(1 << 20))  # no block has such a number
    judged = source.select("*", *[c.alias(k) for k, c in ruled(F.col("host"), F.col("path"), rules).items()], F.when(F.col("canonical") != "", block).otherwise(apart).alias("block"), F.pmod(F.xxhash64("id", "canonical"), F.lit(salts)).cast("int").alias("salt"))
    every = F.lit(True)
    for k, bit in enumerate(bits):
        every = every & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    probed = judged.join(bloom(known, blocks).select("*", copies), ["block", "salt"], "left").withColumn("possible", F.coalesce(every, F.lit(False)))
    asked = probed.withColumn("entry", F.when(F.col("possible"), F.col("canonical")).otherwise(F.concat(F.lit("\n"), apart.cast("string"))))  # no URL has such a form
    exact = asked.join(known.select(F.col("canonical").alias("entry"), F.lit(True).alias("found"), copies), ["entry", "salt"], "left").withColumn("listed", F.coalesce("found", F.lit(False)))
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict")
    return exact.select(F.col("id").alias(id_col), "host", "path", "rule", verdict, "possible", "listed")


URLS_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS after FROM r),
h AS (SELECT page_id, translate(raw, '{LETTERS_UPPER}', '{LETTERS_LOWER}') AS host, regexp_extract(after, '^[^?#]*') AS path, array_to_string(list_filter(string_split(regexp_extract(after, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: NOT starts_with(x, 'utm_') AND x <> ''), '&') AS q FROM a),
c AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM h),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{o}', '{p}')" for v, o, p in RULES)}) AS t(verdict, rule_host, prefix)),
best AS (SELECT page_id, host, path, canonical, arg_max(rules.verdict, length(rule_host || prefix)) AS ruled, arg_max(rule_host || prefix, length(rule_host || prefix)) AS rule
  FROM c LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, prefix) GROUP BY ALL),
l AS (SELECT sub || site || '.example.' || top || '/' || section || '/' || n || ending AS canonical
  FROM (SELECT unnest({list(SUBDOMAINS)}) AS sub), (SELECT unnest({list(SITES)}) AS site), (SELECT unnest({list(TOPS)}) AS top), (SELECT unnest({list(SECTIONS)}) AS section), (SELECT unnest(range(1, {NUMBERS + 1})) AS n), (SELECT unnest({list(ENDINGS)}) AS ending) WHERE n % 3 <> 0)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM best LEFT JOIN l USING (canonical)
"""
