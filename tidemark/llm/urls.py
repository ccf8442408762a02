"""URL filters: rules by host and path, and a list behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: (verdict, host and path prefix)
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

BITS_PER_URL = 16
BROADCAST_BLOCKS = 1 << 17  # of 512 bits: a filter of up to 8 MiB is broadcast, a larger one probed by a join on the block
LISTED_SYMBOL_PERCENT = 2
SALTS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = "(^|&)(utm_[^=&]*|ref|fbclid|gclid)=[^&]*"
# one odd multiplier for each of the eight words of a block
_MULTIPLIERS = (1203114875, 1150766481, 2147479551, 1634901143, 1392843281, 1878532437, 1719042769, 1538113067)


def _url(column: str) -> Column:
    url = F.coalesce(F.col(column), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(column: str = "url") -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(_url(column), "^([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(column: str = "url") -> Column:
    return F.regexp_extract(_url(column), "^[^/?#]*([^?#]*)", 1)


def canonical_url(column: str = "url") -> Column:
    """Host without ``www.`` or ``m.``, path without a closing slash or ``.html``, query without tracking keys."""
    host = F.regexp_replace(url_host(column), "^(www|m)\\.", "")
    path = F.regexp_replace(url_path(column), "(/|\\.html?)$", "")
    query = F.regexp_extract(_url(column), "^[^?#]*\\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), "^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``, or null."""
    found: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _block(url: Column, n_blocks: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(url), 33) % n_blocks


def _bits(url: Column) -> list[Column]:
    """One bit in each of the eight words of a block."""
    low = F.xxhash64(url).bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(low * F.lit(m), 25).bitwiseAND(F.lit(63)).cast("int")) for m in _MULTIPLIERS]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as a table: a row of eight words for each block that holds a bit."""
    words = [F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("canonical")))]
    return listed.groupBy(_block(F.col("canonical"), n_blocks).alias("block")).agg(*words)


def blocks_for(n_urls: int) -> int:
    """Blocks for so many URLs: a power of two that grows with the list, so that the share of false hits doesn't."""
    n = 1
    while n < 1 << 30 and n * 512 < n_urls * BITS_PER_URL:
        n *= 2
    return n


def _salt() -> Column:
    return F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, broadcast_blocks: int = BROADCAST_BLOCKS
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and ``canonical``, for every row of ``pages``.

    ``listed`` has a column ``canonical``. A rule that fits decides; else a listed canonical URL is
    blocked and any other allowed. The list is hashed into a blocked Bloom filter, a table with a row per
    block that is sized to the list. Up to ``broadcast_blocks`` rows it is broadcast; a larger filter is
    spread over the tasks by block, and each URL probes the one block that it hashes to, in a join by
    equality. Only URLs that pass the filter meet the list itself in a hash join, which removes the false
    positives. Both joins deal their side out ``SALTS`` times, so that a URL of very many pages is split.

    A null url, or one without ``://``, has an empty host and path, fits no rule, and is never
    listed. Null or empty entries of the list are ignored, repeated ones count once. Rows that
    repeat are judged one by one. Further columns are not used.
    """
    unique = written(listed.select("canonical").where("canonical <> ''").distinct(), "listed")
    n_blocks = blocks_for(unique.count())
    host, path = url_host(), url_path()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), canonical_url().alias("canonical"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    filters = bloom_blocks(unique, n_blocks)
    tests = [F.col(f"w{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits(F.col("canonical")))]
    rows = rows.withColumn("block", _block(F.col("canonical"), n_blocks))
    if n_blocks <= broadcast_blocks:
        met = rows.join(F.broadcast(filters), "block", "left")
    else:
        met = rows.withColumn("salt", _salt()).join(filters.withColumn("salt", _salts()), ["block", "salt"], "left")
    probed = (
        met
        .withColumn("maybe", F.col("best").isNull() & F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)))
        .select("page_id", "host", "path", "canonical", "best", "maybe")
    )
    probed = written(probed, "probed")
    salted = unique.select("canonical", _salts().alias("salt"), F.lit(True).alias("found"))
    hits = (
        probed.where("maybe")
        .withColumn("salt", _salt())
        .join(salted, ["canonical", "salt"], "left")
        .withColumn("listed", F.coalesce("found", F.lit(False)))
    )
    rest = probed.where(~F.col("maybe")).withColumn("listed", F.lit(False))
    columns = ["page_id", "host", "path", "canonical", "best", "listed"]
    judged = hits.select(*columns).unionByName(rest.select(*columns))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "canonical")


def symbol_pages(pages: DataFrame, percent: int = LISTED_SYMBOL_PERCENT) -> DataFrame:
    """Canonical URLs of pages whose source is more than ``percent`` symbols: a block list drawn from the pages."""
    html = F.coalesce(F.col("html"), F.lit(""))
    symbols = F.length(html) - F.length(F.translate(html, "#*$%", ""))
    return pages.where(symbols * 100 > F.length(html) * percent).select(canonical_url().alias("canonical"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, symbol_pages(pages)).select("page_id", "host", "path", "rule", "verdict")


_RULE_SQL = "".join(
    f" when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{v} {r}'"
    for v, r in sorted(RULES, key=lambda x: -len(x[1]))
)
_SQL = f"""
with cut as (
  select page_id, coalesce(html, '') as html,
    case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as u from pages),
parts as (
  select page_id, html, u, translate(regexp_extract(u, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
    regexp_extract(u, '^[^/?#]*([^?#]*)', 1) as path,
    regexp_replace(regexp_replace(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '(^|&)(utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') as q
  from cut),
canon as (
  select *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html?)$', '') || case when q <> '' then '?' || q else '' end as canonical,
    case{_RULE_SQL} end as best
  from parts),
listed as (
  select distinct canonical from canon
  where canonical <> '' and 100 * (length(html) - length(translate(html, '#*$%', ''))) > {LISTED_SYMBOL_PERCENT} * length(html))
select page_id, host, path, split_part(best, ' ', 2) as rule,
  coalesce(split_part(best, ' ', 1), case when canonical in (select canonical from listed) then 'block' else 'allow' end) as verdict
from canon
"""

QUERIES = {"op10_url_filter": op10_url_filter}
ORACLES = {"op10_url_filter": _SQL}
