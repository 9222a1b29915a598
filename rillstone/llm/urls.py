"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter's size is bounded whatever the list's length (see ``bloom``). URLs that the filter rules out never meet the list; possible hits go to an exact
hash join with the list, which removes the false positives. Both are DataFrame functions.

Rules: (host, path, verdict). A rule fits its host and all its subdomains if the URL's path starts with the rule's; the
longest rule that fits decides (by host, then path, in characters together). Without a rule, listed URLs are blocked.

Defined results: a null URL or one without ``://`` has an empty host and path, no canonical form, no rule, and is
allowed. Repeated rows are each judged; an empty list blocks nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import cut, read_table

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Hosts whose pages make up the list of the registered query.
LISTED_HOSTS = r"(^|[.-])(ads?|bets?|casino)([.-]|$)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without .html or a slash at the end, query without tracking; no scheme, no fragment."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref)=[^&]*", ""), r"^&", "")
    return F.when(url.contains("://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The deciding rule (as host and path) and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def in_list(rows: DataFrame, url: str, listed: DataFrame, flag: str = "listed") -> DataFrame:
    """``rows`` with a boolean column: whether ``url`` is in the one-column table ``listed``."""
    names = rows.columns
    known = cut(listed.select(F.col(listed.columns[0]).alias("_listed")).filter("_listed IS NOT NULL").distinct())
    probe = bloom.tested(rows, url, *bloom.built(known, "_listed", known.count()))
    misses = probe.filter(~F.col("_hit")).select(*names, F.lit(False).alias(flag))
    hits = probe.filter("_hit").join(known, F.col(url) == F.col("_listed"), "left").select(*names, F.col("_listed").isNotNull().alias(flag))
    return misses.unionByName(hits)


def judged(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages``."""
    rows = pages.select(F.col(page_id), F.col(url).alias("_url"))
    rows = rows.select(page_id, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), canonical(F.col("_url")).alias("canonical"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    out = in_list(rows, "canonical", listed)
    return out.select(page_id, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    listed = pages.filter(host_of(F.col("url")).rlike(LISTED_HOSTS)).select(canonical(F.col("url")).alias("url"))
    return judged(pages, listed)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^.*?://[^?#]*[?]([^#]*)', 1, 's'), '') AS q0
  FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(q0, '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') AS q FROM p),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN
        regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '([.]html|/)$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canon
      FROM q),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|[.-])(ads?|bets?|casino)([.-]|$)')),
r(h, pre, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, h || pre AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC) AS k
      FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT c.page_id, host, path, rule, coalesce(v, CASE WHEN canon IN (SELECT canon FROM l WHERE canon IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN (SELECT * FROM m WHERE k = 1) m USING (page_id)
"""
QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {"op6_url_filter": ORACLE_SQL}
