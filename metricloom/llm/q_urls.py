"""Query of the URL filter and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import read
from metricloom.llm.url_filter import filter_urls, host

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The list holds the canonical urls of pages on hosts that carry one of these names.
SPAM = r"(^|\.)(spam-farm|cheap-pills)\."


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(host(F.col("url")).rlike(SPAM)).select("url")
    return filter_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


SQL = {"op1_url_filter": r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '') AS query
  FROM pages),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN host || rtrim(path, '/') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS url_key
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(query[2:], '&'),
          lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&') AS kept FROM parts)),
listed AS (SELECT DISTINCT url_key FROM keyed WHERE url_key IS NOT NULL AND regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.')),
rules(action, domain, prefix) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
urls AS (SELECT DISTINCT host, path FROM keyed),
best AS (
  SELECT host, path, arg_max(domain || prefix, length(domain || prefix)) AS rule, arg_max(action, length(domain || prefix)) AS action
  FROM urls JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY host, path)
SELECT k.page_id, k.host, k.path, b.rule, coalesce(b.action, CASE WHEN l.url_key IS NULL THEN 'allow' ELSE 'block' END) AS verdict, l.url_key IS NOT NULL AS listed
FROM keyed k LEFT JOIN best b ON b.host = k.host AND b.path = k.path LEFT JOIN listed l ON l.url_key = k.url_key
"""}

QUERIES = {"op1_url_filter": op1_url_filter}
