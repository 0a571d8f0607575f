"""Query of the WARC writer and reader, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metricloom.llm.common import read
from metricloom.llm.warc import read_archives, write_archives
from metricloom.session import cut_lineage, shared_folder


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    manifest = cut_lineage(write_archives(pages, shared_folder(spark, "warc"), min_bytes=0))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {"op5_warc": """
WITH hashed AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) >> s) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest
  FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM coded
"""}

QUERIES = {"op5_warc": op5_warc}
