"""Query of the ranked lexical search and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metricloom.llm.common import read
from metricloom.llm.fp_search import search


def op12_fp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = {"op12_fp_search": rf"""
WITH words AS (SELECT doc_id, {TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
scaled AS (SELECT doc_id, terms, 75 + (25 * n * n_docs) // n_terms AS m FROM sized, totals),
counts AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(terms) AS term FROM scaled) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term, n_docs),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT a.item_id, c.doc_id, CAST(sum(a.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * c.m))) AS BIGINT) AS score
  FROM asked a JOIN counts c ON c.term = a.term JOIN weights w ON w.term = a.term GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""}

QUERIES = {"op12_fp_search": op12_fp_search}
