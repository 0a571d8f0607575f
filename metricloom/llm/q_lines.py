"""Query of the line deduplication and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import read
from metricloom.llm.line_templates import drop_recurring_lines


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines it had, lines dropped, md5 of the text that stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    out = drop_recurring_lines(docs)
    return out.select("doc_id", "n_lines", F.col("lines_dropped").cast("long").alias("n_dropped"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL = {"op9_line_templates": r"""
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
split_lines AS (SELECT text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM texts),
lines AS (
  SELECT text, pos, list_transform(list_filter(string_split(line, ' '), lambda x: x <> ''),
         lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens FROM split_lines),
parsed AS (SELECT *, len(tokens) || ':' || tokens[1:3]::VARCHAR AS leaf FROM lines WHERE len(tokens) > 0),
live AS (SELECT leaf FROM parsed GROUP BY leaf HAVING count(DISTINCT text) >= 3),
found AS (SELECT * FROM parsed WHERE leaf IN (SELECT leaf FROM live)),
shapes AS (SELECT leaf, tokens, count(DISTINCT text) AS texts FROM found GROUP BY leaf, tokens),
cells AS (SELECT leaf, tokens, texts, unnest(tokens) AS token, unnest(range(len(tokens))) AS place FROM shapes),
support AS (SELECT leaf, place, token FROM cells WHERE token <> '<*>' GROUP BY ALL HAVING sum(texts) >= 3),
marked AS (SELECT c.leaf, c.tokens, c.place, CASE WHEN s.token IS NULL THEN '<*>' ELSE c.token END AS token
  FROM cells c LEFT JOIN support s ON s.leaf = c.leaf AND s.place = c.place AND s.token = c.token),
templates AS (
  SELECT leaf, tokens, list(token ORDER BY place) AS template, count(*) FILTER (token <> '<*>') AS constants, count(*) AS size
  FROM marked GROUP BY leaf, tokens),
good AS (SELECT * FROM templates WHERE constants >= size * 0.7),
own AS (
  SELECT t.text FROM texts t JOIN (SELECT text, sum(len(tokens)) AS shared FROM found GROUP BY text) f ON f.text = t.text
  WHERE len(list_filter(string_split(replace(t.text, chr(10), ' '), ' '), lambda x: x <> '')) - shared
    >= 0.2 * len(list_filter(string_split(replace(t.text, chr(10), ' '), ' '), lambda x: x <> ''))),
often AS (
  SELECT g.leaf, g.template FROM good g JOIN found f ON f.leaf = g.leaf AND f.tokens = g.tokens WHERE f.text IN (SELECT text FROM own)
  GROUP BY g.leaf, g.template, g.size
  HAVING count(DISTINCT f.text) >= CASE WHEN g.size < 3 THEN greatest(3, 0.001 * (SELECT count(*) FROM texts)) ELSE 3 END),
hits AS (
  SELECT f.text, f.pos FROM found f JOIN good g ON f.leaf = g.leaf AND f.tokens = g.tokens
  JOIN often o ON o.leaf = g.leaf AND o.template = g.template),
drops AS (SELECT text, list(pos) AS places FROM hits GROUP BY text),
cut AS (SELECT d.doc_id, d.text, r.places FROM documents d LEFT JOIN drops r ON r.text = d.text)
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(len(places), 0) AS BIGINT) AS n_dropped,
  md5(CASE WHEN places IS NULL THEN text ELSE coalesce(array_to_string(list_transform(
    list_filter(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]), chr(10)), '') END) AS text_md5
FROM cut
"""}

QUERIES = {"op9_line_templates": op9_line_templates}
