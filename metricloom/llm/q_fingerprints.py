"""Query of the Merkle fingerprints and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metricloom.llm.common import read
from metricloom.llm.fingerprints import fingerprint_edits


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents"))


def _tree(text: str) -> str:
    leaf = "lambda x: sha256('l' || x)"
    return f"""list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
      lambda p: list_transform(regexp_extract_all(p, '[^.!?|]*[.!?|]+|[^.!?|]+'), {leaf})))"""


def _root(tree: str) -> str:
    return f"""sha256('r' || array_to_string(list_transform({tree}, lambda s: sha256('s' || array_to_string(list_transform(s,
      lambda p: sha256('p' || coalesce(array_to_string(p, ''), ''))), ''))), ''))"""


def _likeness(a: str, b: str) -> str:
    x, y = f"list_distinct(flatten(flatten({a})))", f"list_distinct(flatten(flatten({b})))"
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


SQL = {"op7_merkle_fingerprint": f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM documents),
edits AS (
  SELECT *, length(text) AS n, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM texts),
trees AS (SELECT *, {_tree('text')} AS a, {_tree('edited')} AS b, {_tree('next_text')} AS c FROM edits)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {_root('a')} AS fingerprint, {_root('b')} AS edited_fingerprint,
  {_likeness('a', 'b')} AS near_edited, {_likeness('a', 'c')} AS near_next,
  CAST(list_sum(list_transform(range(1, len(a) + 1), lambda i: len(list_filter(range(1, len(a[i]) + 1), lambda j: a[i][j] IS DISTINCT FROM b[i][j])))) AS BIGINT) AS n_differing
FROM trees
"""}

QUERIES = {"op7_merkle_fingerprint": op7_merkle_fingerprint}
