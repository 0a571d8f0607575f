"""Query of the near-duplicate operator on vectors, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metricloom.llm.common import read
from metricloom.llm.subspace_join import vector_links


def op8_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.9)


SQL = {"op8_subspace_pigeonhole": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) >= 0.9 * (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.w FROM reach r JOIN links l ON l.u = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.vec_id = e.vec_id LEFT JOIN counts c ON c.u = e.vec_id
"""}

QUERIES = {"op8_subspace_pigeonhole": op8_subspace_pigeonhole}
