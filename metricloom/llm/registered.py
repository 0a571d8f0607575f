"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from metricloom.llm import (
    q_audit, q_fingerprints, q_harmonic, q_lines, q_near, q_pack, q_pieces, q_quality_model, q_search, q_urls, q_vectors, q_warc, q_write,
)

MODULES = (q_urls, q_write, q_pieces, q_quality_model, q_warc, q_near, q_fingerprints, q_vectors, q_lines, q_pack, q_harmonic, q_search, q_audit)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: run for module in MODULES for name, run in module.QUERIES.items()}
    return found | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for module in MODULES for name, sql in getattr(module, "SQL", {}).items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
