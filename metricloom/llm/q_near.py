"""Query of the near-duplicate operator on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.bag_minhash import near_duplicates
from metricloom.llm.common import read


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


QUERIES = {"op6_bag_minhash": op6_bag_minhash}
