"""Query of the harmonic packing operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from metricloom.llm.common import read
from metricloom.llm.harmonic import harmonic_pack


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op11_harmonic_packing": op11_harmonic_packing}
