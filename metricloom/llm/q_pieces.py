"""Query of the piece encoder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from metricloom.llm.common import read
from metricloom.llm.piece_viterbi import digests


def op3_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op3_piece_viterbi": op3_piece_viterbi}
