"""Query of the token record writer."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from metricloom.llm.common import read
from metricloom.llm.token_records import read_records, write_records
from metricloom.session import cut_lineage, shared_folder

END_ID = 2


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-records")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    manifest = cut_lineage(write_records(read(spark, sf_dir, "documents"), folder, tokenizer, END_ID))
    return read_records(manifest, folder)


QUERIES = {"op2_token_records": op2_token_records}
