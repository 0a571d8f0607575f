"""From documents to packed training sequences.

Every stage takes what its predecessor kept; all but the last return the columns
of ``documents``.  ``run`` writes each stage as Parquet under the shared folder
and rereads it, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from metricloom.llm.bag_minhash import keep_one
from metricloom.llm.common import put_back, read, set_aside
from metricloom.llm.line_templates import drop_recurring_lines
from metricloom.llm.packing import pack_documents
from metricloom.llm.quality_model import score, train
from metricloom.session import cut_lineage, prepare_session


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half go; the score itself is not kept."""
    forest = train(docs, read(prepare_session(spark), sf_dir, "labels"))
    return put_back(score(set_aside(docs, ["text"]), forest).filter("score >= 0.5"), docs, ["text"])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; every document stays, with its ``n_chars`` renewed."""
    return put_back(drop_recurring_lines(set_aside(docs, ["text", "n_chars"])), docs, ["text", "n_chars"])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return put_back(keep_one(set_aside(docs, ["doc_id", "text"])), docs, ["doc_id", "text"])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_copies), ("best-fit packing", packing)]

#: Trees, registers and tokens are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(prepare_session(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
