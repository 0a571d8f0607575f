"""Columns of the caller keep their values, whatever their names."""

import corpus_pipeline
from pyspark.sql import functions as F

from metricloom.llm import url_filter
from metricloom.session import cut_lineage

SF = "/root/testdata/sf0.001"
NAMES = ["score", "predicted", "held_out", "lines_dropped", "k1", "k2", "_node", "_k1", "_k2", "_rows", "node", "class_id", "places", "row", "set_aside", "x", "y", "own", "col1"]


def test_pipeline_stages_keep_own_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")))
    docs = cut_lineage(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema["text"] == docs.schema["text"]
        rows = out.select("doc_id", *NAMES).collect()
        assert rows and all(r[name] == f"{i}-{r.doc_id}" for r in rows for i, name in enumerate(NAMES))


def test_url_filter_keeps_own_columns(spark):
    made = ["url_key", "block", "w0", "_on_list", "_b0", "_block", "maybe", "row"]
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.com/y"), (3, None)], "page_id long, url string")
    for name in made:
        pages = pages.withColumn(name, F.concat(F.lit(name), F.col("page_id").cast("string")))
    listed = spark.createDataFrame([("http://b.com/y",)], "url string")
    out = {r.page_id: r for r in url_filter.filter_urls(pages, listed, []).collect()}
    assert {i: r.verdict for i, r in out.items()} == {1: "allow", 2: "block", 3: "allow"}
    assert all(r[name] == f"{name}{i}" for i, r in out.items() for name in made)
