"""Pattern library: query, add-or-merge, analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import from_micros, micros
from metricloom.operators.similarity import best_matches


def query_library(
    library: DataFrame, pattern_type: str | None = None, category: str | None = None,
    tags: list[str] | None = None, min_confidence: float = 0.0, limit: int | None = None, key: str = "pattern_id",
) -> DataFrame:
    """Filtered patterns, most frequent first; ``tags`` must all be present."""
    out = library.filter(F.col("confidence") >= min_confidence)
    if pattern_type:
        out = out.filter(F.col("pattern_type") == pattern_type)
    if category:
        out = out.filter(F.col("category") == category)
    if tags:
        wanted = F.array(*[F.lit(t) for t in tags])
        out = out.filter(F.size(F.array_except(wanted, F.col("tags"))) == 0)
    out = out.orderBy(F.col("frequency").desc(), F.col(key))
    return out.limit(limit) if limit else out


def merge_into_library(
    library: DataFrame, incoming: DataFrame, threshold: float = 0.8, key: str = "pattern_id", start_confidence: float = 1.0
) -> DataFrame:
    """Library after a batch of patterns.

    A row similar to a library pattern of its type raises that pattern's
    frequency by 1 and confidence by 0.1 (at most 1) and adds its tags.  Rows
    without a match collapse by exact id and are inserted.  All rows of a batch
    are matched against the library as it was at the start of the batch.
    """
    matched = best_matches(
        incoming.withColumnRenamed(key, "probe_id"), library.withColumnRenamed(key, "library_id"),
        ["pattern_type"], threshold,
    )
    hits = matched.groupBy("pattern_type", F.col("library_id").alias(key)).agg(F.count(F.lit(1)).alias("hits"))
    gained = (
        matched.join(incoming.select("pattern_type", F.col(key).alias("probe_id"), "tags"), ["pattern_type", "probe_id"])
        .select("pattern_type", F.col("library_id").alias(key), F.explode("tags").alias("tag"))
        .groupBy("pattern_type", key).agg(F.collect_set("tag").alias("new_tags"))
    )
    updated = library.join(hits, ["pattern_type", key], "left").join(
        gained, ["pattern_type", key], "left"
    ).select(
        key, "pattern_type",
        (F.col("frequency") + F.coalesce("hits", F.lit(0))).alias("frequency"),
        F.least(F.lit(1.0), F.col("confidence") + 0.1 * F.coalesce("hits", F.lit(0))).alias("confidence"),
        F.array_union("tags", F.coalesce("new_tags", F.array().cast("array<string>"))).alias("tags"),
    )
    fresh = incoming.join(
        matched.select("pattern_type", F.col("probe_id").alias(key)), ["pattern_type", key], "left_anti"
    )
    repeats = fresh.groupBy(key, "pattern_type").agg(F.count(F.lit(1)).alias("frequency"))
    fresh_tags = (
        fresh.select(key, "pattern_type", F.explode("tags").alias("tag"))
        .groupBy(key, "pattern_type").agg(F.collect_set("tag").alias("tags"))
    )
    inserted = repeats.join(fresh_tags, [key, "pattern_type"], "left").select(
        key, "pattern_type", "frequency",
        F.least(F.lit(1.0), F.lit(start_confidence) + 0.1 * (F.col("frequency") - 1)).alias("confidence"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
    return updated.unionByName(inserted)


def library_counts(library: DataFrame, labels: DataFrame, key: str = "pattern_id") -> DataFrame:
    """Total, per category, per tag and per cluster counts: (kind, item, n)."""
    count = F.count(F.lit(1)).alias("n")
    total = library.agg(count).select(F.lit("total").alias("kind"), F.lit("all").alias("item"), "n")
    by_category = library.groupBy(F.col("category").alias("item")).agg(count)
    by_tag = library.select(F.explode("tags").alias("item")).groupBy("item").agg(count)
    by_cluster = labels.filter(F.col("label") != -1).groupBy(F.col("label").cast("string").alias("item")).agg(count)
    parts = [("category", by_category), ("tag", by_tag), ("cluster", by_cluster)]
    for kind, part in parts:
        total = total.unionByName(part.withColumn("kind", F.lit(kind)))
    return total


def temporal_histogram(df: DataFrame, ts: str = "ts", max_edges: int = 50) -> DataFrame:
    """Counts over m - 1 equal bins between the first and last time, m = min(50, rows).

    The last bin includes its right edge; empty bins are reported as 0.
    """
    span = df.agg(
        F.min(micros(ts)).alias("lo"), F.max(micros(ts)).alias("hi"),
        F.least(F.count(F.lit(1)), F.lit(max_edges)).alias("edges"),
    ).filter("edges > 1")
    bounds = span.select(F.struct("lo", "hi", "edges")).scalar()
    lo, hi, edges = bounds["lo"], bounds["hi"], bounds["edges"]
    width = (hi - lo) / (edges - 1)
    at = F.when(hi == lo, edges - 2).otherwise(F.least(F.floor((micros(ts) - lo) / width), edges - 2))
    counts = df.groupBy(at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = span.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("edges") - 2)).alias("bin"),
        "lo", ((F.col("hi") - F.col("lo")) / (F.col("edges") - 1)).alias("width"),
    )
    edge = lambda k: from_micros(F.floor(F.col("lo") + F.col("width") * k).cast("bigint"))
    return bins.join(counts, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
