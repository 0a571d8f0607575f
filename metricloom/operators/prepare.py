"""Regular grids from irregular metric points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import MICROS, floor_time, from_micros, micros


def mean_per_timestamp(points: DataFrame) -> DataFrame:
    """Mean per (metric, timestamp): repeated timestamps count once."""
    return points.groupBy("name", "ts").agg(F.avg("value").alias("value"))


def pivot_metrics(long: DataFrame, names: list[str], index: str = "ts", value: str = "value") -> DataFrame:
    """One column per metric, aligned on ``index`` like a full outer join of the series.

    The list of names is explicit, so no extra job collects it.
    """
    return long.groupBy(index).pivot("name", names).agg(F.avg(value))


def regular_grid(points: DataFrame, step_seconds: int = 60) -> DataFrame:
    """Resample every metric to one shared grid from the first to the last bucket.

    Columns: name, h (bucket start), i (bucket number), value (mean of the
    per-timestamp means, null in an empty bucket), carried (forward fill) and
    filled (time-linear interpolation; null before the first value, the last
    value after the end).

    Gaps are made by exploding the span between neighbouring buckets, so fill
    and interpolation need only the next non-empty bucket: one window over
    aggregated buckets, whose number is bounded by the time span.
    """
    step = step_seconds * MICROS
    span = points.select(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi"))).scalar()
    lo, hi = (micros(floor_time(span[end], step_seconds)) for end in ("lo", "hi"))
    buckets = (
        mean_per_timestamp(points)
        .groupBy("name", micros(floor_time("ts", step_seconds)).alias("m"))
        .agg(F.avg("value").alias("v"))
    )
    ordered = Window.partitionBy("name").orderBy("m")
    ahead = buckets.withColumns({
        "next_m": F.lead("m").over(ordered),
        "next_v": F.lead("v").over(ordered),
        "first": F.row_number().over(ordered) == 1,
    })
    start = F.when(F.col("first"), lo).otherwise(F.col("m"))
    stop = F.coalesce(F.col("next_m") - step, hi)
    dense = ahead.withColumn("g", F.explode(F.sequence(start, stop, F.lit(step)))).withColumn("lo", lo)
    share = (F.col("g") - F.col("m")) / (F.col("next_m") - F.col("m"))
    known = F.col("g") >= F.col("m")
    return dense.select(
        "name",
        from_micros(F.col("g")).alias("h"),
        F.floor((F.col("g") - F.col("lo")) / F.lit(step)).cast("bigint").alias("i"),
        F.when(F.col("g") == F.col("m"), F.col("v")).alias("value"),
        F.when(known, F.col("v")).alias("carried"),
        F.when(F.col("g") == F.col("m"), F.col("v"))
        .when(known, F.coalesce(F.col("v") + (F.col("next_v") - F.col("v")) * share, F.col("v")))
        .alias("filled"),
    )


def aligned_features(points: DataFrame, names: list[str], step_seconds: int = 60) -> DataFrame:
    """Wide feature frame: all metrics on one grid, gaps interpolated."""
    return pivot_metrics(regular_grid(points, step_seconds), names, "h", "filled")
