"""Range, window and label aggregates over long metric points."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import MICROS, floor_time, from_micros, micros, seconds_between

AGGREGATIONS = ("sum", "avg", "min", "max", "count", "percentile")


def _ranked_pass(
    df: DataFrame, keys: list[str], value: str, q: float, accuracy: int, extra: list[Column]
) -> DataFrame:
    """Two scans: a sketch that brackets the quantile, then counts of what lies inside.

    The second scan folds everything below the bracket into one row per key and
    everything above into another, so only the distinct values inside are ever
    ordered.  No task holds a whole key, and the result is exact: the sketch errs
    by a rank share of 1 / accuracy at most, the bracket allows three times that.
    """
    eps = 3.0 / accuracy
    rows = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [max(q - eps, 0.0), min(q + eps, 1.0)], accuracy).alias("_b"),
    )
    # Below ``accuracy`` rows the bracket may be narrower than one rank: keep all.
    whole = F.col("_n") <= accuracy
    sketch = sketch.select(
        *keys, "_n",
        F.when(~whole, F.col("_b")[0]).alias("_lo"),
        F.when(~whole, F.col("_b")[1]).alias("_hi"),
    )
    v = F.col("_v")
    # null sorts before, NaN after every value of the bracket
    folded = F.when(v > F.col("_hi"), F.lit(float("nan"))).when(F.col("_lo").isNull() | (v >= F.col("_lo")), v)
    counted = rows.join(sketch, keys).groupBy(*keys, "_n", folded.alias("_f")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    up_to = (
        Window.partitionBy(*keys, "_n").orderBy(F.col("_f").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counted.withColumn("_end", F.sum("_c").over(up_to))
    rank = (F.col("_n") - 1) * F.lit(q)
    low, high = F.floor(rank), F.ceil(rank)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_end") > position) & (F.col("_end") - F.col("_c") <= position), F.col("_f")))

    picked = ranked.groupBy(*keys, "_n").agg(at(low).alias("_a"), at(high).alias("_z"), *extra)
    return picked.withColumn("_q", F.col("_a") + (F.col("_z") - F.col("_a")) * (rank - low))


def exact_quantile(
    df: DataFrame, keys: list[str], value: str, q: float = 0.95, name: str = "p95", accuracy: int = 10_000
) -> DataFrame:
    """Exact linear-interpolated quantile per key, safe for keys of any size."""
    return _ranked_pass(df, keys, value, q, accuracy, []).select(*keys, F.col("_q").alias(name))


def _simple(value: str) -> dict[str, Column]:
    return {
        "sum": F.sum(value).alias("sum_value"), "avg": F.avg(value).alias("avg_value"), "min": F.min(value).alias("min_value"),
        "max": F.max(value).alias("max_value"), "count": F.count(value).alias("n_points"),
    }


def range_aggregates(
    points: DataFrame, keys: list[str], value: str = "value", q: float = 0.95, accuracy: int = 10_000,
    aggregations: Sequence[str] = AGGREGATIONS,
) -> DataFrame:
    """The chosen aggregates of each series: sum, avg, min, max, count, percentile.

    All but the percentile come from one scan with partial aggregates.  The exact
    percentile first counts rows per key: where no key holds more than
    ``accuracy`` rows, the built-in aggregate keeps a key in one task; otherwise
    the bracketing form takes two scans and holds no key whole.
    """
    unknown = set(aggregations) - set(AGGREGATIONS)
    if unknown:
        raise ValueError(f"unknown aggregations {sorted(unknown)}")
    simple = [c for name, c in _simple(value).items() if name in aggregations]
    rows = points.filter(F.col(value).isNotNull())
    if "percentile" not in aggregations:
        return rows.groupBy(*keys).agg(*simple)
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= accuracy:
        return rows.groupBy(*keys).agg(*simple, F.percentile(value, F.lit(q)).alias("p_value"))
    extra = [F.sum("_s").alias("_s"), F.min("_min").alias("_min"), F.max("_max").alias("_max")]
    found = {
        "sum": F.col("_s").alias("sum_value"), "avg": (F.col("_s") / F.col("_n")).alias("avg_value"), "min": F.col("_min").alias("min_value"),
        "max": F.col("_max").alias("max_value"), "count": F.col("_n").alias("n_points"), "percentile": F.col("_q").alias("p_value"),
    }
    return _ranked_pass(points, keys, value, q, accuracy, extra).select(*keys, *[c for name, c in found.items() if name in aggregations])


def windowed_aggregates(
    points: DataFrame, keys: list[str], interval_seconds: int, ts: str = "ts", value: str = "value", q: float = 0.95,
    aggregations: Sequence[str] = AGGREGATIONS, names: Sequence[str] | None = None, start: str | None = None, stop: str | None = None,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """The chosen aggregates per key and tumbling window of ``interval_seconds``.

    ``names``, ``start`` (included), ``stop`` (excluded) and ``labels`` restrict
    the points read.
    """
    if names is not None:
        points = points.filter(F.col("name").isin(list(names)))
    if start is not None:
        points = points.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if stop is not None:
        points = points.filter(F.col(ts) < F.lit(stop).cast("timestamp_ntz"))
    for label, wanted in (labels or {}).items():
        points = points.filter(F.try_element_at("labels", F.lit(label)) == wanted)
    bucketed = points.select(*keys, floor_time(ts, interval_seconds).alias("window_start"), value)
    return range_aggregates(bucketed, [*keys, "window_start"], value, q, aggregations=aggregations)


def trailing_stats(points: DataFrame, keys: list[str], now: Column, window_seconds: int = 60) -> DataFrame:
    """Statistics of each series over the last ``window_seconds`` up to ``now`` (inclusive)."""
    age = seconds_between("ts", now)
    return points.filter(age.between(0, window_seconds)).groupBy(*keys).agg(
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("avg_value"),
        F.stddev_pop("value").alias("std_value"),
        F.count("value").alias("n_points"),
        F.max("ts").alias("last_update"),
    )


def first_point_metadata(points: DataFrame, keys: list[str], now: Column, payload: list[str], hours: int = 1) -> DataFrame:
    """Payload of each series' first point within the last hours."""
    recent = points.filter(seconds_between("ts", now).between(0, hours * 3600))
    first = F.min_by(F.struct("ts", *payload), F.struct("ts", *payload))
    return recent.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*")


def latest_values(points: DataFrame, keys: list[str], tie_break: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Latest value per series (an instant query)."""
    order = F.struct(ts, *tie_break)
    return points.groupBy(*keys).agg(F.max(ts).alias("last_ts"), F.max_by(value, order).alias("last_value"))


def label_names(points: DataFrame, name: str) -> DataFrame:
    return (
        points.filter(F.col("name") == name)
        .select(F.explode(F.map_keys("labels")).alias("label")).distinct()
    )


def label_values(points: DataFrame, name: str, label: str) -> DataFrame:
    return (
        points.filter(F.col("name") == name)
        .select(F.try_element_at("labels", F.lit(label)).alias("label_value"))
        .filter(F.col("label_value").isNotNull()).distinct()
    )


def step_lookup(
    points: DataFrame, keys: list[str], start: str, stop: str, step_seconds: int,
    lookback_seconds: int = 300, tie_break: list[str] | None = None,
) -> DataFrame:
    """Value of each series at each step: the last point in (step - lookback, step].

    A point names the steps that can see it, and the newest point of a step wins in
    one aggregate that combines before its shuffle: steps that see no point are
    never made, and nothing is ordered.
    """
    step, reach = step_seconds * MICROS, lookback_seconds * MICROS
    lo, hi = (micros(F.lit(x).cast("timestamp_ntz")) for x in (start, stop))
    m = micros("ts")
    seen = points.filter((m > lo - reach) & (m <= hi))
    # from the first step at or after the point to the last one inside its look-back
    first = F.greatest(F.ceil((m - lo) / F.lit(step)), F.lit(0)).cast("bigint")
    last = F.least(F.ceil((m + reach - lo) / F.lit(step)) - 1, F.floor((hi - lo) / F.lit(step))).cast("bigint")
    shown = seen.withColumns({"_first": first, "_last": last}).filter("_first <= _last").withColumn("slot", F.explode(F.sequence("_first", "_last")))
    newest = F.max_by("value", F.struct("ts", *(tie_break or [])))
    return shown.groupBy(*keys, "slot").agg(newest.alias("value")).select(
        *keys, from_micros(lo + F.col("slot") * step).alias("step_ts"), "value"
    )
