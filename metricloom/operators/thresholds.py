"""Threshold configuration, evaluation and adaptation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.scalars import MICROS, clamp, from_micros, micros, violates
from metricloom.operators.chunks import CHUNK, chunk_of, largest_group, running_total, with_halo
from metricloom.operators.sliding import sliding_quantile
from metricloom.session import cut_lineage

# The names a configuration may use.
THRESHOLD_TYPES = ["static", "dynamic", "adaptive", "time_based", "percentile"]
OPERATORS = [">", "<", ">=", "<=", "==", "!="]
CONFIG_SCHEMA = (
    "name string, threshold_type string, operator string, value double, adaptation_rate double, "
    "min_value double, max_value double, percentile double, time_windows array<struct<hours:string,value:double>>"
)
UNBOUNDED = 1.0e300
#: Rows of a metric that one task may hold in two windows.
TASK_ROWS = 1_000_000


def config_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def load_config(raw: DataFrame) -> DataFrame:
    """Keep the rows whose type, operator and value are readable; text values become numbers."""
    value = F.col("value").try_cast("double")
    good = F.col("threshold_type").isin(THRESHOLD_TYPES) & F.col("operator").isin(OPERATORS) & value.isNotNull()
    return raw.filter(F.coalesce(good, F.lit(False))).withColumn("value", value)


def upsert_config(config: DataFrame, changes: DataFrame, key: str = "name") -> DataFrame:
    return config.join(changes.select(key), key, "left_anti").unionByName(changes)


def remove_config(config: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    return config.join(names.select(key), key, "left_anti")


def with_config(points: DataFrame, config: DataFrame) -> DataFrame:
    """Points joined to the threshold of their metric; unknown metrics drop out."""
    return points.join(config, "name")


def unknown_metrics(points: DataFrame, config: DataFrame) -> DataFrame:
    """Points of metrics without a threshold: a side output instead of an exception."""
    return points.join(config.select("name"), "name", "left_anti")


def time_based_value(ts: Column, windows: Column, base: Column) -> Column:
    """Value of the first window ``"start-end"`` holding the hour, else the base value.

    The windows are an ordered list (a map would lose which one comes first).

    Row-local: the few windows of a metric travel with its configuration row,
    so no range join is needed.
    """
    def holds(w: Column) -> Column:
        ends = F.split(w["hours"], "-")
        return (F.hour(ts) >= ends[0].cast("int")) & (F.hour(ts) < ends[1].cast("int"))

    return F.coalesce(F.try_element_at(F.filter(windows, holds), F.lit(1))["value"], base)


def trailing_percentile(
    points: DataFrame, keys: list[str], percentile: str, ts: str = "ts", value: str = "value",
    window_seconds: int = 3600, chunk_seconds: int | None = None, name: str = "percentile_value", task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Percentile of the key's values in (ts - window, ts], exact and linear.

    ``percentile`` names a column, constant per key, in [0, 100].  A task sees one
    (key, chunk) plus one window of context while that is at most ``task_rows`` rows;
    keys with more in any chunk are answered by bounded panes, with the same result.
    """
    chunk_seconds = chunk_seconds or max(window_seconds, 3600)
    span = chunk_of(ts, chunk_seconds)
    if largest_group(points, [*keys, span]) <= task_rows // 2:
        return _percentile_by_chunk(points, keys, percentile, ts, value, window_seconds, chunk_seconds, name)
    sizes = points.groupBy(*keys, span.alias("_span")).agg(F.count(F.lit(1)).alias("_n"))
    heavy = cut_lineage(sizes.filter(F.col("_n") > task_rows // 2).select(*keys).distinct())
    if heavy.isEmpty():
        return _percentile_by_chunk(points, keys, percentile, ts, value, window_seconds, chunk_seconds, name)
    quiet = points.join(heavy, keys, "left_anti").select(*points.columns)
    light = _percentile_by_chunk(quiet, keys, percentile, ts, value, window_seconds, chunk_seconds, name)
    busy = points.join(heavy, keys, "left_semi")
    answers = sliding_quantile(busy, keys, percentile, ts, value, window_seconds, name)
    return light.unionByName(busy.join(answers, [*keys, ts]).select(*points.columns, name))


def _percentile_by_chunk(
    points: DataFrame, keys: list[str], percentile: str, ts: str, value: str, window_seconds: int, chunk_seconds: int, name: str
) -> DataFrame:
    """The sliding quantile costs log(window) per row instead of re-reading the frame."""
    chunked = with_halo(points, ts, chunk_seconds, before=window_seconds)
    schema = T.StructType(points.schema.fields + [T.StructField(name, T.DoubleType())])
    window, columns = f"{window_seconds}s", points.columns

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable").reset_index(drop=True)
        series = pdf.set_index(ts)[value]
        q = float(pdf[percentile].iloc[0]) / 100.0
        pdf[name] = series.rolling(window, closed="right").quantile(q, interpolation="linear").to_numpy()
        pdf[name] = pdf.groupby(ts)[name].transform("last")  # the window of an instant holds all its rows
        return pdf.loc[pdf["_own"], [*columns, name]]

    return chunked.groupBy(*keys, CHUNK).applyInPandas(slide, schema)


def pane_targets(points: DataFrame, interval_seconds: int = 300, window_seconds: int = 3600) -> DataFrame:
    """mean + 2 * population deviation of the trailing window at every tick.

    Points are first reduced to one row per (metric, pane); a tick at T combines
    the panes of [T - window, T).  Ticks without points give no row.
    """
    width = interval_seconds * MICROS
    pane = F.floor(micros("ts") / F.lit(width)).cast("bigint")
    panes = points.groupBy("name", pane.alias("pane")).agg(
        F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")
    )
    last = panes.groupBy("name").agg(F.max("pane").alias("last"))
    count = window_seconds // interval_seconds
    # a pane serves the ticks pane .. pane + count - 1 (tick number = last pane of its window)
    spread = panes.join(last, "name").withColumn(
        "tick", F.explode(F.sequence("pane", F.least(F.col("pane") + (count - 1), F.col("last"))))
    )
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    var = F.greatest(F.sum("ss") / n - mean * mean, F.lit(0.0))
    return spread.groupBy("name", "tick").agg((mean + 2 * F.sqrt(var)).alias("target")).withColumn(
        "tick_ts", from_micros((F.col("tick") + 1) * width)
    )


def window_target(points: DataFrame, keys: list[str]) -> DataFrame:
    """mean + 2 * population deviation of the given (already windowed) points."""
    return points.groupBy(*keys).agg(
        F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("std_value")
    ).withColumn("target", F.col("mean_value") + 2 * F.col("std_value"))


def adapt_thresholds(targets: DataFrame, config: DataFrame, ticks_per_chunk: int = 288) -> DataFrame:
    """Fold t <- clamp(t (1 - r) + r target, min, max) over the ticks of each adaptive metric.

    One step is a clamped line, and clamped lines compose to clamped lines, so
    the fold runs in parallel over chunks of ticks: compose each chunk, chain
    the chunk starts per metric, then replay inside every chunk.
    """
    c = config.filter(F.col("threshold_type") == "adaptive").select(
        "name", "value",
        F.coalesce("adaptation_rate", F.lit(0.1)).alias("rate"),
        F.coalesce("min_value", F.lit(-UNBOUNDED)).alias("lo"),
        F.coalesce("max_value", F.lit(UNBOUNDED)).alias("hi"),
    )
    chunk = F.floor(F.col("tick") / ticks_per_chunk).cast("bigint").alias("chunk")
    steps = targets.join(c, "name").groupBy("name", "value", "rate", "lo", "hi", chunk).agg(
        F.sort_array(F.collect_list(F.struct("tick", "tick_ts", "target"))).alias("ticks")
    )
    keep, rate, lo, hi = 1 - F.col("rate"), F.col("rate"), F.col("lo"), F.col("hi")
    line = lambda a, b, low, high: F.struct(a.alias("a"), b.alias("b"), low.alias("l"), high.alias("h"))
    composed = steps.withColumn("line", F.aggregate(
        "ticks", line(F.lit(1.0), F.lit(0.0), F.lit(-UNBOUNDED), F.lit(UNBOUNDED)),
        lambda f, s: line(
            keep * f["a"], keep * f["b"] + rate * s["target"],
            clamp(keep * f["l"] + rate * s["target"], lo, hi), clamp(keep * f["h"] + rate * s["target"], lo, hi),
        ),
    ))
    chained = composed.groupBy("name", "value").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "line"))).alias("lines")
    )
    start = F.struct(F.col("value").alias("t"), F.array().cast("array<struct<chunk:bigint,start:double>>").alias("starts"))
    follow = lambda acc, x: F.struct(
        clamp(x["line"]["a"] * acc["t"] + x["line"]["b"], x["line"]["l"], x["line"]["h"]).alias("t"),
        F.array_append(acc["starts"], F.struct(x["chunk"].alias("chunk"), acc["t"].alias("start"))).alias("starts"),
    )
    starts = chained.select("name", F.inline(F.aggregate("lines", start, follow)["starts"]))
    first = F.struct(
        F.col("start").alias("t"), F.array().cast("array<struct<tick:bigint,tick_ts:timestamp_ntz,threshold:double>>").alias("out")
    )

    def replay(acc: Column, s: Column) -> Column:
        t = clamp(keep * acc["t"] + rate * s["target"], lo, hi)
        return F.struct(t.alias("t"), F.array_append(acc["out"], F.struct(
            s["tick"].alias("tick"), s["tick_ts"].alias("tick_ts"), t.alias("threshold")
        )).alias("out"))

    return steps.join(starts, ["name", "chunk"]).select(
        "name", F.inline(F.aggregate("ticks", first, replay)["out"])
    )


def threshold_at(points: DataFrame, adapted: DataFrame, interval_seconds: int) -> DataFrame:
    """Attach the adaptive state in force at each point.

    Every adaptation holds until the next one of its metric; it is listed once
    per tick slot it covers, which makes the as-of lookup an equi join.
    """
    width = interval_seconds * MICROS
    slot = F.floor(micros("ts") / F.lit(width)).cast("bigint")
    ordered = Window.partitionBy("name").orderBy("tick")
    until = F.coalesce(F.lead("tick").over(ordered), F.col("tick") + 1)
    held = adapted.withColumn("until", until).select(
        "name", F.explode(F.sequence(F.col("tick") + 1, F.col("until"))).alias("slot"), F.col("threshold").alias("adaptive_value")
    )
    return points.withColumn("slot", slot).join(held, ["name", "slot"], "left").drop("slot")


def current_threshold(percentile_value: Column, adaptive_value: Column) -> Column:
    """Threshold in force by type."""
    kind, value = F.col("threshold_type"), F.col("value_limit")
    return (
        F.when(kind == "static", value)
        .when(kind == "time_based", time_based_value(F.col("ts"), F.col("time_windows"), value))
        .when(kind == "percentile", F.coalesce(percentile_value, value))
        .otherwise(F.coalesce(adaptive_value, value))
    )


def evaluate_points(
    points: DataFrame, config: DataFrame, tie_break: list[str], window_seconds: int = 3600, interval_seconds: int = 300
) -> DataFrame:
    """Every point with the threshold in force and whether it is violated."""
    adapted = adapt_thresholds(pane_targets(points, interval_seconds, window_seconds), config)
    limits = config.withColumnRenamed("value", "value_limit")
    joined = with_config(points, limits)
    # only metrics of percentile type pass through the sliding quantile
    sliding = joined.filter((F.col("threshold_type") == "percentile") & F.col("percentile").isNotNull())
    others = joined.filter(~((F.col("threshold_type") == "percentile") & F.col("percentile").isNotNull()))
    keep = [*points.columns, "percentile"]
    slid = trailing_percentile(sliding.select(*keep), ["name"], "percentile", window_seconds=window_seconds)
    slid = slid.drop("percentile").join(limits, "name")
    everything = threshold_at(
        slid.unionByName(others.withColumn("percentile_value", F.lit(None).cast("double"))), adapted, interval_seconds
    )
    limit = current_threshold(F.col("percentile_value"), F.col("adaptive_value"))
    return everything.withColumn("threshold", limit).withColumn(
        "violation", violates("operator", "value", "threshold")
    )


def running_violation_rate(evaluated: DataFrame, keys: list[str], tie_break: list[str]) -> DataFrame:
    """Violations over evaluations, up to and including each point."""
    out = running_total(evaluated, keys, "ts", tie_break, {
        "violations": F.col("violation").cast("bigint"), "evaluations": F.lit(1).cast("bigint"),
    })
    return out.withColumn("violation_rate", F.col("violations") / F.col("evaluations"))


def threshold_status(config: DataFrame, evaluated: DataFrame, adapted: DataFrame) -> DataFrame:
    """One report row per configured metric."""
    rates = evaluated.groupBy("name").agg(F.avg(F.col("violation").cast("double")).alias("rate"))
    newest = Window.partitionBy("name").orderBy(F.col("tick").desc())
    recent = (
        adapted.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= 5)
        .groupBy("name").agg(F.sort_array(F.collect_list(F.struct("tick_ts", "threshold"))).alias("adaptations"))
    )
    return config.join(rates, "name", "left").join(recent, "name", "left").select(
        "name", "threshold_type", "operator",
        F.coalesce(F.try_element_at("adaptations", F.lit(-1))["threshold"], F.col("value")).alias("current_value"),
        F.col("value").alias("original_value"),
        F.coalesce("rate", F.lit(0.0)).alias("violation_rate"),
        F.coalesce("adaptations", F.array().cast("array<struct<tick_ts:timestamp_ntz,threshold:double>>")).alias("adaptations"),
    )


def held_alerts(
    points: DataFrame, keys: list[str], tie_break: list[str], condition: Column, duration_seconds: int,
) -> DataFrame:
    """Runs of consecutive points under ``condition`` that last at least the duration."""
    flagged = points.withColumn("bad", F.coalesce(condition, F.lit(False)))
    # neighbours under the condition have the same number of other rows before them
    numbered = running_total(flagged, keys, "ts", tie_break, {"run": (~F.col("bad")).cast("bigint")})
    runs = numbered.filter("bad").groupBy(*keys, "run").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_points")
    )
    lasted = (micros("end_ts") - micros("start_ts")) / F.lit(float(MICROS))
    return runs.withColumn("held_seconds", lasted).filter(F.col("held_seconds") >= duration_seconds).drop("run")
