"""Trend, seasonality, anomaly and correlation detectors over the regular grid.

Windows here are partitioned by metric over grid rows: their number is the
time span divided by the step, whatever the number of raw points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import seconds_between
from metricloom.operators.prepare import regular_grid

# Default detector parameters.
TREND_THRESHOLD = 0.1
SEASONALITY_THRESHOLD = 0.2
ANOMALY_THRESHOLD = 2.0
CORRELATION_THRESHOLD = 0.8
ROLLING_ROWS = 60
PERIOD = 60


# Texts of descriptions and suggestions.
def trend_suggestion(name: Column, rising: Column) -> Column:
    lower = F.lower(name)
    return (
        F.when(lower.contains("cpu"), F.when(rising, "Consider scaling up CPU resources")
               .otherwise("Consider scaling down CPU resources"))
        .when(lower.contains("memory"), F.when(rising, "Consider increasing memory allocation")
              .otherwise("Consider decreasing memory allocation"))
        .otherwise(F.concat(
            F.lit("Monitor "), name, F.lit(" for continued "),
            F.when(rising, "increasing").otherwise("decreasing"), F.lit(" trend"),
        ))
    )


def seasonality_suggestion(name: Column) -> Column:
    return F.concat(
        F.lit("Consider implementing predictive scaling for "), name, F.lit(" based on seasonal pattern")
    )


def anomaly_suggestion(name: Column, severity: Column) -> Column:
    return F.when(
        severity > 3.0, F.concat(F.lit("Urgent: Investigate abnormal behavior in "), name)
    ).otherwise(F.concat(F.lit("Monitor "), name, F.lit(" for continued anomalies")))


def correlation_suggestion(a: Column, b: Column) -> Column:
    return F.concat(F.lit("Consider joint scaling strategy for "), a, F.lit(" and "), b)


def _pattern(kind: str, confidence: Column, metrics: Column, description: Column, severity: Column, suggestion: Column):
    return [
        F.lit(kind).alias("type"),
        F.least(confidence, F.lit(1.0)).alias("confidence"),
        F.col("start_ts"), F.col("end_ts"),
        metrics.alias("metrics"),
        description.alias("description"),
        severity.alias("severity"),
        suggestion.alias("suggested_action"),
    ]


def trend_slopes(grid: DataFrame) -> DataFrame:
    """Least-squares slope per grid step; none for a metric with leading gaps."""
    return (
        grid.groupBy("name")
        .agg(
            F.regr_slope("filled", F.col("i").cast("double")).alias("slope"),
            F.min("h").alias("start_ts"), F.max("h").alias("end_ts"),
            (F.count("filled") == F.count(F.lit(1))).alias("whole"),
        )
        .filter("whole").drop("whole")
    )


def trends(grid: DataFrame, threshold: float = TREND_THRESHOLD) -> DataFrame:
    name, slope = F.col("name"), F.col("slope")
    rising = slope > 0
    label = F.when(rising, "Increasing").otherwise("Decreasing")
    return trend_slopes(grid).filter(F.abs(slope) > threshold).select(*_pattern(
        "trend", F.abs(slope) * 2, F.array(name),
        F.concat(label, F.lit(" trend detected in "), name), F.abs(slope), trend_suggestion(name, rising),
    ))


def centered_average(grid: DataFrame, period: int, value: str = "filled") -> DataFrame:
    """Centered moving average over one period; an even period has half-weight ends."""
    half = period // 2
    ordered = Window.partitionBy("name").orderBy("i")
    frame = ordered.rowsBetween(-half, half)
    total = F.sum(value).over(frame)
    if period % 2 == 0:
        total = total - (F.lag(value, half).over(ordered) + F.lead(value, half).over(ordered)) / 2
    complete = F.count(value).over(frame) == 2 * half + 1
    return grid.withColumn("center", F.when(complete, total / period))


def seasonal_strength(grid: DataFrame, period: int = PERIOD) -> DataFrame:
    """std(seasonal) / std(series) of an additive decomposition, per metric.

    Only metrics with two whole periods and no gap at the start qualify.
    """
    phase = F.pmod(F.col("i"), F.lit(period)).alias("phase")
    per_phase = centered_average(grid, period).groupBy("name", phase).agg(
        F.avg(F.col("filled") - F.col("center")).alias("m"),
        F.count(F.lit(1)).alias("c"),
        F.count("filled").alias("known"),
        F.avg("filled").alias("x_mean"),
        F.var_pop("filled").alias("x_var"),
        F.min("h").alias("first_h"), F.max("h").alias("last_h"),
    )
    whole = Window.partitionBy("name")
    shaped = per_phase.withColumns({
        "s": F.col("m") - F.avg("m").over(whole),
        "mean": F.sum(F.col("c") * F.col("x_mean")).over(whole) / F.sum("c").over(whole),
    })
    n = F.sum("c")
    mean_s = F.sum(F.col("c") * F.col("s")) / n
    var_s = F.sum(F.col("c") * F.col("s") * F.col("s")) / n - mean_s * mean_s
    gap = F.col("x_mean") - F.col("mean")
    var_x = F.sum(F.col("c") * (F.col("x_var") + gap * gap)) / n
    return (
        shaped.groupBy("name")
        .agg(
            F.try_divide(F.sqrt(F.greatest(var_s, F.lit(0.0))), F.sqrt(var_x)).alias("strength"),
            F.min("first_h").alias("start_ts"), F.max("last_h").alias("end_ts"),
            ((n >= 2 * period) & (F.sum("known") == n)).alias("whole"),
        )
        .filter("whole").drop("whole")
    )


def seasonality(grid: DataFrame, period: int = PERIOD, threshold: float = SEASONALITY_THRESHOLD) -> DataFrame:
    name, strength = F.col("name"), F.col("strength")
    return seasonal_strength(grid, period).filter(strength > threshold).select(*_pattern(
        "seasonality", strength * 2, F.array(name),
        F.concat(F.lit("Seasonal pattern detected in "), name), strength, seasonality_suggestion(name),
    ))


def rolling_stats(grid: DataFrame, rows: int = ROLLING_ROWS, value: str = "filled") -> DataFrame:
    """Mean and sample deviation over the last ``rows`` grid rows, null until complete."""
    frame = Window.partitionBy("name").orderBy("i").rowsBetween(-(rows - 1), 0)
    complete = F.count(value).over(frame) == rows
    return grid.withColumns({
        "rolling_mean": F.when(complete, F.avg(value).over(frame)),
        "rolling_std": F.when(complete, F.stddev_samp(value).over(frame)),
    })


def rolling_anomalies(grid: DataFrame, threshold: float = ANOMALY_THRESHOLD, rows: int = ROLLING_ROWS) -> DataFrame:
    """Grid rows with their rolling z-score and an anomaly flag."""
    z = F.try_divide(F.col("filled") - F.col("rolling_mean"), F.col("rolling_std"))
    return (
        rolling_stats(grid, rows)
        .withColumn("z", z)
        .withColumn("anomalous", F.coalesce(F.abs("z") > threshold, F.lit(False)))
    )


def anomaly_ranges(flagged: DataFrame, step_seconds: int) -> DataFrame:
    """Merge consecutive anomalous rows: [first anomalous, first normal), last bucket at the end."""
    run = Window.partitionBy("name", "anomalous").orderBy("i")
    everything = Window.partitionBy("name")
    return (
        flagged.withColumns({
            "island": F.col("i") - F.row_number().over(run),
            "last_h": F.max("h").over(everything),
        })
        .filter("anomalous")
        .groupBy("name", "island")
        .agg(
            F.min("h").alias("start_ts"),
            F.least(F.max("h") + F.expr(f"INTERVAL {step_seconds} SECONDS"), F.first("last_h")).alias("end_ts"),
            F.max(F.abs("z")).alias("severity"),
        )
        .drop("island")
    )


def anomalies(grid: DataFrame, step_seconds: int, threshold: float = ANOMALY_THRESHOLD, rows: int = ROLLING_ROWS) -> DataFrame:
    name, severity = F.col("name"), F.col("severity")
    return anomaly_ranges(rolling_anomalies(grid, threshold, rows), step_seconds).select(*_pattern(
        "anomaly", severity / threshold, F.array(name),
        F.concat(F.lit("Anomaly detected in "), name), severity, anomaly_suggestion(name, severity),
    ))


#: Columns of a block, and rows multiplied at once.
BLOCK, STRIP = 256, 512
_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")
_PARTS = "bi int, bj int, i int, shift_a double, shift_b array<double>, " + ", ".join(f"{c} array<double>" for c in _SUMS)


def _reshifted(sums: np.ndarray, da: np.ndarray, db: np.ndarray) -> np.ndarray:
    """The six sums of (a, b) once ``da`` is added to every a and ``db`` to every b."""
    n, sa, sb, saa, sbb, sab = sums
    return np.stack([n, sa + n * da, sb + n * db, saa + da * (2 * sa + n * da), sbb + db * (2 * sb + n * db), sab + da * sb + db * (sa + n * da)])


def _block_sums(width: int, block: int):
    """Sums of products of two blocks of columns, null pairs left out: one row per
    column of the first block whenever the pair of blocks changes."""
    def side(at: pd.Series, values: pd.Series, first: int, wide: int) -> np.ndarray:
        x = np.full((len(at), wide), np.nan)
        for row, (where, what) in enumerate(zip(at, values)):
            x[row, np.asarray(where, int) - first] = what
        return x

    def shifted(x: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = ~np.isnan(x)
        new = np.isnan(shift) & known.any(axis=0)
        shift[new] = np.nanmean(x[:, new], axis=0) if new.any() else 0.0
        return np.where(known, x - np.where(np.isnan(shift), 0.0, shift), 0.0), known.astype(float)

    def rows(key: tuple[int, int], sums: np.ndarray, shift_a: np.ndarray, shift_b: np.ndarray) -> pd.DataFrame:
        met = np.flatnonzero(sums[0].any(axis=1))
        shift_a, shift_b = np.nan_to_num(shift_a), np.nan_to_num(shift_b)
        return pd.DataFrame({
            "bi": key[0], "bj": key[1], "i": key[0] * block + met, "shift_a": shift_a[met], "shift_b": [shift_b] * len(met),
        } | {c: list(sums[k][met]) for k, c in enumerate(_SUMS)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for df in frames:
            for pair, of_pair in df.groupby(["bi", "bj"]):
                if pair != key:
                    if key is not None:
                        yield rows(key, sums, shift_a, shift_b)
                    key = pair
                    wide = [min(block, width - k * block) for k in key]
                    sums, shift_a, shift_b = np.zeros((6, *wide)), np.full(wide[0], np.nan), np.full(wide[1], np.nan)
                for start in range(0, len(of_pair), STRIP):
                    strip = of_pair.iloc[start : start + STRIP]
                    a, ka = shifted(side(strip["a_at"], strip["a_x"], key[0] * block, wide[0]), shift_a)
                    b, kb = shifted(side(strip["b_at"], strip["b_x"], key[1] * block, wide[1]), shift_b)
                    sums += np.stack([ka.T @ kb, a.T @ kb, ka.T @ b, (a * a).T @ kb, ka.T @ (b * b), a.T @ b])
        if key is not None:
            yield rows(key, sums, shift_a, shift_b)
    return run


def _merged(names: list[str], block: int, threshold: float | None):
    """Adds up the sums of one column against one block, rows sorted by them, and
    yields the correlations of its pairs, with a threshold only those above it."""
    def pairs(key: tuple[int, int], shift_a: float, shift_b: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
        i, bj = key
        j = bj * block + np.arange(sums.shape[1])
        ok = (j > i) & (sums[0] > 0)
        j, (n, sa, sb, saa, sbb, sab) = j[ok], sums[:, ok]
        va, vb = saa - sa * sa / n, sbb - sb * sb / n
        # what rounding leaves of a constant counts as none
        varies = (va > (shift_a * 1e-12) ** 2 * n) & (vb > (shift_b[ok] * 1e-12) ** 2 * n)
        r = np.full(len(j), np.nan)
        r[varies] = (sab - sa * sb / n)[varies] / np.sqrt(va[varies] * vb[varies])
        keep = varies if threshold is None else varies & (np.abs(np.nan_to_num(r)) > threshold)
        both = {"metric_a": [names[i]] * int(keep.sum()), "metric_b": [names[k] for k in j[keep]]}
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in both.items()} | {"r": r[keep]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for df in frames:
            for row in df.itertuples(index=False):
                shift_b, own = np.asarray(row.shift_b, float), np.stack([np.asarray(getattr(row, c), float) for c in _SUMS])
                if key == (row.i, row.bj):
                    sums += _reshifted(own, row.shift_a - at_a, shift_b - at_b)
                    continue
                if key is not None:
                    yield pairs(key, at_a, at_b, sums)
                key, at_a, at_b, sums = (row.i, row.bj), row.shift_a, shift_b, own
        if key is not None:
            yield pairs(key, at_a, at_b, sums)
    return run


def block_pair_rows(times: DataFrame, blocks: int, block: int) -> DataFrame:
    """(bi, bj, a, b): the values of each time, once for every two blocks of
    columns.  Pairs of blocks are dealt over tasks, each pair in several slices."""
    if blocks == 1:
        return times.select(F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.col("p").alias("a"), F.col("p").alias("b"))
    of = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(
        k.alias("k"), F.filter("p", lambda x: F.floor(x["at"] / block) == k).alias("p")))
    cut = times.select("h", F.filter(of, lambda x: F.size(x["p"]) > 0).alias("of"))
    first = cut.select("h", "of", F.explode("of").alias("s"))
    both = first.select("h", "s", F.explode(F.filter("of", lambda x: x["k"] >= F.col("s.k"))).alias("t"))
    rows = both.select(F.col("s.k").alias("bi"), F.col("t.k").alias("bj"), F.col("s.p").alias("a"), F.col("t.p").alias("b"), "h")
    tasks = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-2 * tasks // (blocks * (blocks + 1))))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("h"), F.lit(slices))).repartition("bi", "bj", "slice")
    return dealt.sortWithinPartitions("bi", "bj").select("bi", "bj", "a", "b")


def pair_correlations(grid: DataFrame, names: list[str], threshold: float | None = None, block: int = BLOCK) -> DataFrame:
    """Pearson correlation of every metric pair, over rows where both are known.

    Values of one time are gathered into a row (as many as configured metrics).
    Columns are cut into blocks; a task multiplies two blocks at a time, shifted by
    a mean of their own, and hands on one row per column and block, so it never
    holds a matrix of all metrics.  Those rows are added up by column, and with a
    ``threshold`` only pairs above it leave that step.  The plan does not grow with
    the number of metrics.  A constant series has no correlation (null), nor have
    metrics that are never known together; both are above no threshold.
    """
    names = sorted(names)
    spark = grid.sparkSession
    index = spark.createDataFrame(list(enumerate(names)), "at int, name string")
    rows = grid.filter(F.col("name").isin(names)).select("name", "h", F.col("filled").cast("double").alias("x"))
    span = rows.agg(F.min("h").alias("start_ts"), F.max("h").alias("end_ts"))
    known = rows.filter(F.col("x").isNotNull()).join(index, "name")
    times = known.groupBy("h").agg(F.collect_list(F.struct("at", "x")).alias("p"))
    lists = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in ("at", "x")]
    parts = block_pair_rows(times, -(-len(names) // block), block).select("bi", "bj", *lists).mapInPandas(_block_sums(len(names), block), _PARTS)
    found = parts.repartition("i", "bj").sortWithinPartitions("i", "bj").mapInPandas(_merged(names, block, threshold), "metric_a string, metric_b string, r double")
    if threshold is None:
        first = index.select(F.col("name").alias("metric_a"), F.explode(F.sequence(F.col("at") + 1, F.lit(len(names)))).alias("at"))
        pairs = first.join(index, "at").select("metric_a", F.col("name").alias("metric_b"))
        found = pairs.join(found, ["metric_a", "metric_b"], "left")
    ends = span.select(F.struct("start_ts", "end_ts")).scalar()
    return found.select(ends["start_ts"].alias("start_ts"), ends["end_ts"].alias("end_ts"), "metric_a", "metric_b", "r")


def correlations(grid: DataFrame, names: list[str], threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    a, b, r = F.col("metric_a"), F.col("metric_b"), F.abs("r")
    return pair_correlations(grid, names, threshold).select(*_pattern(
        "correlation", r, F.array(a, b),
        F.concat(F.lit("Strong correlation between "), a, F.lit(" and "), b), r, correlation_suggestion(a, b),
    ))


def detect_patterns(
    points: DataFrame, names: list[str], step_seconds: int = 60, period: int = PERIOD, rows: int = ROLLING_ROWS,
    trend: float = TREND_THRESHOLD, season: float = SEASONALITY_THRESHOLD,
    anomaly: float = ANOMALY_THRESHOLD, correlation: float = CORRELATION_THRESHOLD,
) -> DataFrame:
    """All four detectors in one pattern table.

    The four branches share the resampling exchange, which Spark reuses.
    """
    grid = regular_grid(points, step_seconds)
    return (
        trends(grid, trend)
        .unionByName(seasonality(grid, period, season))
        .unionByName(anomalies(grid, step_seconds, anomaly, rows))
        .unionByName(correlations(grid, names, correlation))
    )


def recent_patterns(
    patterns: DataFrame, now: Column, window_seconds: int = 3600, kind: str | None = None,
    metric: str | None = None, min_confidence: float = 0.0,
) -> DataFrame:
    """Patterns that ended less than ``window_seconds`` ago, with optional filters."""
    out = patterns.filter(seconds_between("end_ts", now) < window_seconds).filter(F.col("confidence") >= min_confidence)
    if kind:
        out = out.filter(F.col("type") == kind)
    return out.filter(F.array_contains("metrics", metric)) if metric else out
