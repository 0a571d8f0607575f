"""Window functions over raw points, split along time so that hot keys spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import cpu_percent, seconds_between
from metricloom.operators.chunks import CHUNK, CHUNK_ROWS, DAY, positions, previous_values, running_total, with_row_halo


def moving_average(
    points: DataFrame, keys: list[str], tie_break: list[str], width: int = 5, size: int = 100_000
) -> DataFrame:
    """Mean of the last ``width`` rows; rows before the first complete window are dropped."""
    placed = positions(points, keys, "ts", tie_break)
    chunked = with_row_halo(placed, keys, "position", before=width - 1, size=size)
    frame = Window.partitionBy(*keys, CHUNK).orderBy("position").rowsBetween(-(width - 1), 0)
    return (
        chunked.withColumn("moving_avg", F.avg("value").over(frame))
        .filter(F.col("_own") & (F.col("position") >= width - 1))
        .drop(CHUNK, "_own")
    )


def global_anomalies(points: DataFrame, keys: list[str], threshold: float = 2.0) -> DataFrame:
    """Rows whose population z-score within the key exceeds the threshold.

    Statistics come from a partial aggregate joined back, not from a window
    over the whole key.  A constant series has no anomalies.
    """
    stats = points.groupBy(*keys).agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    z = F.try_divide(F.col("value") - F.col("_mean"), F.col("_std"))
    return points.join(stats, keys).withColumn("z", z).filter(F.abs("z") > threshold).drop("_mean", "_std")


def min_max_normalise(points: DataFrame, keys: list[str]) -> DataFrame:
    """Scale values to [0, 1] within the key; a constant series becomes 0.5."""
    stats = points.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.5)).otherwise(
        F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    )
    return points.join(stats, keys).withColumn("normalised", scaled).drop("_lo", "_hi")


def latest_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest ``n`` rows per key.

    Spark limits each group before the shuffle (WindowGroupLimit), so a task
    receives at most n rows per key and map task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(ranked)).filter(F.col("_rn") <= n).drop("_rn")


def counter_cpu_percent(
    counters: DataFrame, keys: list[str], tie_break: list[str], cpu: str = "cpu_total", system: str = "system_total"
) -> DataFrame:
    """CPU percent from cumulative counters of neighbouring samples."""
    both = previous_values(counters, keys, "ts", tie_break, {"_cpu": cpu, "_system": system})
    percent = cpu_percent(F.col(cpu) - F.col("_cpu"), F.col(system) - F.col("_system"))
    return both.withColumn("cpu_percent", percent).drop("_cpu", "_system")


def autocorrelation(grid: DataFrame, lag: int = 60, value: str = "filled", threshold: float = 0.7) -> DataFrame:
    """Pearson correlation of a series with itself ``lag`` grid rows earlier."""
    ordered = Window.partitionBy("name").orderBy("i")
    paired = grid.withColumn("_x", F.lag(value, lag).over(ordered))
    x = F.when(F.col(value).isNotNull(), F.col("_x"))
    y = F.when(F.col("_x").isNotNull(), F.col(value))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    out = paired.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"), r.alias("acf"))
    enough = F.col("n_rows") >= 2 * lag
    return out.withColumn("acf", F.when(enough, F.col("acf"))).withColumn(
        "seasonal", F.coalesce(F.abs("acf") > threshold, F.lit(False))
    )


def trailing_count(
    events: DataFrame, keys: list[str], ts: str, seconds: int, name: str = "n_recent", chunk_seconds: int = DAY, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Number of rows of the key in [ts - seconds, ts].

    Rows are first counted by instant.  The count up to an instant less the count
    before the start of its window is the answer; both are running totals over the
    instants and the starts in common order, so nothing is copied into windows.
    """
    instants = events.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    starts = instants.select(*keys, F.col(ts).alias("_asked"), F.expr(f"{ts} - INTERVAL {seconds} SECONDS").alias("_at"), F.lit(0).cast("bigint").alias("_n"), F.lit(0).alias("_kind"))
    ends = instants.select(*keys, F.col(ts).alias("_asked"), F.col(ts).alias("_at"), "_n", F.lit(1).alias("_kind"))
    # a start comes before the rows of its own instant: they are inside the window
    total = running_total(starts.unionByName(ends), keys, "_at", ["_kind", "_asked"], {"_total": F.col("_n")}, chunk_seconds, rows)
    signed = F.when(F.col("_kind") == 1, F.col("_total")).otherwise(-F.col("_total"))
    counts = total.groupBy(*keys, F.col("_asked").alias(ts)).agg(F.sum(signed).alias(name))
    return events.join(counts, [*keys, ts])


def training_window(points: DataFrame, keys: list[str], seconds: int = 7 * DAY) -> DataFrame:
    """Points newer than the key's last timestamp minus the training window."""
    last = points.groupBy(*keys).agg(F.max("ts").alias("_last"))
    return points.join(last, keys).filter(seconds_between("ts", "_last") < seconds).drop("_last")


def sliding_sequences(grid: DataFrame, length: int = 24, value: str = "filled") -> DataFrame:
    """Windows of ``length`` consecutive grid values; the last full window is not used."""
    ordered = Window.partitionBy("name").orderBy("i")
    frame = ordered.rowsBetween(-(length - 1), 0)
    return (
        grid.withColumns({
            "sequence": F.collect_list(value).over(frame),
            "_next": F.lead("i").over(ordered),
        })
        .filter((F.size("sequence") == length) & F.col("_next").isNotNull())
        .drop("_next")
    )
