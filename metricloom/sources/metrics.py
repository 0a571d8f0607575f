"""Metric point tables: scan, filter, append, retain, delete."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.scalars import all_of, col, parse_iso, seconds_between

# The seven known metrics (name, type, unit, required labels).
METRIC_DEFINITIONS = [
    ("system_cpu_usage_percent", "gauge", "percent", ["hostname"]),
    ("system_memory_usage_percent", "gauge", "percent", ["hostname"]),
    ("system_disk_usage_percent", "gauge", "percent", ["hostname", "mount_point"]),
    ("container_cpu_usage_percent", "gauge", "percent", ["container_id", "container_name"]),
    ("container_memory_usage_percent", "gauge", "percent", ["container_id", "container_name"]),
    ("container_network_receive_bytes", "counter", "bytes", ["container_id", "container_name", "interface"]),
    ("container_network_transmit_bytes", "counter", "bytes", ["container_id", "container_name", "interface"]),
]


def metric_definitions(spark: SparkSession) -> DataFrame:
    """The metric registry as a table."""
    return spark.createDataFrame(
        METRIC_DEFINITIONS, "name string, metric_type string, unit string, required array<string>"
    )


def scan_points(records: DataFrame, ts: str = "ts", names: Iterable[str] | None = None) -> DataFrame:
    """Long records with ``ts`` parsed from text where needed, and an optional name list."""
    if dict(records.dtypes)[ts] == "string":
        records = records.withColumn(ts, parse_iso(ts))
    if names is not None:
        records = records.filter(F.col("name").isin(list(names)))
    return records


def read_range(
    points: DataFrame,
    name: str | Iterable[str],
    start: str,
    stop: str,
    labels: Mapping[str, str] | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Points of the named series with start <= ts < stop and all given labels.

    On a table written by :func:`append_points` the name and date conditions
    prune partitions; the time condition reaches the parquet scan.
    """
    names = [name] if isinstance(name, str) else list(name)
    out = points.filter(F.col("name").isin(names)).filter(
        (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(stop).cast("timestamp_ntz"))
    )
    if "date" in points.columns:
        out = out.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(stop).cast("date")))
    return out.filter(labels_match("labels", labels)) if labels else out


def labels_match(labels: Column | str, wanted: Mapping[str, str]) -> Column:
    """True when every wanted label is present with the wanted value."""
    return all_of(*[
        F.coalesce(F.try_element_at(col(labels), F.lit(k)) == F.lit(v), F.lit(False))
        for k, v in wanted.items()
    ])


def filter_points(points: DataFrame, prefix: str | None = None, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Name prefix and label equality, each optional."""
    if prefix:
        points = points.filter(F.col("name").startswith(prefix))
    return points.filter(labels_match("labels", labels)) if labels else points


def append_points(points: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to the point table, laid out by name and day.

    The rebalance hint lets AQE split a hot (name, day) over several files and
    merge small ones, so one busy metric does not become one writer task.
    """
    (
        points.withColumn("date", F.col(ts).cast("date"))
        .hint("rebalance", F.col("name"), F.col("date"))
        .write.mode("append")
        .partitionBy("name", "date")
        .parquet(path)
    )


def system_metrics_long(wide: DataFrame, ts: str, hostname: str, metrics: list[str]) -> DataFrame:
    """Wide host samples to long points named ``system_*`` with a hostname label."""
    return (
        wide.unpivot([ts, hostname], metrics, "metric", "value")
        .select(
            F.col(ts).alias("ts"),
            F.concat(F.lit("system_"), "metric").alias("name"),
            F.col("value").cast("double").alias("value"),
            F.create_map(F.lit("hostname"), F.col(hostname).cast("string")).alias("labels"),
        )
    )


def retain(df: DataFrame, ts: str, now: Column, max_age_seconds: int, inclusive: bool = True) -> DataFrame:
    """Keep rows not older than ``max_age_seconds`` at ``now``."""
    age = seconds_between(ts, now)
    return df.filter(age <= max_age_seconds if inclusive else age < max_age_seconds)


def delete_range(
    points: DataFrame, name: str, start: str, stop: str, labels: Mapping[str, str] | None = None, ts: str = "ts"
) -> DataFrame:
    """All points except those the range-and-label predicate selects."""
    hit = all_of(
        F.col("name") == name,
        F.col(ts) >= F.lit(start).cast("timestamp_ntz"),
        F.col(ts) < F.lit(stop).cast("timestamp_ntz"),
        labels_match("labels", labels) if labels else F.lit(True),
    )
    return points.filter(~F.coalesce(hit, F.lit(False)))
