"""Nested container statistics to long metric points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import cpu_percent, memory_percent

NETWORK_COUNTERS = ["rx_bytes", "tx_bytes", "rx_packets", "tx_packets"]


def flatten_stats(stats: DataFrame) -> DataFrame:
    """One long row per metric of each stats document.

    Everything is row-local: the metrics of a document are gathered in one map
    expression and exploded, so no shuffle happens.
    """
    cpu, pre, mem = F.col("cpu_stats"), F.col("precpu_stats"), F.col("memory_stats")
    double = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    fixed = F.array(
        F.struct(
            F.lit("cpu_usage_percent").alias("metric"),
            cpu_percent(
                cpu["total_usage"] - pre["total_usage"],
                cpu["system_cpu_usage"] - pre["system_cpu_usage"],
            ).alias("value"),
        ),
        F.struct(F.lit("cpu_system_usage").alias("metric"), double(cpu["system_cpu_usage"]).alias("value")),
        F.struct(F.lit("cpu_online_cpus").alias("metric"), double(cpu["online_cpus"]).alias("value")),
        F.struct(F.lit("memory_usage").alias("metric"), double(mem["usage"]).alias("value")),
        F.struct(F.lit("memory_limit").alias("metric"), double(mem["limit"]).alias("value")),
        F.struct(F.lit("memory_percent").alias("metric"), memory_percent(mem["usage"], mem["limit"]).alias("value")),
    )
    network = F.flatten(F.transform(
        F.map_entries("networks"),
        lambda e: F.array(*[
            F.struct(
                F.concat(F.lit("network_"), e["key"], F.lit(f"_{c}")).alias("metric"),
                e["value"][c].cast("double").alias("value"),
            )
            for c in NETWORK_COUNTERS
        ]),
    ))

    def last_of(op: str):
        hits = F.filter("blkio", lambda s: F.lower(s["op"]) == op)
        return F.transform(
            F.slice(hits, -1, 1),
            lambda s: F.struct(F.lit(f"blkio_{op}_bytes").alias("metric"), double(s["value"]).alias("value")),
        )

    def none_if_empty(op: str):
        hits = F.filter("blkio", lambda s: F.lower(s["op"]) == op)
        return F.when(F.size(hits) > 0, last_of(op))

    empty = F.filter(fixed, lambda s: F.lit(False))
    parts = [fixed, network, none_if_empty("read"), none_if_empty("write")]
    everything = F.concat(*[F.coalesce(p, empty) for p in parts])
    return (
        stats.withColumn("_m", F.explode(everything))
        .select(
            "ts",
            F.concat(F.lit("container_"), F.col("_m.metric")).alias("name"),
            F.col("_m.value").alias("value"),
            F.create_map(
                F.lit("container_id"), F.col("container_id"),
                F.lit("container_name"), F.col("container_name"),
                F.lit("image"), F.coalesce("image", F.lit("unknown")),
            ).alias("labels"),
        )
    )


def container_changes(before: DataFrame, after: DataFrame, key: str = "container_id") -> DataFrame:
    """Containers that appeared in or vanished from the running set."""
    b, a = before.select(key).distinct(), after.select(key).distinct()
    started = a.join(b, key, "left_anti").withColumn("change", F.lit("started"))
    stopped = b.join(a, key, "left_anti").withColumn("change", F.lit("stopped"))
    return started.unionByName(stopped)
