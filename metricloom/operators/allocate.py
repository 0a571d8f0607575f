"""Resource allocation: objective, grid search, scores and recommendations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import clamp
from metricloom.operators.quality import messages, steady

# Weights of the strategies (performance, resource, risk).
STRATEGIES = [
    ("conservative", 0.4, 0.2, 0.4),
    ("aggressive", 0.6, 0.3, 0.1),
    ("balanced", 0.4, 0.3, 0.3),
    ("cost_focused", 0.2, 0.6, 0.2),
    ("performance_focused", 0.7, 0.1, 0.2),
]


@dataclass(frozen=True)
class Limits:
    """Bounds and steps of an allocation, costs and targets."""

    min_cpu: float = 0.1
    max_cpu: float = 4.0
    step_cpu: float = 0.1
    min_memory: float = 128.0
    max_memory: float = 8192.0
    step_memory: float = 64.0
    headroom: float = 0.2
    cpu_cost: float = 1.0
    memory_cost: float = 1.0
    target_response: float = 100.0

    def cpu_steps(self) -> int:
        return int(round((self.max_cpu - self.min_cpu) / self.step_cpu))

    def memory_steps(self) -> int:
        return int(round((self.max_memory - self.min_memory) / self.step_memory))


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRATEGIES, "strategy string, w_perf double, w_res double, w_risk double")


def with_strategies(demand: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Each demand row once per strategy; row-local."""
    chosen = [s for s in STRATEGIES if names is None or s[0] in names]
    options = F.array(*[
        F.struct(F.lit(n).alias("strategy"), F.lit(p).alias("w_perf"), F.lit(r).alias("w_res"), F.lit(k).alias("w_risk"))
        for n, p, r, k in chosen
    ])
    return demand.select("*", F.inline(options))


def _usage() -> tuple[Column, Column]:
    return F.coalesce("cpu_usage", F.lit(0.0)), F.coalesce("memory_usage", F.lit(0.0))


def estimated_response(cpu: Column, memory: Column, limits: Limits) -> Column:
    """Response time scaled by the tighter resource; an unknown one counts as 100."""
    cpu_usage, memory_usage = _usage()
    base = F.coalesce("response_time", F.lit(100.0))
    return base * F.greatest(cpu_usage / cpu, memory_usage / memory)


def resource_cost(cpu: Column, memory: Column, limits: Limits) -> Column:
    return cpu * limits.cpu_cost + memory * limits.memory_cost


def headroom(cpu: Column, memory: Column) -> Column:
    cpu_usage, memory_usage = _usage()
    return F.least((cpu - cpu_usage) / cpu, (memory - memory_usage) / memory)


def risk_cost(cpu: Column, memory: Column) -> Column:
    peak = F.coalesce(F.array_max("predicted"), F.lit(None).cast("double"))
    return -headroom(cpu, memory) + F.when(peak.isNotNull(), F.greatest(F.lit(0.0), peak - cpu)).otherwise(F.lit(0.0))


def objective(cpu: Column, memory: Column, limits: Limits) -> Column:
    """Weighted performance, resource and risk cost of an allocation."""
    over = F.greatest(F.lit(0.0), estimated_response(cpu, memory, limits) - limits.target_response)
    return (
        F.col("w_perf") * over * over
        + F.col("w_res") * resource_cost(cpu, memory, limits)
        + F.col("w_risk") * risk_cost(cpu, memory)
    )


def best_allocation(demand: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Cheapest grid point per demand row that leaves the headroom; null when none does.

    The search is row-local: the grid is a fixed pair of sequences, walked inside
    the row, so demand rows neither multiply nor shuffle.
    """
    cpu_usage, memory_usage = _usage()
    at_cpu = lambda i: limits.min_cpu + i * limits.step_cpu
    at_memory = lambda j: limits.min_memory + j * limits.step_memory
    first_cpu = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(limits.cpu_steps())), at_cpu), lambda c: c - cpu_usage - limits.headroom >= 0
    )
    first_memory = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(limits.memory_steps())), at_memory),
        lambda m: m - memory_usage - limits.headroom >= 0,
    )
    out = demand.withColumns({"_cpus": first_cpu, "_memories": first_memory})
    per_cpu = F.transform("_cpus", lambda c: F.array_min(F.transform("_memories", lambda m: F.struct(
        objective(c, m, limits).alias("cost"), c.alias("cpu_allocation"), m.alias("memory_allocation")
    ))))
    # unpacked by a generator, so that later expressions do not repeat the search
    nothing = F.struct(*[
        F.lit(None).cast("double").alias(c) for c in ("cost", "cpu_allocation", "memory_allocation")
    ])
    return out.select(*demand.columns, F.inline(F.array(F.coalesce(F.array_min(per_cpu), nothing))))


def score_allocation(allocated: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Confidence, predicted performance, savings and risk of each allocation.

    ``accuracy`` is the recent accuracy (see :func:`recent_accuracy`); missing counts as 1.
    """
    cpu, memory = F.col("cpu_allocation"), F.col("memory_allocation")
    cpu_usage, memory_usage = _usage()
    accuracy = F.coalesce("accuracy", F.lit(1.0)) if "accuracy" in allocated.columns else F.lit(1.0)
    saved = resource_cost(cpu_usage, memory_usage, limits) - resource_cost(cpu, memory, limits)
    return allocated.withColumns({
        "confidence": F.least(F.lit(1.0), headroom(cpu, memory) * accuracy),
        "performance": F.greatest(F.lit(0.0), 1 - estimated_response(cpu, memory, limits) / limits.target_response),
        "savings": F.greatest(F.lit(0.0), saved),
        "risk": clamp(risk_cost(cpu, memory), 0.0, 1.0),
    })


def allocation_recommendations(limits: Limits = Limits()) -> Column:
    """Texts for changes larger than a step and for a forecast above the allocation."""
    cpu_usage, memory_usage = _usage()
    cpu, memory = F.col("cpu_allocation"), F.col("memory_allocation")
    dc, dm = cpu - cpu_usage, memory - memory_usage
    word = lambda d: F.when(d > 0, "increase").otherwise("decrease")
    return messages(
        F.when(F.abs(dc) > limits.step_cpu, F.format_string("Recommend %s CPU allocation by %.1f cores", word(dc), steady(F.abs(dc)))),
        F.when(F.abs(dm) > limits.step_memory, F.format_string("Recommend %s memory allocation by %.0f MB", word(dm), steady(F.abs(dm)))),
        F.when(F.array_max("predicted") > cpu, "Warning: Predicted workload exceeds recommended CPU allocation"),
    )


def recent_accuracy(results: DataFrame, keys: list[str], ts: str, last: int = 10) -> DataFrame:
    """Mean confidence of the preceding results of the key, 1 when there are none.

    Results are one row per key and decision window.
    """
    earlier = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-last, -1)
    return results.withColumn("accuracy", F.coalesce(F.avg("confidence").over(earlier), F.lit(1.0)))


def latest_metrics(points: DataFrame, tracked: DataFrame, tie_break: list[str]) -> DataFrame:
    """Latest known value of every tracked metric, 0 where none was seen."""
    last = points.groupBy("name").agg(F.max_by("value", F.struct("ts", *tie_break)).alias("last_value"))
    return tracked.join(last, "name", "left").withColumn("last_value", F.coalesce("last_value", F.lit(0.0)))
