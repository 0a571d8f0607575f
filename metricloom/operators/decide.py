"""Scaling decisions: candidates, scores, choice, autoscale steps and rules.

Candidates are arrays built inside the row, so generating and scoring them
needs no shuffle; only the small history table is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import clamp
from metricloom.operators.quality import messages, steady

# Limits, weights and lookup tables of the decision rules.
HIGH_UTILISATION, LOW_UTILISATION, LOW_FORECAST = 0.7, 0.3, 0.5
UP_THRESHOLD, DOWN_THRESHOLD = 0.75, 0.25
MIN_INSTANCES, MAX_INSTANCES = 1, 10
CPU_STEP, MEMORY_STEP = 0.1, 64.0
CPU_COST, MEMORY_COST = 1.0, 0.1
WEIGHTS = {"confidence": 0.3, "impact": 0.3, "risk": 0.2, "history": 0.2}
CONFIDENCE_SCORE = {"high": 1.0, "medium": 0.7, "low": 0.4, "uncertain": 0.2}
CONFIDENCE_RISK = {"high": 0.7, "medium": 1.0, "low": 1.3, "uncertain": 1.5}
BASE_RISK = {
    "scale_horizontal": 0.3, "scale_vertical": 0.5, "optimize_resources": 0.4, "no_action": 0.1, "rollback": 0.6,
}
MIN_SCORE = 0.7
KNOWN_IMPACT = {a: (0.1, -0.1, 0.2) for a in ("scale_out", "scale_in", "scale_up", "scale_down")}
MIN_SAMPLES = 50
HISTORY = 100


def lookup(key: Column, table: Mapping[str, float]) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])


def _known(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def peak() -> Column:
    """Largest forecast value, null without a forecast."""
    return F.array_max("predicted")


# --- autoscale step ------------------------------------------------------------------


def scaling_factor() -> Column:
    return F.greatest(_known("cpu_usage") / UP_THRESHOLD, _known("memory_usage") / UP_THRESHOLD, peak() / UP_THRESHOLD)


def horizontal_step(df: DataFrame, low: int = MIN_INSTANCES, high: int = MAX_INSTANCES) -> DataFrame:
    """Action, magnitude, confidence and impact of a horizontal step from ``instances``."""
    n, f = F.col("instances"), F.col("factor")
    ratio = 1 - f / DOWN_THRESHOLD
    out, inn = (f > 1) & (n < high), (f < DOWN_THRESHOLD) & (n > low)
    more = F.least(F.ceil(steady(n * (f - 1))), high - n).cast("bigint")
    less = F.least(F.ceil(steady(n * ratio)), n - low).cast("bigint")
    price = _known("allocated_cpu") * CPU_COST + _known("allocated_memory") * MEMORY_COST
    df = df.withColumn("factor", scaling_factor())
    df = df.withColumns({
        "h_action": F.when(out, "scale_out").when(inn, "scale_in").otherwise("no_action"),
        "h_magnitude": F.when(out, more).when(inn, less).otherwise(F.lit(0).cast("bigint")),
        "h_confidence": F.when(out, F.least(f - 1, F.lit(1.0))).when(inn, F.least(ratio, F.lit(1.0))).otherwise(F.lit(1.0)),
    })
    change = F.when(F.col("h_action") == "scale_out", F.col("h_magnitude")).otherwise(-F.col("h_magnitude"))
    moved = F.col("h_action") != "no_action"
    stretch = F.when(F.col("h_action") == "scale_out", 0.8).otherwise(1.2)
    return df.withColumns({
        "h_target": n + change,
        "h_cpu_impact": F.when(moved, _known("cpu_usage") / (n + change)),
        "h_response_impact": F.when(moved, _known("response_time") * stretch),
        "h_cost_impact": F.when(moved, change * price),
    })


def vertical_step(df: DataFrame) -> DataFrame:
    """Action and magnitude of a vertical step towards the target allocation."""
    cpu, mem = F.col("allocated_cpu"), F.col("allocated_memory")
    to_cpu, to_mem = F.coalesce("target_cpu", cpu), F.coalesce("target_memory", mem)
    moved = (F.abs(to_cpu - cpu) > CPU_STEP) | (F.abs(to_mem - mem) > MEMORY_STEP)
    size = F.greatest(F.try_divide(F.abs(to_cpu - cpu), cpu), F.try_divide(F.abs(to_mem - mem), mem))
    return df.withColumns({
        "v_action": F.when(moved, F.when(to_cpu > cpu, "scale_up").otherwise("scale_down")).otherwise("no_action"),
        "v_magnitude": F.when(moved, size).otherwise(F.lit(0.0)),
    })


def combine_steps(df: DataFrame) -> DataFrame:
    """A horizontal step wins over a vertical one."""
    horizontal = F.col("h_action") != "no_action"
    return df.withColumns({
        "action": F.when(horizontal, F.col("h_action")).otherwise(F.col("v_action")),
        "magnitude": F.when(horizontal, F.col("h_magnitude").cast("double")).otherwise(F.col("v_magnitude")),
    })


# --- candidates ----------------------------------------------------------------------

CANDIDATE = (
    "struct<decision_type:string,action:string,magnitude:double,confidence:string,reason:string,"
    "impact:struct<performance_impact:double,cost_impact:double,resource_efficiency:double>,recommendations:array<string>>"
)


def confidence_level(score: Column) -> Column:
    """Level of a numeric confidence: high from 0.8, medium from 0.5, low from 0.2."""
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score >= 0.2, "low").otherwise("uncertain")


def predicted_impact(action: Column) -> Column:
    """Known impact of an action, null for others."""
    perf, cost, res = next(iter(KNOWN_IMPACT.values()))
    return F.when(action.isin(list(KNOWN_IMPACT)), F.struct(
        F.lit(perf).alias("performance_impact"), F.lit(cost).alias("cost_impact"), F.lit(res).alias("resource_efficiency")
    ))


def learned_impact(action_table: DataFrame) -> DataFrame:
    """Impact per action: the fixed values, replaced by means where enough samples exist."""
    spark = action_table.sparkSession
    fixed = spark.createDataFrame(
        [(a, *v) for a, v in KNOWN_IMPACT.items()], "action string, p double, c double, r double"
    )
    joined = fixed.join(action_table, "action", "full")
    return joined.select(
        "action", F.coalesce("performance_impact", "p").alias("performance_impact"),
        F.coalesce("cost_impact", "c").alias("cost_impact"), F.coalesce("resource_efficiency", "r").alias("resource_efficiency"),
        F.col("n_samples").isNotNull().alias("learned"),
    )


def impact_features() -> Column:
    """Four metrics and two allocations, missing ones as 0."""
    return F.array(*[_known(c) for c in ("cpu_usage", "memory_usage", "request_rate", "error_rate", "target_cpu", "target_memory")])


def _candidate(kind: str, action: Column, magnitude: Column, confidence: Column, reason: Column, texts: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("decision_type"), action.alias("action"), magnitude.cast("double").alias("magnitude"),
        confidence.alias("confidence"), reason.alias("reason"), predicted_impact(action).alias("impact"),
        texts.alias("recommendations"),
    ).cast(CANDIDATE)


def _percent(c: Column) -> Column:
    return steady(c * 100)


def horizontal_candidates(low: int = MIN_INSTANCES, high: int = MAX_INSTANCES) -> list[Column]:
    """Scale-out and scale-in candidates, null where the conditions fail."""
    cpu, mem, n, f = _known("cpu_usage"), _known("memory_usage"), F.col("instances"), scaling_factor()
    out = (cpu > HIGH_UTILISATION) | (mem > HIGH_UTILISATION) | F.coalesce(peak() > HIGH_UTILISATION, F.lit(False))
    inn = (cpu < LOW_UTILISATION) & (mem < LOW_UTILISATION) & F.coalesce(peak() < LOW_FORECAST, F.lit(True))
    more = F.greatest(F.least(F.ceil(steady(n * (f - 1))), high - n), F.lit(0))
    less = F.greatest(F.least(F.ceil(steady(n * (1 - f / DOWN_THRESHOLD))), n - low), F.lit(0))
    out_texts = messages(
        F.format_string("Increase number of instances to handle high utilization (CPU: %.1f%%, Memory: %.1f%%)", _percent(cpu), _percent(mem)),
        F.when(peak().isNotNull(), F.format_string("Prepare for predicted workload increase (Peak: %.1f%%)", _percent(peak()))),
    )
    in_texts = messages(F.format_string(
        "Decrease number of instances to optimize costs (Current utilization - CPU: %.1f%%, Memory: %.1f%%)", _percent(cpu), _percent(mem)
    ))
    level = lambda x: confidence_level(clamp(x, 0.0, 1.0))
    return [
        F.when(out, _candidate("scale_horizontal", F.lit("scale_out"), more, level(f - 1), F.lit("High resource utilization"), out_texts)),
        F.when(inn, _candidate("scale_horizontal", F.lit("scale_in"), less, level(1 - f / DOWN_THRESHOLD), F.lit("Low resource utilization"), in_texts)),
    ]


def vertical_candidates() -> list[Column]:
    """Scale-up and scale-down candidates towards the target allocation."""
    cpu, mem, to_cpu, to_mem = (F.col(c) for c in ("allocated_cpu", "allocated_memory", "target_cpu", "target_memory"))
    both = to_cpu.isNotNull() & to_mem.isNotNull()
    up = both & ((to_cpu > cpu * 1.1) | (to_mem > mem * 1.1))
    down = (to_cpu < cpu * 0.9) & (to_mem < mem * 0.9)
    ratio = lambda a, b: F.try_divide(a, b)
    confidence = F.lower(F.coalesce("target_confidence", F.lit("medium")))
    texts = messages(F.format_string(
        "Adjust resource allocation based on optimization analysis (Target CPU: %.1f, Memory: %.0fMB)", steady(to_cpu), steady(to_mem)
    ))
    make = lambda action, size: _candidate(
        "scale_vertical", F.lit(action), size, confidence, F.lit("Resource optimization recommendation"), texts
    )
    return [
        F.when(up, make("scale_up", F.greatest(ratio(to_cpu, cpu) - 1, ratio(to_mem, mem) - 1))),
        F.when(down, make("scale_down", F.greatest(1 - ratio(to_cpu, cpu), 1 - ratio(to_mem, mem)))),
    ]


def optimization_candidates(column: str = "optimizations") -> Column:
    """One candidate per recommendation struct (action, magnitude, confidence, reason)."""
    return F.transform(F.coalesce(F.col(column), F.array()), lambda r: _candidate(
        "optimize_resources", r["action"], F.coalesce(r["magnitude"], F.lit(0.0)),
        F.lower(F.coalesce(r["confidence"], F.lit("medium"))), r["reason"], F.array().cast("array<string>"),
    ))


def no_action(reason: str = "No action needed") -> Column:
    return _candidate("no_action", F.lit("none"), F.lit(0.0), F.lit("high"), F.lit(reason), F.array().cast("array<string>"))


def candidates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All candidates of each decision row, with their position; no-action always included."""
    own = F.array_compact(F.array(*horizontal_candidates(), *vertical_candidates()))
    extra = optimization_candidates() if "optimizations" in df.columns else F.array().cast(f"array<{CANDIDATE}>")
    everything = F.concat(own, extra, F.array(no_action()))
    return df.select(*keys, F.posexplode(everything).alias("position", "c")).select(*keys, "position", "c.*")


# --- scores --------------------------------------------------------------------------


def impact_score(impact: Column) -> Column:
    score = (
        0.4 * (1 + impact["performance_impact"]) + 0.3 * (1 - impact["cost_impact"]) + 0.3 * impact["resource_efficiency"]
    )
    return F.when(impact.isNull(), F.lit(0.5)).otherwise(clamp(score, 0.0, 1.0))


def risk_score() -> Column:
    size = F.least(F.lit(1.0), F.col("magnitude") / 2)
    return F.least(F.lit(1.0), lookup(F.col("decision_type"), BASE_RISK) * size * lookup(F.col("confidence"), CONFIDENCE_RISK))


def score_candidates(cands: DataFrame, history: DataFrame | None = None, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Total score; ``history`` gives a success rate per (decision_type, action), else 0.5."""
    if history is not None:
        cands = cands.join(history.select("decision_type", "action", "success_rate"), ["decision_type", "action"], "left")
        past = F.coalesce("success_rate", F.lit(0.5))
    else:
        past = F.lit(0.5)
    total = (
        weights["confidence"] * lookup(F.col("confidence"), CONFIDENCE_SCORE)
        + weights["impact"] * impact_score(F.col("impact"))
        + weights["risk"] * (1 - risk_score()) + weights["history"] * past
    )
    return cands.withColumn("score", total)


def choose_best(scored: DataFrame, keys: list[str], min_score: float = MIN_SCORE) -> DataFrame:
    """Best candidate per decision; below the minimum it is replaced by no-action.

    Scores are compared after rounding to 12 digits; the first position wins a tie.
    """
    fields = F.struct("decision_type", "action", "magnitude", "reason", "score")
    best = F.min_by(fields, F.struct(-F.round("score", 12), F.col("position")))
    out = scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
    weak = (F.round("score", 12) < min_score) & (F.col("decision_type") != "no_action")
    return out.select(
        *keys,
        F.when(weak, "no_action").otherwise(F.col("decision_type")).alias("decision_type"),
        F.when(weak, "none").otherwise(F.col("action")).alias("action"),
        F.when(weak, 0.0).otherwise(F.col("magnitude")).alias("magnitude"),
        F.when(weak, "No candidate met minimum confidence threshold").otherwise(F.col("reason")).alias("reason"),
        F.col("score").alias("best_score"),
    )


# --- history -------------------------------------------------------------------------


def judged_decisions(decisions: DataFrame, impacts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Decisions with their first recorded impact and whether it was a success."""
    first = impacts.groupBy("decision_id").agg(
        F.min_by(F.struct("performance_impact", "cost_impact", "resource_efficiency"), F.struct(*order)).alias("impact")
    )
    i = F.col("impact")
    good = (
        (F.coalesce(i["performance_impact"], F.lit(0.0)) > -0.1)
        & (F.coalesce(i["cost_impact"], F.lit(0.0)) < 0.2)
        & (F.coalesce(i["resource_efficiency"], F.lit(0.0)) > 0)
    )
    return decisions.join(first, "decision_id", "left").withColumn("success", F.coalesce(good & i.isNotNull(), F.lit(False)))


def success_rates(judged: DataFrame, order: list[Column], last: int = HISTORY) -> DataFrame:
    """Success rate per (decision_type, action) among the newest decisions."""
    newest = judged.orderBy(*order).limit(last)
    return newest.groupBy("decision_type", "action").agg(
        F.avg(F.col("success").cast("double")).alias("success_rate"), F.count(F.lit(1)).alias("n_decisions")
    )


def mean_impacts(decisions: DataFrame, impacts: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Mean impact per action, once the whole history holds enough samples."""
    joined = decisions.select("decision_id", "action").join(impacts, "decision_id")
    total = joined.agg(F.count(F.lit(1))).scalar()
    return joined.groupBy("action").agg(
        *[F.avg(c).alias(c) for c in ("performance_impact", "cost_impact", "resource_efficiency")],
        F.count(F.lit(1)).alias("n_samples"),
    ).filter(total >= min_samples)


# --- parameterised rules -------------------------------------------------------------


def apply_rules(
    df: DataFrame, parameters: Mapping[str, Any], rules: Sequence[Mapping[str, str]], actions: Mapping[str, Mapping[str, Any]],
    replicas: str = "instances",
) -> DataFrame:
    """First rule whose condition text holds, and the replica count after its clamped delta.

    Conditions are SQL expressions over the row's columns and the parameters.
    """
    with_parameters = df.withColumns({k: F.lit(v) for k, v in parameters.items()})
    action = F.coalesce(*[F.when(F.expr(r["condition"]), F.lit(r["action"])) for r in rules], F.lit("none"))
    delta = F.coalesce(*[F.when(F.col("rule_action") == a, F.lit(s["delta"])) for a, s in actions.items()], F.lit(0))
    out = with_parameters.withColumn("rule_action", action)
    new = clamp(F.col(replicas) + delta, F.col("min_replicas"), F.col("max_replicas"))
    return out.withColumn("new_replicas", F.when(delta == 0, F.col(replicas)).otherwise(new)).drop(*parameters)
