"""Declarative data quality: schemas, baselines and rules compiled to columns.

Rules and schemas are small configuration read once on the driver; each becomes
column expressions over the records, so validating is one scan without a
shuffle whatever the number of rules.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import clamp
from metricloom.operators.windows import latest_rows

Getter = Callable[[str], Column]

# Schemas, baselines and limits of the scaling checks.
SCHEMAS: dict[str, dict[str, Any]] = {
    "scaling_pattern": {
        "required": ["cpu_usage", "memory_usage", "request_rate"],
        "properties": {
            "cpu_usage": {"type": "number", "minimum": 0, "maximum": 1},
            "memory_usage": {"type": "number", "minimum": 0, "maximum": 1},
            "request_rate": {"type": "number", "minimum": 0},
            "error_rate": {"type": "number", "minimum": 0, "maximum": 1},
        },
    },
    "scaling_outcome": {
        "required": ["action", "magnitude", "success"],
        "properties": {
            "action": {"type": "string", "enum": ["scale_out", "scale_in", "scale_up", "scale_down"]},
            "magnitude": {"type": "number", "minimum": 0},
            "success": {"type": "boolean"},
            "metrics": {"type": "object", "properties": {
                "response_time": {"type": "number", "minimum": 0}, "throughput": {"type": "number", "minimum": 0},
                "error_rate": {"type": "number", "minimum": 0},
            }},
        },
    },
    "workload_pattern": {
        "required": ["request_rate", "pattern_type"],
        "properties": {
            "request_rate": {"type": "array", "items": {"type": "number", "minimum": 0}},
            "pattern_type": {"type": "string", "enum": ["spike", "gradual", "periodic", "random"]},
        },
    },
}
BASELINES: dict[str, dict[str, float]] = {
    "cpu_usage": {"mean": 0.5, "std": 0.2, "min": 0.0, "max": 1.0},
    "memory_usage": {"mean": 0.6, "std": 0.15, "min": 0.0, "max": 1.0},
    "request_rate": {"mean": 100.0, "std": 50.0, "min": 0.0, "max": 1000.0},
    "error_rate": {"mean": 0.01, "std": 0.005, "min": 0.0, "max": 0.1},
}
MAX_Z = 3.0
PATTERN_FIELDS = ["name", "version", "type", "parameters", "rules", "actions"]
# Format patterns and allowed sets.
FORMATS = {
    "email": r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    "cpu": r"^\d+[m]?$",
    "memory": r"^\d+[KMGTPkmgtp]i?$",
    "version": r"^\d+\.\d+\.\d+$",
    "interval": r"^\d+[smhd]$",
}
RESOURCE_TYPES = ["deployment", "statefulset", "service", "node"]
SEVERITIES = ["critical", "warning", "info"]


def messages(*parts: Column) -> Column:
    """Array of the texts that are not null."""
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def text(*parts: Any) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def steady(value: Column) -> Column:
    """Drop float noise before a number is shown with few decimals (halves round up)."""
    return F.round(value, 9)


def schema_checks(schema: Mapping[str, Any], get: Getter) -> list[tuple[str, Column]]:
    """(path, message-or-null) of every check: required fields first, then properties."""
    checks: list[tuple[str, Column]] = [
        (f, F.when(get(f).isNull(), F.lit(f"'{f}' is a required property"))) for f in schema.get("required", [])
    ]
    for field, spec in schema.get("properties", {}).items():
        raw = get(field)
        shown = raw.cast("string")
        if spec.get("type") == "array":
            low = spec.get("items", {}).get("minimum")
            if spec.get("items", {}).get("type") == "number":
                checks.append((field, F.when(
                    F.exists(raw, lambda x: x.isNotNull() & x.try_cast("double").isNull()), F.lit(f"an item of '{field}' is not of type 'number'")
                )))
            if low is not None:
                checks.append((field, F.when(
                    F.exists(raw, lambda x: x.try_cast("double") < low), F.lit(f"an item of '{field}' is less than the minimum of {low}")
                )))
            continue
        if spec.get("type") == "object":
            nested = {"required": spec.get("required", []), "properties": spec.get("properties", {})}
            below = schema_checks(nested, lambda path, parent=field: get(f"{parent}.{path}"))
            checks += [(f"{field}.{path}", F.when(raw.isNotNull(), found)) for path, found in below]
            continue
        value = raw
        if spec.get("type") == "boolean":
            checks.append((field, F.when(raw.isNotNull() & raw.try_cast("boolean").isNull(), text("'", shown, "' is not of type 'boolean'"))))
            continue
        if spec.get("type") == "number":
            value = raw.try_cast("double")
            checks.append((field, F.when(raw.isNotNull() & value.isNull(), text("'", shown, "' is not of type 'number'"))))
        if "minimum" in spec:
            checks.append((field, F.when(value < spec["minimum"], text(shown, " is less than the minimum of ", spec["minimum"]))))
        if "maximum" in spec:
            checks.append((field, F.when(value > spec["maximum"], text(shown, " is greater than the maximum of ", spec["maximum"]))))
        if "enum" in spec:
            checks.append((field, F.when(~raw.isin(spec["enum"]), text("'", shown, "' is not one of ", spec["enum"]))))
        if "pattern" in spec:
            checks.append((field, F.when(~raw.rlike(spec["pattern"]), text("'", shown, "' does not match '", spec["pattern"], "'"))))
    return checks


def schema_errors(schema: Mapping[str, Any], get: Getter) -> Column:
    """All violations as an array of texts."""
    return messages(*[text("Schema validation error: ", m) for _, m in schema_checks(schema, get)])


def first_violation(schemas: Mapping[str, Mapping[str, Any]], scope: str, get: Getter) -> Column:
    """First violation with its path as a struct, null when valid; an unknown scope is an error."""
    entry = lambda path, error: F.struct(path.alias("path"), error.alias("error"))
    if scope not in schemas:
        return entry(F.lit(""), F.lit(f"No schema found for scope: {scope}"))
    checks = schema_checks(schemas[scope], get)
    return F.coalesce(*[F.when(m.isNotNull(), entry(F.lit(p), m)) for p, m in checks])


def fields_of(struct: str) -> Getter:
    return lambda path: F.col(f"{struct}.{path}")


def pattern_checks(pattern: str, baselines: Mapping[str, Mapping[str, float]] = BASELINES) -> tuple[Column, Column]:
    """(errors, warnings) of a scaling pattern: schema, baseline range, z-score, relationship."""
    get = fields_of(pattern)
    errors, warnings = [], []
    for field, base in baselines.items():
        v = get(field)
        z = F.abs((v - base["mean"]) / base["std"])
        outside = (v < base["min"]) | (v > base["max"])
        errors.append(F.when(outside, text(
            "Value ", v.cast("string"), f" for {field} is outside expected range [{base['min']:g}, {base['max']:g}]"
        )))
        warnings.append(F.when(z > MAX_Z, F.format_string(
            f"Value %s for {field} is statistically unusual (z-score: %.2f)", v.cast("string"), steady(z)
        )))
    odd = (get("cpu_usage") > 0.9) & (get("memory_usage") < 0.1)
    warnings.append(F.when(odd, "Unusual relationship between CPU and memory usage"))
    schema = schema_errors(SCHEMAS["scaling_pattern"], get)
    return F.concat(schema, messages(*errors)), messages(*warnings)


def outcome_checks(outcome: str) -> tuple[Column, Column]:
    """(errors, warnings) of a scaling outcome."""
    get = fields_of(outcome)
    action, magnitude = get("action"), get("magnitude")
    horizontal = action.isin("scale_out", "scale_in") & (magnitude != F.floor(magnitude))
    errors = F.when(horizontal, text(
        "Invalid magnitude ", magnitude.cast("string"), " for ", action, " action: must be an integer"
    ))
    rt, er = get("metrics.response_time"), get("metrics.error_rate")
    warnings = [
        F.when((action == "scale_out") & (magnitude > 10), text("Unusually large scale out magnitude: ", magnitude.cast("string"))),
        F.when(rt > 1000, text("High response time: ", rt.cast("string"), "ms")),
        F.when(er > 0.05, text("High error rate: ", (er * 100).cast("string"), "%")),
    ]
    return F.concat(schema_errors(SCHEMAS["scaling_outcome"], get), messages(errors)), messages(*warnings)


def relation_warnings(pattern: str, outcome: str) -> Column:
    """Warnings where the outcome does not fit the pattern."""
    p, o = fields_of(pattern), fields_of(outcome)
    cpu, mem = p("cpu_usage"), p("memory_usage")
    both = cpu.isNotNull() & mem.isNotNull()
    top = F.greatest(cpu, mem)
    shown = lambda head: F.format_string(head + " (CPU: %.2f, Memory: %.2f)", steady(cpu), steady(mem))
    rate, throughput = p("request_rate"), o("metrics.throughput")
    return messages(
        F.when(both & (o("action") == "scale_out") & (top < 0.5), shown("Scale out action with low resource usage")),
        F.when(both & (o("action") == "scale_in") & (top > 0.7), shown("Scale in action with high resource usage")),
        F.when(throughput < rate * 0.8, text(
            "Throughput (", throughput.cast("string"), ") is significantly lower than request rate (", rate.cast("string"), ")"
        )),
    )


def _mean_of_known(parts: Sequence[Column], default: float) -> Column:
    known = F.array_compact(F.array(*parts))
    return F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)), F.lit(default))


def validation_confidence(
    errors: Column, warnings: Column, pattern: str, outcome: str, baselines: Mapping[str, Mapping[str, float]] = BASELINES
) -> Column:
    """0 with any error, else 0.4 warnings + 0.3 pattern + 0.3 outcome, clamped to [0, 1]."""
    p, o = fields_of(pattern), fields_of(outcome)
    closeness = _mean_of_known(
        [1.0 / (1.0 + F.abs((p(f) - b["mean"]) / b["std"])) for f, b in baselines.items()], 0.5
    )
    success = F.when(F.coalesce(o("success"), F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.3))
    worth = _mean_of_known(
        [success, 1.0 / (1.0 + o("metrics.response_time") / 1000), 1.0 - o("metrics.error_rate")], 0.5
    )
    worth = F.when(F.col(outcome).isNull(), F.lit(1.0)).otherwise(worth)
    total = (1.0 - F.size(warnings) * 0.1) * 0.4 + closeness * 0.3 + worth * 0.3
    return F.when(F.size(errors) > 0, F.lit(0.0)).otherwise(clamp(total, 0.0, 1.0))


def validate_knowledge(
    records: DataFrame, scope: str = "complete", pattern: str = "pattern", outcome: str = "outcome",
    baselines: Mapping[str, Mapping[str, float]] = BASELINES,
) -> DataFrame:
    """Whole result: errors[], warnings[], is_valid, confidence.  ``scope``: pattern, outcome or complete."""
    none = F.array().cast("array<string>")
    scope = scope.lower()
    p_err, p_warn = pattern_checks(pattern, baselines) if scope in ("pattern", "complete") else (none, none)
    given = F.col(outcome).isNotNull()
    o_err, o_warn = outcome_checks(outcome) if scope in ("outcome", "complete") else (none, none)
    r_warn = relation_warnings(pattern, outcome) if scope == "complete" else none
    when_given = lambda c: F.when(given, c).otherwise(none)
    checked = records.withColumns({
        "errors": F.concat(p_err, when_given(o_err)),
        "warnings": F.concat(p_warn, when_given(o_warn), when_given(r_warn)),
    })
    return checked.withColumns({
        "is_valid": F.size("errors") == 0,
        "confidence": validation_confidence(F.col("errors"), F.col("warnings"), pattern, outcome, baselines),
    })


def refresh_baselines(
    results: DataFrame, order: list[Column], fields: Sequence[str] = tuple(BASELINES),
    pattern: str = "pattern", last: int = 1000, min_confidence: float = 0.8,
) -> DataFrame:
    """Baseline per field from the newest results that are valid and trusted."""
    newest = results.orderBy(*order).limit(last)
    good = newest.filter(F.col("is_valid") & (F.col("confidence") > min_confidence))
    long = good.select(*[F.col(f"{pattern}.{f}").alias(f) for f in fields]).unpivot([], list(fields), "field", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("field").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.1)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def baselines_of(table: DataFrame) -> dict[str, dict[str, float]]:
    """Baseline table (one row per configured field) as the mapping the checks take."""
    return {r["field"]: {k: r[k] for k in ("mean", "std", "min", "max")} for r in table.collect()}


def validator_metrics(results: DataFrame, order: list[Column], last: int = 100) -> DataFrame:
    """Number of validations and means over the newest ``last``."""
    newest = results.orderBy(*order).limit(last)
    means = newest.agg(
        F.avg(F.size("errors")).alias("error_rate"), F.avg(F.size("warnings")).alias("warning_rate"),
        F.avg("confidence").alias("average_confidence"),
    )
    count = results.agg(F.count(F.lit(1)).alias("n")).scalar()
    return means.select(
        count.alias("validation_count"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("error_rate", "warning_rate", "average_confidence")],
    )


# --- rules ---------------------------------------------------------------------------


def load_rules(table: DataFrame) -> dict[str, list[dict[str, Any]]]:
    """Rules per scope from rows (position, scope, rule JSON), in the order of
    ``position``; a later rule with the same id replaces the earlier.

    Rules are configuration: their number does not grow with the data.
    """
    rows = table.select("position", "scope", "rule").orderBy("position", "scope", "rule").collect()
    scopes: dict[str, dict[str, dict[str, Any]]] = {}
    for row in rows:
        rule = json.loads(row["rule"])
        scopes.setdefault(row["scope"], {})[rule["id"]] = rule
    return {scope: list(rules.values()) for scope, rules in scopes.items()}


def _condition(spec: Mapping[str, Any], get: Getter) -> Column:
    field, value = get(spec["field"]), F.lit(spec["value"])
    rule = {
        "equals": lambda: field == value,
        "not_equals": lambda: field.isNull() | (field != value),
        "contains": lambda: F.contains(field, value),
        "not_contains": lambda: ~F.contains(field, value),
        "greater_than": lambda: field > value,
        "less_than": lambda: field < value,
    }[spec["operator"]]()
    return F.coalesce(rule, F.lit(False))


def _constraint(spec: Mapping[str, Any], get: Getter) -> Column:
    """Message when the constraint fails, else null."""
    field = get(spec["field"])
    shown = F.coalesce(field.cast("string"), F.lit("None"))
    if spec["type"] == "range":
        failed = F.when(field.isNull(), text("Value of ", spec["field"], " is missing"))
        if spec.get("min") is not None:
            failed = failed.when(field < spec["min"], text("Value ", shown, " is below minimum ", spec["min"]))
        if spec.get("max") is not None:
            failed = failed.when(field > spec["max"], text("Value ", shown, " is above maximum ", spec["max"]))
        return failed
    if spec["type"] == "pattern":
        # a match at the start of the text is enough
        return F.when(~shown.rlike(f"^(?:{spec['pattern']})"), text("Value ", shown, " does not match pattern ", spec["pattern"]))
    if spec["type"] == "dependency":
        lacking = field.isNotNull() & get(spec["depends_on"]).isNull()
        return F.when(lacking, text("Field ", spec["field"], " depends on ", spec["depends_on"]))
    raise ValueError(f"unknown constraint {spec['type']}")


def rule_findings(rules: Sequence[Mapping[str, Any]], level: str, get: Getter) -> tuple[Column, Column]:
    """(errors, warnings) as arrays of "rule_id: message"; rules of another level are skipped.

    A rule speaks only when all its conditions hold; its first failed constraint
    is reported, as an error when its priority is high.
    """
    errors, warnings = [], []
    for rule in rules:
        if rule["level"].lower() != level.lower():
            continue
        applies = F.lit(True)
        for spec in rule["conditions"]:
            applies = applies & _condition(spec, get)
        failed = F.coalesce(*[_constraint(spec, get) for spec in rule["constraints"]])
        found = F.when(applies, text(rule["id"], ": ", failed))  # null without a failure
        (errors if rule["priority"].lower() == "high" else warnings).append(found)
    return messages(*errors), messages(*warnings)


def validate_records(
    records: DataFrame, scope: str, level: str, schemas: Mapping[str, Mapping[str, Any]],
    rules: Mapping[str, Sequence[Mapping[str, Any]]], get: Getter = F.col,
) -> DataFrame:
    """Schema and rule validation of each record in one scan."""
    rule_errors, rule_warnings = rule_findings(rules.get(scope, []), level, get)
    if scope in schemas:
        # joined to null where the check holds, so every check is evaluated once
        schema = messages(F.coalesce(*[text(path, ": ", found) for path, found in schema_checks(schemas[scope], get)]))
    else:
        schema = F.array(F.lit(f": No schema found for scope: {scope}"))
    out = records.withColumns({"errors": F.concat(schema, rule_errors), "warnings": rule_warnings})
    return out.withColumn("is_valid", F.size("errors") == 0)


# --- single checks -------------------------------------------------------------------


def json_path(document: Column | str, path: str) -> Column:
    """Text at a dotted path (keys and list positions); null where the path breaks off."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(document, "$" + steps)


def missing_fields(document: Column | str, required: Sequence[str] = tuple(PATTERN_FIELDS)) -> Column:
    """Required keys absent from a JSON object, in order."""
    have = F.json_object_keys(document)
    return F.array_except(F.array(*[F.lit(f) for f in required]), have)


def missing_columns(required: Sequence[str]) -> Column:
    """Names of required columns that are null in the row."""
    return messages(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])


def format_ok(kind: str, value: Column | str) -> Column:
    """Whether a text has the named format; a missing or empty text passes."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce((value == "") | value.rlike(FORMATS[kind]), F.lit(True))


def ports_ok(ports: Column) -> Column:
    """Every port present and within 1..65535."""
    return F.coalesce(F.forall(ports, lambda p: p.isNotNull() & p.between(1, 65_535)), F.lit(True))


def validate_points(points: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``valid``: known metric, all required labels, finite number, counters not negative."""
    known = registry.select("name", "metric_type", "required")
    labelled = F.forall("required", lambda r: F.map_contains_key("labels", r))
    sound = (F.col("metric_type") != "counter") | (F.col("value") >= 0)
    ok = F.coalesce(labelled & F.col("value").isNotNull() & sound, F.lit(False))
    return points.join(known, "name", "left").withColumn("valid", ok).drop("metric_type", "required")


def result_history(results: DataFrame, keys: list[str], order: list[Column], last: int = 1000) -> DataFrame:
    """The newest results per key."""
    return latest_rows(results, keys, order, last)


