"""Data quality queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from metricloom.functions.scalars import iso
from metricloom.operators import quality
from metricloom.plans import inputs
from metricloom.plans.inputs import table
from metricloom.plans.oracle import UTIL, iso as siso, r6
from metricloom.plans.q_library import FEATURES, featured
from metricloom.plans.registry import query
from metricloom.plans.rounding import TIE_NUDGE, round6
from metricloom.sources.metrics import METRIC_DEFINITIONS, metric_definitions


def r4(expr):
    return f"(round(({expr}) + 3.3e-8, 4) + 0)"


def rounded(name):
    return F.round(F.col(name) + TIE_NUDGE, 4)


RECORDS = f"""
{UTIL},
v0 AS (SELECT h, {r4('cpu')} AS cpu, {r4('memory')} AS mem, request_rate AS rate, {r4('error_rate')} AS err, {r4('response_time')} AS rt FROM util),
v AS (SELECT *, CASE WHEN cpu IS NULL THEN 'restart' WHEN cpu > 0.6 THEN 'scale_out' WHEN cpu < 0.4 THEN 'scale_in' ELSE 'scale_up' END AS action,
  rate / 2 AS magnitude, err < 0.25 AS success, rt * 16 AS ort, rt / 5 AS throughput, err / 4 AS oerr FROM v0)
"""


def records(spark, sf):
    u = inputs.utilization(spark, sf)
    u = u.select("h", rounded("cpu").alias("cpu"), rounded("memory").alias("mem"), F.col("request_rate").alias("rate"),
                 rounded("error_rate").alias("err"), rounded("response_time").alias("rt"))
    action = (
        F.when(F.col("cpu").isNull(), "restart").when(F.col("cpu") > 0.6, "scale_out")
        .when(F.col("cpu") < 0.4, "scale_in").otherwise("scale_up")
    )
    return u.select(
        "h",
        F.struct(F.col("cpu").alias("cpu_usage"), F.col("mem").alias("memory_usage"),
                 F.col("rate").alias("request_rate"), F.col("err").alias("error_rate")).alias("pattern"),
        F.struct(
            action.alias("action"), (F.col("rate") / 2).alias("magnitude"), (F.col("err") < 0.25).alias("success"),
            F.struct((F.col("rt") * 16).alias("response_time"), (F.col("rt") / 5).alias("throughput"),
                     (F.col("err") / 4).alias("error_rate")).alias("metrics"),
        ).alias("outcome"),
    )


def joined(c):
    return F.array_join(c, " | ")


def ws(*parts):
    return "concat_ws(' | ', " + ", ".join(parts) + ")"


def case(cond, text):
    return f"CASE WHEN {cond} THEN {text} END"


def two(expr):
    """Two decimals, halves rounded up on the decimal value."""
    return f"printf('%.2f', round(CAST({expr} AS DECIMAL(18, 9)), 2)::DOUBLE)"


def s(col):
    return f"CAST({col} AS VARCHAR)"


SCHEMA_P = [
    case("cpu IS NULL", "'Schema validation error: ''cpu_usage'' is a required property'"),
    case("mem IS NULL", "'Schema validation error: ''memory_usage'' is a required property'"),
    case("rate IS NULL", "'Schema validation error: ''request_rate'' is a required property'"),
    case("cpu < 0", f"'Schema validation error: ' || {s('cpu')} || ' is less than the minimum of 0'"),
    case("cpu > 1", f"'Schema validation error: ' || {s('cpu')} || ' is greater than the maximum of 1'"),
    case("mem > 1", f"'Schema validation error: ' || {s('mem')} || ' is greater than the maximum of 1'"),
    case("err > 1", f"'Schema validation error: ' || {s('err')} || ' is greater than the maximum of 1'"),
]
RANGE_P = [
    case(f"{c} < 0 OR {c} > {hi}", f"'Value ' || {s(c)} || ' for {n} is outside expected range [0, {hi:g}]'")
    for c, n, hi in (("cpu", "cpu_usage", 1), ("mem", "memory_usage", 1), ("rate", "request_rate", 1000), ("err", "error_rate", 0.1))
]
BASE = {"cpu": ("cpu_usage", 0.5, 0.2), "mem": ("memory_usage", 0.6, 0.15), "rate": ("request_rate", 100, 50), "err": ("error_rate", 0.01, 0.005)}
WARN_P = [
    case(f"abs(({c} - {m}) / {d}) > 3", f"'Value ' || {s(c)} || ' for {n} is statistically unusual (z-score: ' || {two(f'abs(({c} - {m}) / {d}::DOUBLE)')} || ')'")
    for c, (n, m, d) in BASE.items()
] + [case("cpu > 0.9 AND mem < 0.1", "'Unusual relationship between CPU and memory usage'")]
ERR_O = [
    case("action = 'restart'", "'Schema validation error: ''restart'' is not one of [''scale_out'', ''scale_in'', ''scale_up'', ''scale_down'']'"),
    case("action IN ('scale_out', 'scale_in') AND magnitude <> floor(magnitude)", f"'Invalid magnitude ' || {s('magnitude')} || ' for ' || action || ' action: must be an integer'"),
]
WARN_O = [
    case("action = 'scale_out' AND magnitude > 10", f"'Unusually large scale out magnitude: ' || {s('magnitude')}"),
    case("ort > 1000", f"'High response time: ' || {s('ort')} || 'ms'"),
    case("oerr > 0.05", f"'High error rate: ' || {s('oerr * 100')} || '%'"),
]
WARN_R = [
    case("action = 'scale_out' AND greatest(cpu, mem) < 0.5 AND mem IS NOT NULL AND cpu IS NOT NULL", f"'Scale out action with low resource usage (CPU: ' || {two('cpu')} || ', Memory: ' || {two('mem')} || ')'"),
    case("action = 'scale_in' AND greatest(cpu, mem) > 0.7 AND mem IS NOT NULL AND cpu IS NOT NULL", f"'Scale in action with high resource usage (CPU: ' || {two('cpu')} || ', Memory: ' || {two('mem')} || ')'"),
    case("throughput < rate * 0.8", f"'Throughput (' || {s('throughput')} || ') is significantly lower than request rate (' || {s('rate')} || ')'"),
]
NONNULL = lambda parts: "len(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL))"


@query("pattern_schema_errors", "P16", f"WITH {RECORDS} SELECT {siso('h')} AS h, {ws(*SCHEMA_P)} AS errors FROM v")
def pattern_schema_errors(spark, sf):
    r = records(spark, sf)
    return r.select(iso("h").alias("h"), joined(quality.schema_errors(
        quality.SCHEMAS["scaling_pattern"], quality.fields_of("pattern"))).alias("errors"))


@query("outcome_findings", "P17", f"WITH {RECORDS} SELECT {siso('h')} AS h, {ws(*ERR_O)} AS errors, {ws(*WARN_O)} AS warnings FROM v")
def outcome_findings(spark, sf):
    e, w = quality.outcome_checks("outcome")
    return records(spark, sf).select(iso("h").alias("h"), joined(e).alias("errors"), joined(w).alias("warnings"))


@query("baseline_findings", "P18", f"WITH {RECORDS} SELECT {siso('h')} AS h, {ws(*SCHEMA_P, *RANGE_P)} AS errors, {ws(*WARN_P)} AS warnings FROM v")
def baseline_findings(spark, sf):
    e, w = quality.pattern_checks("pattern")
    return records(spark, sf).select(iso("h").alias("h"), joined(e).alias("errors"), joined(w).alias("warnings"))


@query("relation_findings", "P19", f"WITH {RECORDS} SELECT {siso('h')} AS h, {ws(*WARN_R)} AS warnings FROM v")
def relation_findings(spark, sf):
    return records(spark, sf).select(iso("h").alias("h"), joined(quality.relation_warnings("pattern", "outcome")).alias("warnings"))


# Trusted ranges of this data: utilisation counts are lower and errors more frequent.
LOCAL = {
    "cpu_usage": {"mean": 0.5, "std": 0.2, "min": 0.0, "max": 1.0},
    "memory_usage": {"mean": 0.5, "std": 0.2, "min": 0.0, "max": 1.0},
    "request_rate": {"mean": 14.0, "std": 4.0, "min": 0.0, "max": 22.0},
    "error_rate": {"mean": 0.2, "std": 0.1, "min": 0.0, "max": 0.5},
}
SHORT = {"cpu": "cpu_usage", "mem": "memory_usage", "rate": "request_rate", "err": "error_rate"}
LOCAL_RANGE = [
    case(f"{c} < 0 OR {c} > {LOCAL[n]['max']}", f"'Value ' || {s(c)} || ' for {n} is outside expected range [0, {LOCAL[n]['max']:g}]'") for c, n in SHORT.items()
]
LOCAL_WARN = [
    case(f"abs(({c} - {LOCAL[n]['mean']}) / {LOCAL[n]['std']}) > 3",
         f"'Value ' || {s(c)} || ' for {n} is statistically unusual (z-score: ' || {two('abs((' + c + ' - ' + str(LOCAL[n]['mean']) + ') / ' + str(LOCAL[n]['std']) + '::DOUBLE)')} || ')'")
    for c, n in SHORT.items()
] + [WARN_P[-1]]
ERRORS, WARNINGS = [*SCHEMA_P, *LOCAL_RANGE, *ERR_O], [*LOCAL_WARN, *WARN_O, *WARN_R]
CLOSE = " , ".join(f"1 / (1 + abs(({c} - {LOCAL[n]['mean']}) / {LOCAL[n]['std']}))" for c, n in SHORT.items())
RESULTS = f"""
{RECORDS},
results AS (SELECT *, {ws(*ERRORS)} AS errors, {ws(*WARNINGS)} AS warnings, {NONNULL(ERRORS)} AS ne, {NONNULL(WARNINGS)} AS nw,
  list_avg(list_filter([{CLOSE}], lambda x: x IS NOT NULL)) AS closeness,
  list_avg(list_filter([CASE WHEN success THEN 1.0::DOUBLE ELSE 0.3 END, 1 / (1 + ort / 1000), 1 - oerr], lambda x: x IS NOT NULL)) AS worth FROM v),
scored AS (SELECT *, CASE WHEN ne > 0 THEN 0.0::DOUBLE ELSE greatest(0, least(1, (1 - nw * 0.1::DOUBLE) * 0.4 + closeness * 0.3 + worth * 0.3)) END AS confidence FROM results)
"""


@query("whole_validation_result", "K11 K10 P16 P17 P18 P19", f"""
WITH {RESULTS} SELECT {siso('h')} AS h, errors, warnings, ne = 0 AS is_valid, {r6('confidence')} AS confidence FROM scored
""")
def whole_validation_result(spark, sf):
    out = quality.validate_knowledge(records(spark, sf), baselines=LOCAL)
    return out.select(iso("h").alias("h"), joined("errors").alias("errors"), joined("warnings").alias("warnings"),
                      "is_valid", round6("confidence").alias("confidence"))


@query("pattern_scope_result", "K11", f"""
WITH {RESULTS} SELECT {siso('h')} AS h, {ws(*SCHEMA_P, *LOCAL_RANGE)} AS errors, {ws(*LOCAL_WARN)} AS warnings FROM scored
""")
def pattern_scope_result(spark, sf):
    out = quality.validate_knowledge(records(spark, sf), "pattern", baselines=LOCAL)
    return out.select(iso("h").alias("h"), joined("errors").alias("errors"), joined("warnings").alias("warnings"))


@query("baseline_refresh", "A17 W9", f"""
WITH {RESULTS}, last AS (SELECT * FROM scored ORDER BY h DESC LIMIT 1000),
good AS (SELECT * FROM last WHERE ne = 0 AND confidence > 0.8),
long AS (SELECT 'cpu_usage' AS field, cpu AS x FROM good UNION ALL SELECT 'memory_usage', mem FROM good
  UNION ALL SELECT 'request_rate', rate FROM good UNION ALL SELECT 'error_rate', err FROM good)
SELECT field, {r6('avg(x)')} AS mean, {r6('coalesce(stddev_samp(x), 0.1)')} AS std, min(x) AS min, max(x) AS max FROM long GROUP BY 1
""")
def baseline_refresh(spark, sf):
    results = quality.validate_knowledge(records(spark, sf), baselines=LOCAL)
    out = quality.refresh_baselines(results, [F.col("h").desc()])
    return out.select("field", round6("mean").alias("mean"), round6("std").alias("std"), "min", "max")


@query("validator_metrics", "A18", f"""
WITH {RESULTS}, last AS (SELECT * FROM scored ORDER BY h DESC LIMIT 100)
SELECT (SELECT count(*) FROM scored) AS validation_count, {r6('avg(ne)')} AS error_rate, {r6('avg(nw)')} AS warning_rate,
  {r6('avg(confidence)')} AS average_confidence FROM last
""")
def validator_metrics(spark, sf):
    out = quality.validator_metrics(quality.validate_knowledge(records(spark, sf), baselines=LOCAL), [F.col("h").desc()])
    return out.select("validation_count", *[round6(c).alias(c) for c in ("error_rate", "warning_rate", "average_confidence")])


@query("metric_registry_check", "P14 D4 D3", """
SELECT event_id, event_type <> 'signup' AND (event_type <> 'error' OR user_id % 2 = 0) AND (event_type <> 'view' OR value - 20 >= 0) AS valid FROM events
""")
def metric_registry_check(spark, sf):
    names = dict(zip(["click", "error", "view", "purchase"], [METRIC_DEFINITIONS[i][0] for i in (0, 2, 5, 4)]))
    name = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit("unheard_of"))
    label = lambda k: (F.lit(k), F.col("user_id").cast("string"))
    labels = F.create_map(*label("hostname"), *label("container_id"), *label("container_name"), *label("interface"))
    labels = F.when(F.col("user_id") % 2 == 0, F.map_concat(labels, F.create_map(*label("mount_point")))).otherwise(labels)
    e = table(spark, sf, "events").select("event_id", name.alias("name"), (F.col("value") - 20).alias("value"), labels.alias("labels"))
    return quality.validate_points(e, metric_definitions(spark)).select("event_id", "valid")


@query("required_fields", "P15", """
SELECT o_orderkey, concat_ws(',', CASE WHEN l_tax IS NULL THEN 'low_tax' END, CASE WHEN l_qty IS NULL THEN 'returned' END) AS missing
FROM orders LEFT JOIN (
  SELECT l_orderkey, min(l_tax) FILTER (WHERE l_tax < 0.02) AS l_tax, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS l_qty FROM lineitem GROUP BY 1)
ON l_orderkey = o_orderkey
""")
def required_fields(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min(F.when(F.col("l_tax") < 0.02, F.col("l_tax"))).alias("low_tax"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"),
    )
    o = table(spark, sf, "orders").select("o_orderkey").join(li, "o_orderkey", "left")
    return o.select("o_orderkey", F.array_join(quality.missing_columns(["low_tax", "returned"]), ",").alias("missing"))


@query("workload_pattern_schema", "P20", f"""
WITH {FEATURES} SELECT pid AS pattern_id, concat_ws(' | ',
  CASE WHEN lo - 3 < 0 THEN 'Schema validation error: an item of ''request_rate'' is less than the minimum of 0' END,
  CASE WHEN category NOT IN ('spike', 'gradual', 'periodic', 'random') THEN
    'Schema validation error: ''' || category || ''' is not one of [''spike'', ''gradual'', ''periodic'', ''random'']' END) AS errors FROM feats
""")
def workload_pattern_schema(spark, sf):
    f = featured(spark, sf).select(
        "pattern_id", F.transform("values", lambda x: x - 3).alias("request_rate"), F.col("category").alias("pattern_type")
    )
    return f.select("pattern_id", joined(quality.schema_errors(quality.SCHEMAS["workload_pattern"], F.col)).alias("errors"))


@query("format_checks", "P21", """
SELECT c_custkey,
  regexp_matches(CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE lower(c_mktsegment) || c_custkey || '@example.com' END, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$') AS email,
  regexp_matches(CASE WHEN c_custkey % 5 = 0 THEN 'x' || c_custkey ELSE c_custkey || 'm' END, '^\\d+[m]?$') AS cpu,
  regexp_matches(CASE WHEN c_nationkey % 3 = 0 THEN c_custkey || 'MB' ELSE c_custkey || 'Mi' END, '^\\d+[KMGTPkmgtp]i?$') AS memory,
  regexp_matches(CASE WHEN c_nationkey % 2 = 0 THEN '1.' || c_nationkey || '.0' ELSE '1.' || c_nationkey END, '^\\d+\\.\\d+\\.\\d+$') AS version,
  regexp_matches(c_custkey || substr(lower(c_mktsegment), 1, 1), '^\\d+[smhd]$') AS interval,
  c_custkey * 50 BETWEEN 1 AND 65535 AS ports,
  lower(c_mktsegment) IN ('critical', 'warning', 'info', 'machinery') AS severity
FROM customer
""")
def format_checks(spark, sf):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    txt = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    k, n, seg = key.cast("string"), nation.cast("string"), F.lower("c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey",
        quality.format_ok("email", F.when(key % 7 == 0, F.col("c_name")).otherwise(txt(seg, k, "@example.com"))).alias("email"),
        quality.format_ok("cpu", F.when(key % 5 == 0, txt("x", k)).otherwise(txt(k, "m"))).alias("cpu"),
        quality.format_ok("memory", F.when(nation % 3 == 0, txt(k, "MB")).otherwise(txt(k, "Mi"))).alias("memory"),
        quality.format_ok("version", F.when(nation % 2 == 0, txt("1.", n, ".0")).otherwise(txt("1.", n))).alias("version"),
        quality.format_ok("interval", txt(k, F.substring(seg, 1, 1))).alias("interval"),
        quality.ports_ok(F.array(key * 50)).alias("ports"),
        seg.isin([*quality.SEVERITIES, "machinery"]).alias("severity"),
    )




@query("dotted_path_values", "P24", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CAST(l_tax AS VARCHAR) AS second, l_returnflag AS flag, CAST(NULL AS VARCHAR) AS missing FROM lineitem
""")
def dotted_path_values(spark, sf):
    item = lambda c: F.struct(F.col(c).alias("c"))
    doc = F.to_json(F.struct(
        F.struct(F.array(item("l_quantity"), item("l_tax")).alias("b")).alias("a"), F.col("l_returnflag").alias("flag")
    ))
    d = table(spark, sf, "lineitem").withColumn("doc", doc)
    return d.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
        quality.json_path("doc", "a.b.1.c").alias("second"), quality.json_path("doc", "flag").alias("flag"),
        quality.json_path("doc", "a.x.c").alias("missing"),
    )


ORDER_SCHEMA = {"order": {
    "required": ["priority"],
    "properties": {
        "price": {"type": "number", "minimum": 1000, "maximum": 400000},
        "status": {"enum": ["F", "O"]},
        "priority": {"pattern": "^[1-4]-"},
    },
}}
FIRST = """CASE
  WHEN o_orderpriority IS NULL THEN 'priority: ''priority'' is a required property'
  WHEN TRY_CAST(price AS DOUBLE) IS NULL THEN 'price: ''' || price || ''' is not of type ''number'''
  WHEN TRY_CAST(price AS DOUBLE) < 1000 THEN 'price: ' || price || ' is less than the minimum of 1000'
  WHEN TRY_CAST(price AS DOUBLE) > 400000 THEN 'price: ' || price || ' is greater than the maximum of 400000'
  WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status: ''' || o_orderstatus || ''' is not one of [''F'', ''O'']'
  WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-') THEN 'priority: ''' || o_orderpriority || ''' does not match ''^[1-4]-''' END"""
ORDER_TEXT = "SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN 'free' ELSE CAST(o_totalprice AS VARCHAR) END AS price FROM orders"


def order_records(spark, sf):
    price = F.when(F.col("o_orderkey") % 13 == 0, "free").otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey", price.alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("total"),
    )


@query("first_schema_violation", "P25 S14", f"""
SELECT o_orderkey, {FIRST} AS violation, 'No schema found for scope: nowhere' AS unknown FROM ({ORDER_TEXT})
""")
def first_schema_violation(spark, sf):
    first = quality.first_violation(ORDER_SCHEMA, "order", F.col)
    unknown = quality.first_violation(ORDER_SCHEMA, "nowhere", F.col)
    return order_records(spark, sf).select(
        "o_orderkey", F.concat_ws(": ", first["path"], first["error"]).alias("v"), unknown["error"].alias("unknown")
    ).select("o_orderkey", F.nullif("v", F.lit("")).alias("violation"), "unknown")


RULES = [
    ("order", {"id": "big", "level": "strict", "priority": "high",
               "conditions": [{"field": "status", "operator": "equals", "value": "F"}, {"field": "total", "operator": "greater_than", "value": 100000}],
               "constraints": [{"type": "range", "field": "total", "min": 150000, "max": 350000}]}),
    ("order", {"id": "naming", "level": "strict", "priority": "low",
               "conditions": [{"field": "priority", "operator": "not_contains", "value": "LOW"}, {"field": "status", "operator": "not_equals", "value": "P"}],
               "constraints": [{"type": "pattern", "field": "priority", "pattern": "[12]-"}, {"type": "range", "field": "customer", "max": 700}]}),
    ("order", {"id": "needs", "level": "strict", "priority": "high",
               "conditions": [{"field": "priority", "operator": "contains", "value": "HIGH"}, {"field": "total", "operator": "less_than", "value": 90000}],
               "constraints": [{"type": "dependency", "field": "customer", "depends_on": "returned"}]}),
    ("order", {"id": "other_level", "level": "lenient", "priority": "high", "conditions": [],
               "constraints": [{"type": "range", "field": "total", "max": 0}]}),
    ("elsewhere", {"id": "other_scope", "level": "strict", "priority": "high", "conditions": [],
                   "constraints": [{"type": "range", "field": "total", "max": 0}]}),
]
RETURNED = "SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1"
RULE_CTE = f"""
o AS (SELECT * FROM ({ORDER_TEXT}) LEFT JOIN ({RETURNED}) ON l_orderkey = o_orderkey),
found AS (SELECT o_orderkey, {FIRST} AS schema_error,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN
    CASE WHEN o_totalprice < 150000 THEN 'big: Value ' || CAST(o_totalprice AS VARCHAR) || ' is below minimum 150000'
      WHEN o_totalprice > 350000 THEN 'big: Value ' || CAST(o_totalprice AS VARCHAR) || ' is above maximum 350000' END END AS big,
  CASE WHEN NOT contains(o_orderpriority, 'LOW') AND o_orderstatus <> 'P' THEN
    CASE WHEN NOT regexp_matches(o_orderpriority, '^[12]-') THEN 'naming: Value ' || o_orderpriority || ' does not match pattern [12]-'
      WHEN o_custkey > 700 THEN 'naming: Value ' || CAST(o_custkey AS VARCHAR) || ' is above maximum 700' END END AS naming,
  CASE WHEN contains(o_orderpriority, 'HIGH') AND o_totalprice < 90000 AND returned IS NULL THEN 'needs: Field customer depends on returned' END AS needs
  FROM o)
"""


def rule_table(spark):
    return spark.createDataFrame([(i, scope, json.dumps(rule)) for i, (scope, rule) in enumerate(RULES)], "position int, scope string, rule string")


@query("rules_over_records", "J9 S14 K11 D18", f"""
WITH {RULE_CTE} SELECT o_orderkey, concat_ws(' | ', schema_error, big, needs) AS errors, coalesce(naming, '') AS warnings,
  schema_error IS NULL AND big IS NULL AND needs IS NULL AS is_valid FROM found
""")
def rules_over_records(spark, sf):
    returned = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned")
    )
    r = order_records(spark, sf).join(returned, "o_orderkey", "left")
    out = quality.validate_records(r, "order", "STRICT", ORDER_SCHEMA, quality.load_rules(rule_table(spark)))
    return out.select("o_orderkey", joined("errors").alias("errors"), joined("warnings").alias("warnings"), "is_valid")


@query("pattern_structure", "P26", """
SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'version' END, CASE WHEN c_custkey % 3 = 0 THEN 'rules' END,
  CASE WHEN c_custkey % 5 = 0 THEN 'actions' END) AS missing FROM customer
""")
def pattern_structure(spark, sf):
    k = F.col("c_custkey")
    keep = lambda n: F.when(k % n != 0, F.lit("x"))
    doc = F.to_json(F.struct(
        F.col("c_name").alias("name"), keep(2).alias("version"), F.lit("scaling").alias("type"), F.lit("{}").alias("parameters"),
        keep(3).alias("rules"), keep(5).alias("actions"),
    ))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(quality.missing_fields(doc), ",").alias("missing"))
