"""Threshold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.scalars import iso, register_comparator, violates
from metricloom.operators import thresholds, windows
from metricloom.plans import inputs
from metricloom.plans.inputs import HOUR, table
from metricloom.plans.oracle import iso as siso, r6
from metricloom.plans.registry import query
from metricloom.plans.rounding import round6

WINDOW = 24 * HOUR
CONFIG = [
    ("click", "static", ">", 60.0, None, None, None, None, None),
    ("error", "time_based", ">=", 50.0, None, None, None, None, [("0-6", 85.0), ("6-18", 40.0), ("12-20", 5.0)]),
    ("purchase", "percentile", ">", 50.0, None, None, None, 90.0, None),
    ("signup", "adaptive", ">", 70.0, 0.1, 60.0, 95.0, None, None),
    ("view", "dynamic", "<", 20.0, None, None, None, None, None),
]


def config(spark):
    return thresholds.config_table(spark, CONFIG)


def points(spark, sf):
    return inputs.metric_points(spark, sf).select("point_id", "name", "ts", "value")


RAW_CONFIG = """
raw AS (
  SELECT c_name AS name,
    CASE c_custkey % 6 WHEN 0 THEN 'static' WHEN 1 THEN 'dynamic' WHEN 2 THEN 'adaptive' WHEN 3 THEN 'time_based'
      WHEN 4 THEN 'percentile' ELSE 'bogus' END AS threshold_type,
    CASE c_nationkey % 4 WHEN 0 THEN '>' WHEN 1 THEN '<=' WHEN 2 THEN '!=' ELSE '=>' END AS operator,
    CASE WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS value
  FROM customer),
loaded AS (
  SELECT name, threshold_type, operator, TRY_CAST(value AS DOUBLE) AS value FROM raw
  WHERE threshold_type <> 'bogus' AND operator <> '=>' AND TRY_CAST(value AS DOUBLE) IS NOT NULL)
"""


def raw_config(spark, sf):
    pick = lambda options, i: F.element_at(F.array(*[F.lit(o) for o in options]), (i + 1).cast("int"))
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("name"),
        pick(["static", "dynamic", "adaptive", "time_based", "percentile", "bogus"], F.col("c_custkey") % 6).alias("threshold_type"),
        pick([">", "<=", "!=", "=>"], F.col("c_nationkey") % 4).alias("operator"),
        F.when(F.col("c_custkey") % 11 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("value"),
    )


@query("load_threshold_config", "S15 D10", f"WITH {RAW_CONFIG} SELECT * FROM loaded")
def load_threshold_config(spark, sf):
    return thresholds.load_config(raw_config(spark, sf))


@query("upsert_and_remove_thresholds", "S15", f"""
WITH {RAW_CONFIG},
changes AS (SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
gone AS (SELECT c_name AS name FROM customer WHERE c_mktsegment = 'MACHINERY'),
merged AS (
  SELECT * FROM loaded WHERE name NOT IN (SELECT name FROM changes)
  UNION ALL SELECT name, 'static', '>', value FROM changes)
SELECT * FROM merged WHERE name NOT IN (SELECT name FROM gone)
""")
def upsert_and_remove_thresholds(spark, sf):
    loaded = thresholds.load_config(raw_config(spark, sf))
    changes = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").groupBy(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name")
    ).agg(F.max("o_totalprice").alias("value")).select(
        "name", F.lit("static").alias("threshold_type"), F.lit(">").alias("operator"), "value"
    )
    gone = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_name").alias("name"))
    return thresholds.remove_config(thresholds.upsert_config(loaded, changes), gone)


OPS = [">", "<", ">=", "<=", "==", "!="]
OP_SQL = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(OPS)) + " END"


@query("comparison_operators", "P13 X1", f"""
SELECT event_id, op, CASE op WHEN '>' THEN value > t WHEN '<' THEN value < t WHEN '>=' THEN value >= t WHEN '<=' THEN value <= t
  WHEN '==' THEN abs(value - t) < 0.000001 ELSE abs(value - t) >= 0.000001 END AS violation
FROM (SELECT event_id, {OP_SQL} AS op, value, round(value) AS t FROM events)
""")
def comparison_operators(spark, sf):
    op = F.element_at(F.array(*[F.lit(o) for o in OPS]), (F.col("event_id") % 6 + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", op.alias("op"), "value", F.round("value").alias("t"))
    return e.select("event_id", "op", violates("op", "value", "t").alias("violation"))


@query("custom_comparator", "X1", "SELECT event_id, abs(value - 50) > 10 AS violation FROM events")
def custom_comparator(spark, sf):
    register_comparator("off_by_ten", lambda x, t: F.abs(x - t) > 10)
    e = table(spark, sf, "events").withColumn("op", F.lit("off_by_ten"))
    return e.select("event_id", violates("op", "value", F.lit(50.0)).alias("violation"))


@query("time_of_day_threshold", "J4", """
SELECT event_id, CASE WHEN hour(ts) >= 0 AND hour(ts) < 6 THEN 85.0::DOUBLE WHEN hour(ts) >= 6 AND hour(ts) < 18 THEN 40.0::DOUBLE
  WHEN hour(ts) >= 12 AND hour(ts) < 20 THEN 5.0::DOUBLE ELSE 50.0::DOUBLE END AS threshold
FROM events WHERE event_type = 'error'
""")
def time_of_day_threshold(spark, sf):
    joined = thresholds.with_config(points(spark, sf), config(spark).withColumnRenamed("value", "base"))
    joined = joined.filter(F.col("threshold_type") == "time_based")
    value = thresholds.time_based_value(F.col("ts"), F.col("time_windows"), F.col("base"))
    return joined.select(F.col("point_id").alias("event_id"), value.alias("threshold"))


@query("points_with_thresholds", "J5", """
SELECT e.event_id, true AS known, o.avg_price > e.value AS below FROM events e
JOIN (SELECT o_custkey, avg(o_totalprice) / 1000 AS avg_price FROM orders GROUP BY 1) o ON o.o_custkey = e.user_id
UNION ALL
SELECT event_id, false, NULL FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)
""")
def points_with_thresholds(spark, sf):
    p = table(spark, sf, "events").select("event_id", F.col("user_id").alias("name"), "value")
    limits = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("name")).agg((F.avg("o_totalprice") / 1000).alias("avg_price"))
    known = thresholds.with_config(p, limits).select("event_id", F.lit(True).alias("known"), (F.col("avg_price") > F.col("value")).alias("below"))
    unknown = thresholds.unknown_metrics(p, limits).select(
        "event_id", F.lit(False).alias("known"), F.lit(None).cast("boolean").alias("below")
    )
    return known.unionByName(unknown)


@query("trailing_percentile", "W8", f"""
SELECT event_id, {r6('quantile_cont(value, 0.9) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW)')} AS percentile_value
FROM events
""")
def trailing_percentile(spark, sf):
    p = points(spark, sf).withColumn("pct", F.lit(90.0))
    out = thresholds.trailing_percentile(p, ["name"], "pct", window_seconds=WINDOW)
    return out.select(F.col("point_id").alias("event_id"), round6("percentile_value").alias("percentile_value"))


TARGETS = """
hours AS (SELECT unnest(generate_series(
    (SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) + INTERVAL 1 HOUR AS t),
targets AS (
  SELECT event_type AS name, t, avg(value) + 2 * stddev_pop(value) AS target
  FROM hours JOIN events ON ts >= t - INTERVAL 24 HOUR AND ts < t
  JOIN (SELECT event_type AS n, date_trunc('hour', max(ts)) + INTERVAL 1 HOUR AS last FROM events GROUP BY 1) ON n = event_type AND t <= last
  GROUP BY 1, 2)
"""
FOLD = TARGETS + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY t) AS k FROM targets WHERE name = 'signup'),
fold AS (
  SELECT name, t, k, least(greatest(70 * 0.9 + 0.1 * target, 60), 95) AS threshold FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.name, o.t, o.k, least(greatest(f.threshold * 0.9 + 0.1 * o.target, 60), 95)
  FROM fold f JOIN ordered o ON o.name = f.name AND o.k = f.k + 1)
"""


@query("window_targets", "A26", f"WITH {TARGETS} SELECT name, {siso('t')} AS tick_ts, {r6('target')} AS target FROM targets")
def window_targets(spark, sf):
    out = thresholds.pane_targets(points(spark, sf), HOUR, WINDOW)
    return out.select("name", iso("tick_ts").alias("tick_ts"), round6("target").alias("target"))


@query("window_mean_and_deviation", "A26", f"""
SELECT event_type AS name, {r6('avg(value)')} AS mean_value, {r6('stddev_pop(value)')} AS std_value,
  {r6('avg(value) + 2 * stddev_pop(value)')} AS target
FROM events WHERE ts > TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-25' GROUP BY 1
""")
def window_mean_and_deviation(spark, sf):
    lo, hi = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-24", "2024-01-25"))
    recent = points(spark, sf).filter((F.col("ts") > lo) & (F.col("ts") <= hi))
    out = thresholds.window_target(recent, ["name"])
    return out.select("name", *[round6(c).alias(c) for c in ("mean_value", "std_value", "target")])


@query("adaptive_threshold_fold", "M8", f"""
WITH RECURSIVE {FOLD} SELECT name, {siso('t')} AS tick_ts, {r6('threshold')} AS threshold FROM fold
""")
def adaptive_threshold_fold(spark, sf):
    targets = thresholds.pane_targets(points(spark, sf), HOUR, WINDOW)
    out = thresholds.adapt_thresholds(targets, config(spark), ticks_per_chunk=50)
    return out.select("name", iso("tick_ts").alias("tick_ts"), round6("threshold").alias("threshold"))


EVALUATED = FOLD + """,
pct AS (
  SELECT event_id, quantile_cont(value, 0.9) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) AS p
  FROM events WHERE event_type = 'purchase'),
ada AS (
  SELECT event_id, threshold AS a FROM (
    SELECT event_id, threshold, row_number() OVER (PARTITION BY event_id ORDER BY t DESC) AS rn
    FROM events JOIN fold ON t <= ts WHERE event_type = 'signup') WHERE rn = 1),
evaluated AS (
  SELECT e.event_id, event_type AS name, ts, value, CASE event_type
      WHEN 'click' THEN 60 WHEN 'view' THEN 20 WHEN 'purchase' THEN p WHEN 'signup' THEN coalesce(a, 70)
      ELSE CASE WHEN hour(ts) < 6 THEN 85 WHEN hour(ts) < 18 THEN 40 WHEN hour(ts) < 20 THEN 5 ELSE 50 END END AS threshold
  FROM events e LEFT JOIN pct USING (event_id) LEFT JOIN ada USING (event_id)),
judged AS (
  SELECT *, CASE name WHEN 'error' THEN value >= threshold WHEN 'view' THEN value < threshold ELSE value > threshold END AS violation
  FROM evaluated)
"""


@query("evaluate_thresholds", "P29 P13 J4 J5 W8 M8", f"""
WITH RECURSIVE {EVALUATED} SELECT event_id, name, {r6('threshold')} AS threshold, violation FROM judged
""")
def evaluate_thresholds(spark, sf):
    out = thresholds.evaluate_points(points(spark, sf), config(spark), ["point_id"], WINDOW, HOUR)
    return out.select(F.col("point_id").alias("event_id"), "name", round6("threshold").alias("threshold"), "violation")


@query("running_violation_rate", "W10", """
SELECT event_id, sum(CAST(value > 60 AS BIGINT)) OVER w / CAST(count(*) OVER w AS DOUBLE) AS violation_rate
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
""")
def running_violation_rate(spark, sf):
    e = points(spark, sf).withColumn("violation", F.col("value") > 60)
    out = thresholds.running_violation_rate(e, ["name"], ["point_id"])
    return out.select(F.col("point_id").alias("event_id"), "violation_rate")


@query("threshold_status_report", "A29", f"""
WITH RECURSIVE {EVALUATED},
cfg(name, threshold_type, operator, original_value) AS (VALUES
  ('click', 'static', '>', 60.0::DOUBLE), ('error', 'time_based', '>=', 50.0), ('purchase', 'percentile', '>', 50.0),
  ('signup', 'adaptive', '>', 70.0), ('view', 'dynamic', '<', 20.0)),
last5 AS (SELECT * FROM fold ORDER BY k DESC LIMIT 5)
SELECT cfg.*, {r6("CASE WHEN threshold_type = 'adaptive' THEN (SELECT max_by(threshold, k) FROM last5) ELSE original_value END")} AS current_value,
  {r6('(SELECT avg(CAST(violation AS DOUBLE)) FROM judged WHERE judged.name = cfg.name)')} AS violation_rate,
  CASE WHEN threshold_type = 'adaptive' THEN (SELECT string_agg({siso('t')}, ',' ORDER BY k) FROM last5) ELSE '' END AS adapted_at
FROM cfg
""")
def threshold_status_report(spark, sf):
    p, c = points(spark, sf), config(spark)
    adapted = thresholds.adapt_thresholds(thresholds.pane_targets(p, HOUR, WINDOW), c)
    evaluated = thresholds.evaluate_points(p, c, ["point_id"], WINDOW, HOUR)
    out = thresholds.threshold_status(c, evaluated, adapted)
    return out.select(
        "name", "threshold_type", "operator", "original_value", round6("current_value").alias("current_value"),
        round6("violation_rate").alias("violation_rate"),
        F.array_join(F.transform("adaptations", lambda a: iso(a["tick_ts"])), ",").alias("adapted_at"),
    )


@query("held_alert_rule", "W19 D19", f"""
WITH f AS (SELECT event_id, event_type AS name, ts, value > 50 AS bad, lag(value > 50) OVER w AS was FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN bad AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY ts, event_id) AS run FROM f)
SELECT name, {siso('min(ts)')} AS start_ts, {siso('max(ts)')} AS end_ts, count(*) AS n_points,
  {r6('epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6')} AS held_seconds, 'warning' AS severity
FROM g WHERE bad GROUP BY name, run HAVING max(ts) - min(ts) >= INTERVAL 1 HOUR
""")
def held_alert_rule(spark, sf):
    out = thresholds.held_alerts(points(spark, sf), ["name"], ["point_id"], F.col("value") > 50, HOUR)
    return out.select(
        "name", iso("start_ts").alias("start_ts"), iso("end_ts").alias("end_ts"), "n_points",
        round6("held_seconds").alias("held_seconds"), F.lit("warning").alias("severity"),
    )


@query("scaling_rate_check", "W18", """
SELECT event_id, count(*) OVER w AS n_recent, count(*) OVER w > 3 AS too_many FROM events
WINDOW w AS (PARTITION BY user_id % 10 ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW)
""")
def scaling_rate_check(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 10).alias("service"), "ts"
    )
    out = windows.trailing_count(e, ["service"], "ts", 12 * HOUR)
    return out.select("event_id", "n_recent", (F.col("n_recent") > 3).alias("too_many"))
