"""Forecast, allocation and decision queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import iso
from metricloom.operators import allocate, decide, forecast, oplog, prepare
from metricloom.operators.allocate import Limits
from metricloom.plans import inputs
from metricloom.plans.inputs import HOUR, table
from metricloom.plans.oracle import FILLED, UTIL, iso as siso, r6
from metricloom.plans.q_quality import r4, rounded
from metricloom.plans.registry import query
from metricloom.plans.rounding import round6
from metricloom.session import cut_lineage

#: The configured metrics.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def grid(spark, sf):
    return prepare.regular_grid(inputs.metric_points(spark, sf), HOUR)


# --- forecasts -----------------------------------------------------------------------

LINE = """
line AS (SELECT name, regr_slope(v, i) AS slope, regr_intercept(v, i) AS base, max(i) AS last_i, max(h) AS last_h FROM filled GROUP BY name),
future AS (SELECT *, last_h + to_hours(step) AS ts FROM line CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS step))
"""


@query("linear_forecast", "M1 D11", f"""
WITH {FILLED}, {LINE} SELECT name, {siso('ts')} AS ts, {r6('base + slope * (last_i + step)')} AS value, 0.7::DOUBLE AS confidence, 'linear' AS model FROM future
""")
def linear_forecast(spark, sf):
    out = forecast.linear_forecast(grid(spark, sf), 24 * HOUR, HOUR)
    return out.withColumns({"ts": iso("ts"), "value": round6("value")})


def orthogonal(steps: int) -> str:
    """Centred columns x1..xn and y; each step takes the part along one column out of
    the later ones: the normal equations, solved one unknown at a time."""
    out = []
    for k in range(1, steps):
        rest = ", ".join(f"x{j} - x{k} * coalesce(sum(x{k} * x{j}) OVER () / nullif(sum(x{k} * x{k}) OVER (), 0), 0) AS x{j}" for j in range(k + 1, steps + 1))
        kept = ", ".join(f"x{j}" for j in range(1, k + 1))
        out.append(f"g{k} AS (SELECT h, y, mean_y, {kept}, {rest} FROM g{k - 1})")
    return ",\n".join(out)


@query("frame_forecast", "M1 A1 A2", f"""
WITH {FILLED},
wide AS (SELECT h, max(v) FILTER (name = 'click') AS x1, max(v) FILTER (name = 'error') AS x2, max(v) FILTER (name = 'signup') AS x3,
  max(v) FILTER (name = 'view') AS x4, max(v) FILTER (name = 'purchase') AS y FROM filled GROUP BY h),
g0 AS (SELECT h, avg(y) OVER () AS mean_y, y - avg(y) OVER () AS y, x1 - avg(x1) OVER () AS x1, x2 - avg(x2) OVER () AS x2, x3 - avg(x3) OVER () AS x3, x4 - avg(x4) OVER () AS x4
  FROM wide WHERE x1 + x2 + x3 + x4 + y IS NOT NULL),
{orthogonal(4)},
fit AS (SELECT any_value(mean_y) AS mean_y, {', '.join(f'sum(x{k} * y) / sum(x{k} * x{k}) AS b{k}, max_by(x{k}, h) AS l{k}' for k in range(1, 5))}, max(h) AS last_h FROM g3)
SELECT 'purchase' AS name, {siso('last_h + to_hours(step)')} AS ts, {r6('mean_y + b1 * l1 + b2 * l2 + b3 * l3 + b4 * l4')} AS value,
  0.7::DOUBLE AS confidence, 'linear_frame' AS model FROM fit CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS step)
""")
def frame_forecast(spark, sf):
    frame = prepare.aligned_features(inputs.metric_points(spark, sf), EVENT_TYPES, HOUR)
    others = [n for n in EVENT_TYPES if n != "purchase"]
    out = forecast.frame_forecast(frame, "purchase", others, 24 * HOUR, HOUR)
    return out.withColumns({"ts": iso("ts"), "value": round6("value")})


@query("seasonal_forecast", "M3", f"""
WITH {FILLED}, {LINE},
d AS (SELECT f.name, h, v - (base + slope * i) AS r, hour(h) AS hh, dayofweek(h) AS dd FROM filled f JOIN line USING (name)),
daily AS (SELECT name, hh, avg(r) AS daily FROM d GROUP BY 1, 2),
l AS (SELECT d.*, r - daily AS r2 FROM d JOIN daily USING (name, hh)),
weekly AS (SELECT name, dd, avg(r2) AS weekly FROM l GROUP BY 1, 2),
noise AS (SELECT name, stddev_pop(r2 - weekly) AS sigma FROM l JOIN weekly USING (name, dd) GROUP BY 1)
SELECT f.name, {siso('ts')} AS ts, {r6('base + slope * (last_i + step) + daily + weekly')} AS value, {r6('2 * 1.96 * sigma / 4')} AS confidence
FROM future f JOIN daily ON daily.name = f.name AND hh = hour(ts) JOIN weekly ON weekly.name = f.name AND dd = dayofweek(ts) JOIN noise ON noise.name = f.name
""")
def seasonal_forecast(spark, sf):
    out = forecast.seasonal_forecast(grid(spark, sf), 24 * HOUR, HOUR)
    return out.select("name", iso("ts").alias("ts"), round6("value").alias("value"), round6("confidence").alias("confidence"))


@query("random_forest_forecast", "M2", f"""
WITH {FILLED}, {LINE} SELECT future.name, {siso('ts')} AS ts, true AS in_range, true AS spread_known, 'random_forest' AS model
FROM future JOIN (SELECT name FROM filled GROUP BY name HAVING count(*) >= 100) USING (name) WHERE step <= 12
""")
def random_forest_forecast(spark, sf):
    """The forecasts with what SQL can state about them: a forest averages known
    values, so it stays within their range."""
    g = cut_lineage(grid(spark, sf))
    out = forecast.forest_forecasts(g, EVENT_TYPES, 12 * HOUR, HOUR)
    known = g.groupBy("name").agg(F.min("filled").alias("lo"), F.max("filled").alias("hi"))
    in_range = (F.col("value") >= F.col("lo") - 1e-9) & (F.col("value") <= F.col("hi") + 1e-9)
    return out.join(known, "name").select(
        "name", iso("ts").alias("ts"), in_range.alias("in_range"), (F.col("confidence") >= 0).alias("spread_known"), "model"
    )


@query("supervised_frame", "M9 W16", f"""
WITH {FILLED}, s AS (
  SELECT name, h, list(v) OVER w AS vals, count(v) OVER w AS n, lead(h) OVER (PARTITION BY name ORDER BY h) AS nh, count(*) OVER (PARTITION BY name) AS total
  FROM filled WINDOW w AS (PARTITION BY name ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT name, {siso('h')} AS h, {r6('vals[24]')} AS target, {r6('list_avg(vals[1:23])')} AS mean_feature
FROM s WHERE n = 24 AND nh IS NOT NULL AND total >= 100
""")
def supervised_frame(spark, sf):
    out = forecast.supervised_frame(grid(spark, sf))
    mean = F.aggregate("features", F.lit(0.0), lambda a, x: a + x) / 23
    return out.select("name", iso("h").alias("h"), round6("target").alias("target"), round6(mean).alias("mean_feature"))


PREDICTIONS = """
lags AS (SELECT name, h, v, lag(v) OVER w AS l1, lag(v, 24) OVER w AS l24, avg(v) OVER (PARTITION BY name ORDER BY h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3
  FROM filled WINDOW w AS (PARTITION BY name ORDER BY h)),
preds AS (
  SELECT name, h, 'naive' AS model, l1 AS value, 0.7::DOUBLE AS confidence FROM lags WHERE l24 IS NOT NULL
  UNION ALL SELECT name, h, 'daily', l24, 0.5 FROM lags WHERE l24 IS NOT NULL
  UNION ALL SELECT name, h, 'moving', m3, 0.8 FROM lags WHERE l24 IS NOT NULL),
errs AS (SELECT preds.*, filled.v AS actual, abs(preds.value - filled.v) AS error FROM preds JOIN filled USING (name, h)),
mae AS (SELECT model, avg(error) AS mae FROM (SELECT * FROM errs ORDER BY h DESC, name, model LIMIT 1000) GROUP BY 1),
weights AS (SELECT m.model, mae, CASE WHEN mae IS NULL THEN 0 ELSE (1 / greatest(mae, 1e-9)) / (SELECT sum(1 / greatest(mae, 1e-9)) FROM mae) END AS weight
  FROM (VALUES ('naive'), ('daily'), ('moving'), ('unused')) m(model) LEFT JOIN mae USING (model))
"""


def predictions(spark, sf):
    ordered = Window.partitionBy("name").orderBy("i")
    g = grid(spark, sf).withColumns({
        "naive": F.lag("filled").over(ordered), "daily": F.lag("filled", 24).over(ordered),
        "moving": F.avg("filled").over(ordered.rowsBetween(-3, -1)),
    }).filter(F.col("daily").isNotNull())
    long = g.unpivot(["name", "h"], ["naive", "daily", "moving"], "model", "value")
    confidence = F.when(F.col("model") == "naive", 0.7).when(F.col("model") == "daily", 0.5).otherwise(0.8)
    return long.withColumn("confidence", confidence)


def errors(spark, sf):
    actual = grid(spark, sf).select("name", "h", F.col("filled").alias("value"))
    return forecast.prediction_errors(predictions(spark, sf), actual, ["name", "h"])


def weights(spark, sf):
    models = predictions(spark, sf).select("model").distinct().unionByName(
        spark.createDataFrame([("unused",)], "model string")
    )
    return forecast.model_weights(errors(spark, sf), models, [F.col("h").desc(), F.col("name"), F.col("model")])


@query("prediction_errors", "J13", f"WITH {FILLED}, {PREDICTIONS} SELECT name, {siso('h')} AS h, model, {r6('error')} AS error FROM errs")
def prediction_errors(spark, sf):
    return errors(spark, sf).select("name", iso("h").alias("h"), "model", round6("error").alias("error"))


@query("model_weights", "A20", f"WITH {FILLED}, {PREDICTIONS} SELECT model, {r6('mae')} AS mae, {r6('weight')} AS weight FROM weights")
def model_weights(spark, sf):
    return weights(spark, sf).select("model", round6("mae").alias("mae"), round6("weight").alias("weight"))


@query("ensemble_forecast", "A19 A20", f"""
WITH {FILLED}, {PREDICTIONS}
SELECT name, {siso('h')} AS h, {r6('sum(value * weight * confidence) / sum(weight * confidence)')} AS value, {r6('avg(confidence)')} AS confidence
FROM preds JOIN weights USING (model) GROUP BY name, h HAVING sum(weight * confidence) > 0
""")
def ensemble_forecast(spark, sf):
    out = forecast.ensemble(predictions(spark, sf), weights(spark, sf), ["name", "h"])
    return out.select("name", iso("h").alias("h"), round6("value").alias("value"), round6("confidence").alias("confidence"))


# --- decision input ------------------------------------------------------------------

DECISION = f"""
{UTIL},
base AS (
  SELECT h, {r4('cpu')} AS cpu, {r4('memory')} AS mem, request_rate AS rate, {r4('error_rate')} AS err, {r4('response_time')} AS rt,
    lag({r4('cpu')}) OVER w AS p1, lag({r4('cpu')}, 2) OVER w AS p2, lag({r4('cpu')}, 3) OVER w AS p3 FROM util WINDOW w AS (ORDER BY h)),
dec AS (
  SELECT *, greatest(p1, p2, p3) AS peak, 2 + CAST(rate AS BIGINT) % 5 AS n, 1 + (hour(h) % 3) * 0.5::DOUBLE AS acpu, 1024.0::DOUBLE AS amem,
    cpu * 3 AS tcpu, mem * 2048 AS tmem,
    CASE hour(h) % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 2 THEN NULL ELSE 'UNCERTAIN' END AS tconf FROM base)
"""


def decision_input(spark, sf):
    u = inputs.utilization(spark, sf).select(
        F.lit("all").alias("service"), "h", rounded("cpu").alias("cpu_usage"), rounded("memory").alias("memory_usage"),
        "request_rate", rounded("error_rate").alias("error_rate"), rounded("response_time").alias("response_time"),
    )
    # one row per service and hour: the order runs over decision windows, not raw points
    ordered = Window.partitionBy("service").orderBy("h")
    past = F.array_compact(F.array(*[F.lag("cpu_usage", k).over(ordered) for k in (1, 2, 3)]))
    hour = F.hour("h")
    option = lambda a, m, c, r: F.struct(
        F.lit(a).alias("action"), m.cast("double").alias("magnitude"), F.lit(c).cast("string").alias("confidence"), F.lit(r).alias("reason")
    )
    options = F.array(
        option("rebalance", F.col("request_rate") / 10, "HIGH", "High error share"), option("trim cache", F.lit(None), None, "Spare memory")
    )
    confidence = F.when(hour % 4 == 0, "HIGH").when(hour % 4 == 1, "LOW").when(hour % 4 == 3, "UNCERTAIN")
    return u.withColumn("past", past).select(
        "*", F.when(F.size("past") > 0, F.col("past")).alias("predicted"),
        (2 + F.col("request_rate").cast("bigint") % 5).alias("instances"),
        (1 + (hour % 3) * 0.5).alias("allocated_cpu"), F.lit(1024.0).alias("allocated_memory"),
        (F.col("cpu_usage") * 3).alias("target_cpu"), (F.col("memory_usage") * 2048).alias("target_memory"),
        confidence.alias("target_confidence"),
        F.when(F.col("error_rate") > 0.3, options).alias("optimizations"),
    ).drop("past")


STEP = f"""
{DECISION},
f AS (SELECT *, greatest(coalesce(cpu, 0) / 0.75::DOUBLE, coalesce(mem, 0) / 0.75::DOUBLE, peak / 0.75::DOUBLE) AS f FROM dec),
hz AS (
  SELECT *, CASE WHEN f > 1 AND n < 10 THEN 'scale_out' WHEN f < 0.25 AND n > 1 THEN 'scale_in' ELSE 'no_action' END AS h_action,
    CASE WHEN f > 1 AND n < 10 THEN least(ceil(round(n * (f - 1), 9)), 10 - n) WHEN f < 0.25 AND n > 1 THEN least(ceil(round(n * (1 - f / 0.25::DOUBLE), 9)), n - 1) ELSE 0 END AS h_mag,
    CASE WHEN f > 1 AND n < 10 THEN least(f - 1, 1) WHEN f < 0.25 AND n > 1 THEN least(1 - f / 0.25::DOUBLE, 1) ELSE 1 END AS h_conf FROM f),
vt AS (
  SELECT *, abs(coalesce(tcpu, acpu) - acpu) > 0.1 OR abs(coalesce(tmem, amem) - amem) > 64 AS moved,
    greatest(abs(coalesce(tcpu, acpu) - acpu) / acpu, abs(coalesce(tmem, amem) - amem) / amem) AS size FROM hz)
"""


@query("horizontal_autoscale_step", "K5", f"""
WITH {STEP} SELECT {siso('h')} AS h, h_action AS action, CAST(h_mag AS BIGINT) AS magnitude, {r6('h_conf')} AS confidence,
  CAST(n + CASE h_action WHEN 'scale_out' THEN h_mag ELSE -h_mag END AS BIGINT) AS target,
  {r6("CASE WHEN h_action <> 'no_action' THEN coalesce(cpu, 0) / (n + CASE h_action WHEN 'scale_out' THEN h_mag ELSE -h_mag END) END")} AS cpu_impact,
  {r6("CASE h_action WHEN 'scale_out' THEN coalesce(rt, 0) * 0.8 WHEN 'scale_in' THEN coalesce(rt, 0) * 1.2 END")} AS response_impact,
  {r6("CASE h_action WHEN 'scale_out' THEN h_mag WHEN 'scale_in' THEN -h_mag END * (acpu + amem * 0.1)")} AS cost_impact
FROM hz
""")
def horizontal_autoscale_step(spark, sf):
    out = decide.horizontal_step(decision_input(spark, sf))
    return out.select(
        iso("h").alias("h"), F.col("h_action").alias("action"), F.col("h_magnitude").alias("magnitude"),
        round6("h_confidence").alias("confidence"), F.col("h_target").alias("target"), round6("h_cpu_impact").alias("cpu_impact"),
        round6("h_response_impact").alias("response_impact"), round6("h_cost_impact").alias("cost_impact"),
    )


@query("combined_autoscale_step", "K6 K5 D13", f"""
WITH {STEP}
SELECT {siso('h')} AS h, CASE WHEN h_action <> 'no_action' THEN h_action WHEN NOT moved THEN 'no_action' WHEN coalesce(tcpu, acpu) > acpu THEN 'scale_up' ELSE 'scale_down' END AS action,
  {r6("CASE WHEN h_action <> 'no_action' THEN CAST(h_mag AS DOUBLE) WHEN moved THEN size ELSE 0 END")} AS magnitude FROM vt
""")
def combined_autoscale_step(spark, sf):
    out = decide.combine_steps(decide.vertical_step(decide.horizontal_step(decision_input(spark, sf))))
    return out.select(iso("h").alias("h"), "action", round6("magnitude").alias("magnitude"))


@query("autoscale_with_cooldown", "I7 K6", f"""
WITH RECURSIVE {STEP},
cand AS (SELECT h, row_number() OVER (ORDER BY h) AS k FROM vt WHERE h_action <> 'no_action' OR moved),
fold AS (
  SELECT k, h, h AS last, true AS applied FROM cand WHERE k = 1
  UNION ALL SELECT c.k, c.h, CASE WHEN c.h - f.last >= INTERVAL 4 HOUR THEN c.h ELSE f.last END, c.h - f.last >= INTERVAL 4 HOUR FROM fold f JOIN cand c ON c.k = f.k + 1)
SELECT {siso('h')} AS h, applied FROM fold
""")
def autoscale_with_cooldown(spark, sf):
    out = decide.combine_steps(decide.vertical_step(decide.horizontal_step(decision_input(spark, sf))))
    c = out.filter(F.col("action") != "no_action").select("service", "h")
    return oplog.apply_cooldown(c, ["service"], "h", [], 4 * HOUR).select(iso("h").alias("h"), "applied")


def dec1(expr):
    return f"printf('%.1f', round(CAST({expr} AS DECIMAL(18, 9)), 1)::DOUBLE)"


def dec0(expr):
    return f"printf('%.0f', round(CAST({expr} AS DECIMAL(18, 9)), 0)::DOUBLE)"


def level(expr):
    return f"CASE WHEN {expr} >= 0.8 THEN 'high' WHEN {expr} >= 0.5 THEN 'medium' WHEN {expr} >= 0.2 THEN 'low' ELSE 'uncertain' END"


CANDIDATES = f"""
{DECISION},
ff AS (SELECT *, coalesce(cpu, 0) AS c0, coalesce(mem, 0) AS m0, greatest(coalesce(cpu, 0) / 0.75::DOUBLE, coalesce(mem, 0) / 0.75::DOUBLE, peak / 0.75::DOUBLE) AS f FROM dec),
options AS (
  SELECT h, 1 AS p, 'scale_horizontal' AS decision_type, 'scale_out' AS action, CAST(greatest(least(ceil(round(n * (f - 1), 9)), 10 - n), 0) AS DOUBLE) AS magnitude,
    {level('f - 1')} AS confidence, 'High resource utilization' AS reason,
    concat_ws(' | ', 'Increase number of instances to handle high utilization (CPU: ' || {dec1('c0 * 100')} || '%, Memory: ' || {dec1('m0 * 100')} || '%)',
      'Prepare for predicted workload increase (Peak: ' || {dec1('peak * 100')} || '%)') AS texts
  FROM ff WHERE c0 > 0.7 OR m0 > 0.7 OR peak > 0.7
  UNION ALL
  SELECT h, 2, 'scale_horizontal', 'scale_in', greatest(least(ceil(round(n * (1 - f / 0.25::DOUBLE), 9)), n - 1), 0), {level('1 - f / 0.25::DOUBLE')}, 'Low resource utilization',
    'Decrease number of instances to optimize costs (Current utilization - CPU: ' || {dec1('c0 * 100')} || '%, Memory: ' || {dec1('m0 * 100')} || '%)'
  FROM ff WHERE c0 < 0.3 AND m0 < 0.3 AND (peak IS NULL OR peak < 0.5)
  UNION ALL
  SELECT h, 3, 'scale_vertical', 'scale_up', greatest(tcpu / acpu - 1, tmem / amem - 1), lower(coalesce(tconf, 'medium')), 'Resource optimization recommendation',
    'Adjust resource allocation based on optimization analysis (Target CPU: ' || {dec1('tcpu')} || ', Memory: ' || {dec0('tmem')} || 'MB)'
  FROM ff WHERE tcpu IS NOT NULL AND tmem IS NOT NULL AND (tcpu > acpu * 1.1 OR tmem > amem * 1.1)
  UNION ALL
  SELECT h, 4, 'scale_vertical', 'scale_down', greatest(1 - tcpu / acpu, 1 - tmem / amem), lower(coalesce(tconf, 'medium')), 'Resource optimization recommendation',
    'Adjust resource allocation based on optimization analysis (Target CPU: ' || {dec1('tcpu')} || ', Memory: ' || {dec0('tmem')} || 'MB)'
  FROM ff WHERE tcpu < acpu * 0.9 AND tmem < amem * 0.9
  UNION ALL SELECT h, 5, 'optimize_resources', 'rebalance', rate / 10, 'high', 'High error share', '' FROM ff WHERE err > 0.3
  UNION ALL SELECT h, 6, 'optimize_resources', 'trim cache', 0, 'medium', 'Spare memory', '' FROM ff WHERE err > 0.3
  UNION ALL SELECT h, 7, 'no_action', 'none', 0, 'high', 'No action needed', '' FROM ff),
cands AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY p) - 1 AS position FROM options)
"""


def cands(spark, sf):
    return decide.candidates(decision_input(spark, sf), ["service", "h"])


def candidate_query(name, covers, kinds):
    where = " OR ".join(f"decision_type = '{k}'" for k in kinds)

    @query(name, covers, f"""
    WITH {CANDIDATES} SELECT {siso('h')} AS h, position, decision_type, action, {r6('magnitude')} AS magnitude, confidence, reason, coalesce(texts, '') AS recommendations
    FROM cands WHERE {where}
    """)
    def run(spark, sf):
        return cands(spark, sf).filter(F.col("decision_type").isin(kinds)).select(
            iso("h").alias("h"), F.col("position").cast("bigint").alias("position"), "decision_type", "action",
            round6("magnitude").alias("magnitude"), "confidence", "reason", F.coalesce(F.array_join("recommendations", " | "), F.lit("")).alias("recommendations"),
        )

    return run


candidate_query("horizontal_candidates", "K1 K9", ["scale_horizontal"])
candidate_query("vertical_candidates", "K2 K9", ["scale_vertical"])
candidate_query("optimization_candidates", "K3", ["optimize_resources"])
candidate_query("all_candidates", "U2", ["scale_horizontal", "scale_vertical", "optimize_resources", "no_action"])


DECISIONS = """
decisions AS (
  SELECT o_orderkey AS decision_id, o_orderdate AS ts,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'scale_horizontal' WHEN '2-HIGH' THEN 'scale_horizontal' WHEN '5-LOW' THEN 'no_action' ELSE 'scale_vertical' END AS decision_type,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'scale_out' WHEN '2-HIGH' THEN 'scale_in' WHEN '3-MEDIUM' THEN 'scale_up' WHEN '5-LOW' THEN 'none' ELSE 'scale_down' END AS action
  FROM orders),
impacts AS (
  SELECT l_orderkey AS decision_id, l_shipdate AS ts, l_suppkey AS t1, l_extendedprice AS t2,
    0.02 - l_discount * 2 AS perf, l_tax * 3 AS cost, l_quantity / 50 - 0.2::DOUBLE AS res FROM lineitem WHERE l_returnflag <> 'R'),
judged AS (
  SELECT d.*, coalesce(perf > -0.1 AND cost < 0.2 AND res > 0, false) AS success
  FROM decisions d LEFT JOIN (
    SELECT * FROM impacts QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY ts, t1, t2) = 1) i USING (decision_id)),
rates AS (
  SELECT decision_type, action, avg(CAST(success AS DOUBLE)) AS success_rate, count(*) AS n_decisions
  FROM (SELECT * FROM judged ORDER BY ts DESC, decision_id DESC LIMIT 100) GROUP BY 1, 2)
"""


def decisions(spark, sf):
    p = F.col("o_orderpriority")
    kind = F.when(p.isin("1-URGENT", "2-HIGH"), "scale_horizontal").when(p == "5-LOW", "no_action").otherwise("scale_vertical")
    action = (
        F.when(p == "1-URGENT", "scale_out").when(p == "2-HIGH", "scale_in").when(p == "3-MEDIUM", "scale_up")
        .when(p == "5-LOW", "none").otherwise("scale_down")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("decision_id"), F.col("o_orderdate").alias("ts"), kind.alias("decision_type"), action.alias("action")
    )


def impacts(spark, sf):
    return table(spark, sf, "lineitem").filter("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("decision_id"), F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("t1"),
        F.col("l_extendedprice").alias("t2"), (0.02 - F.col("l_discount") * 2).alias("performance_impact"),
        (F.col("l_tax") * 3).alias("cost_impact"), (F.col("l_quantity") / 50 - 0.2).alias("resource_efficiency"),
    )


def judged(spark, sf):
    return decide.judged_decisions(decisions(spark, sf), impacts(spark, sf), ["ts", "t1", "t2"])


def rates(spark, sf):
    return decide.success_rates(judged(spark, sf), [F.col("ts").desc(), F.col("decision_id").desc()])


@query("decisions_with_outcome", "J12", f"WITH {DECISIONS} SELECT decision_id, success FROM judged")
def decisions_with_outcome(spark, sf):
    return judged(spark, sf).select("decision_id", "success")


@query("success_rates", "A22 W9", f"WITH {DECISIONS} SELECT decision_type, action, {r6('success_rate')} AS success_rate, n_decisions FROM rates")
def success_rates(spark, sf):
    return rates(spark, sf).withColumn("success_rate", round6("success_rate"))


@query("mean_impacts_per_action", "A28", f"""
WITH {DECISIONS} SELECT action, {r6('avg(perf)')} AS performance_impact, {r6('avg(cost)')} AS cost_impact, {r6('avg(res)')} AS resource_efficiency, count(*) AS n_samples
FROM decisions JOIN impacts USING (decision_id) GROUP BY 1
""")
def mean_impacts_per_action(spark, sf):
    out = decide.mean_impacts(decisions(spark, sf), impacts(spark, sf))
    return out.select("action", *[round6(c).alias(c) for c in ("performance_impact", "cost_impact", "resource_efficiency")], "n_samples")


@query("predicted_impacts", "K13 A28", f"""
WITH {DECISIONS}, learned AS (SELECT action, avg(perf) AS p, avg(cost) AS c, avg(res) AS r FROM decisions JOIN impacts USING (decision_id) GROUP BY 1),
fixed(action) AS (VALUES ('scale_out'), ('scale_in'), ('scale_up'), ('scale_down'))
SELECT coalesce(f.action, l.action) AS action, {r6('coalesce(p, 0.1)')} AS performance_impact, {r6('coalesce(c, -0.1)')} AS cost_impact,
  {r6('coalesce(r, 0.2)')} AS resource_efficiency, p IS NOT NULL AS learned FROM fixed f FULL JOIN learned l ON l.action = f.action
""")
def predicted_impacts(spark, sf):
    out = decide.learned_impact(decide.mean_impacts(decisions(spark, sf), impacts(spark, sf)))
    return out.select("action", *[round6(c).alias(c) for c in ("performance_impact", "cost_impact", "resource_efficiency")], "learned")


@query("impact_feature_vector", "K13", f"""
WITH {DECISION} SELECT {siso('h')} AS h, {r6('coalesce(cpu, 0) + coalesce(mem, 0) + rate + err + coalesce(tcpu, 0) + coalesce(tmem, 0)')} AS total, CAST(6 AS INTEGER) AS width FROM dec
""")
def impact_feature_vector(spark, sf):
    d = decision_input(spark, sf).withColumn("x", decide.impact_features())
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return d.select(iso("h").alias("h"), round6(total).alias("total"), F.size("x").alias("width"))


SCORED = f"""
{CANDIDATES}, {DECISIONS},
scored AS (
  SELECT c.*, 0.3 * CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.4 ELSE 0.2 END
    + 0.3 * CASE WHEN action IN ('scale_out', 'scale_in', 'scale_up', 'scale_down') THEN 0.4 * 1.1::DOUBLE + 0.3 * 1.1 + 0.3 * 0.2 ELSE 0.5 END
    + 0.2 * (1 - least(1, CASE decision_type WHEN 'scale_horizontal' THEN 0.3::DOUBLE WHEN 'scale_vertical' THEN 0.5 WHEN 'optimize_resources' THEN 0.4 ELSE 0.1 END
        * least(1, magnitude / 2) * CASE confidence WHEN 'high' THEN 0.7::DOUBLE WHEN 'medium' THEN 1.0 WHEN 'low' THEN 1.3 ELSE 1.5 END))
    + 0.2 * coalesce(success_rate, 0.5) AS score
  FROM cands c LEFT JOIN rates USING (decision_type, action))
"""


@query("candidate_scores", "K4", f"WITH {SCORED} SELECT {siso('h')} AS h, position, action, {r6('score')} AS score FROM scored")
def candidate_scores(spark, sf):
    out = decide.score_candidates(cands(spark, sf), rates(spark, sf))
    return out.select(iso("h").alias("h"), F.col("position").cast("bigint").alias("position"), "action", round6("score").alias("score"))


@query("best_decision", "L3 K4 U2", f"""
WITH {SCORED}, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY h ORDER BY round(score, 12) DESC, position) = 1),
w AS (SELECT *, round(score, 12) < 0.75 AND decision_type <> 'no_action' AS weak FROM best)
SELECT {siso('h')} AS h, CASE WHEN weak THEN 'no_action' ELSE decision_type END AS decision_type, CASE WHEN weak THEN 'none' ELSE action END AS action,
  {r6('CASE WHEN weak THEN 0 ELSE magnitude END')} AS magnitude, CASE WHEN weak THEN 'No candidate met minimum confidence threshold' ELSE reason END AS reason,
  {r6('score')} AS best_score FROM w
""")
def best_decision(spark, sf):
    out = decide.choose_best(decide.score_candidates(cands(spark, sf), rates(spark, sf)), ["service", "h"], 0.75)
    return out.select(iso("h").alias("h"), "decision_type", "action", round6("magnitude").alias("magnitude"), "reason", round6("best_score").alias("best_score"))


@query("parameterised_rules", "K12", f"""
WITH {DECISION}, a AS (
  SELECT *, CASE WHEN coalesce(cpu, 0) * 100 > 75 THEN 'scale_up' WHEN coalesce(cpu, 0) * 100 < 75 * 0.7 THEN 'scale_down' ELSE 'none' END AS act FROM dec)
SELECT {siso('h')} AS h, act AS rule_action, CAST(CASE act WHEN 'scale_up' THEN least(greatest(n + 2, 1), 5) WHEN 'scale_down' THEN least(greatest(n - 1, 1), 5) ELSE n END AS BIGINT) AS new_replicas FROM a
""")
def parameterised_rules(spark, sf):
    out = decide.apply_rules(
        decision_input(spark, sf).withColumn("cpu_percent", F.coalesce("cpu_usage", F.lit(0.0)) * 100),
        {"min_replicas": 1, "max_replicas": 5, "target_cpu_utilization": 75},
        [{"condition": "cpu_percent > target_cpu_utilization", "action": "scale_up"},
         {"condition": "cpu_percent < (target_cpu_utilization * 0.7)", "action": "scale_down"}],
        {"scale_up": {"delta": 2}, "scale_down": {"delta": -1}},
    )
    return out.select(iso("h").alias("h"), "rule_action", "new_replicas")


# --- allocation ----------------------------------------------------------------------

DEMAND = f"""
{DECISION},
demand AS (SELECT h, coalesce(cpu, 0) * 2 AS cu, coalesce(mem, 0) * 4096 AS mu, coalesce(rt, 100) AS rt, peak * 2 AS peak FROM dec)
"""


def demand(spark, sf):
    d = decision_input(spark, sf)
    return d.select(
        "service", "h", (F.col("cpu_usage") * 2).alias("cpu_usage"), (F.col("memory_usage") * 4096).alias("memory_usage"),
        "response_time", F.transform("predicted", lambda x: x * 2).alias("predicted"),
    )


COST = """wp * greatest(0, rt * greatest(cu / c, mu / m) - 100) ** 2 + wr * (c * 1.0::DOUBLE + m * 0.1::DOUBLE)
  + wk * (-least((c - cu) / c, (m - mu) / m) + CASE WHEN peak IS NULL THEN 0 ELSE greatest(0, peak - c) END)"""


def search(cpu_step, cpu_n, mem_step, mem_n, weights):
    return f"""
{DEMAND},
strat(strategy, wp, wr, wk) AS (VALUES {weights}),
g AS (SELECT 0.1::DOUBLE + i * {cpu_step}::DOUBLE AS c, 128.0::DOUBLE + j * {mem_step}::DOUBLE AS m
  FROM (SELECT unnest(generate_series(0, {cpu_n})) AS i) CROSS JOIN (SELECT unnest(generate_series(0, {mem_n})) AS j)),
priced AS (SELECT h, strategy, c, m, {COST} AS cost FROM demand CROSS JOIN strat CROSS JOIN g WHERE c - cu - 0.2 >= 0 AND m - mu - 0.2 >= 0),
best AS (SELECT h, strategy, min((cost, c, m)) AS b FROM priced GROUP BY 1, 2),
chosen AS (SELECT d.*, s.strategy, b[1] AS cost, b[2] AS c, b[3] AS m FROM demand d CROSS JOIN strat s LEFT JOIN best ON best.h = d.h AND best.strategy = s.strategy)
"""


LIMITS = Limits(memory_cost=0.1)
ALL_WEIGHTS = ", ".join(f"('{n}', {p}::DOUBLE, {r}::DOUBLE, {k}::DOUBLE)" for n, p, r, k in allocate.STRATEGIES)
BALANCED = search(0.1, 39, 64, 126, "('balanced', 0.4::DOUBLE, 0.3::DOUBLE, 0.3::DOUBLE)")


def balanced(spark, sf):
    return allocate.best_allocation(allocate.with_strategies(demand(spark, sf), ["balanced"]), LIMITS)


@query("cheapest_allocation", "J8 K7 D12", f"WITH {BALANCED} SELECT {siso('h')} AS h, {r6('c')} AS cpu_allocation, {r6('m')} AS memory_allocation, {r6('cost')} AS cost FROM chosen")
def cheapest_allocation(spark, sf):
    return balanced(spark, sf).select(
        iso("h").alias("h"), round6("cpu_allocation").alias("cpu_allocation"), round6("memory_allocation").alias("memory_allocation"), round6("cost").alias("cost")
    )


@query("allocation_by_strategy", "K7 J8", f"""
WITH {search(0.1, 39, 64, 126, ALL_WEIGHTS)}
SELECT {siso('h')} AS h, strategy, {r6('c')} AS cpu_allocation, {r6('m')} AS memory_allocation FROM chosen
""")
def allocation_by_strategy(spark, sf):
    out = allocate.best_allocation(allocate.with_strategies(demand(spark, sf)), LIMITS)
    return out.select(iso("h").alias("h"), "strategy", round6("cpu_allocation").alias("cpu_allocation"), round6("memory_allocation").alias("memory_allocation"))


@query("allocation_scores", "K8", f"""
WITH {BALANCED}
SELECT {siso('h')} AS h, {r6('least(1, least((c - cu) / c, (m - mu) / m) * 0.9)')} AS confidence, {r6('CASE WHEN c IS NOT NULL THEN greatest(0, 1 - rt * greatest(cu / c, mu / m) / 100) ELSE NULL END')} AS performance,
  {r6('CASE WHEN c IS NOT NULL THEN greatest(0, cu + mu * 0.1 - (c + m * 0.1)) END')} AS savings,
  {r6('CASE WHEN c IS NOT NULL THEN least(1, greatest(0, -least((c - cu) / c, (m - mu) / m) + coalesce(greatest(0, CASE WHEN peak IS NOT NULL THEN peak - c END), 0))) END')} AS risk
FROM chosen WHERE c IS NOT NULL
""")
def allocation_scores(spark, sf):
    a = balanced(spark, sf).filter(F.col("cpu_allocation").isNotNull()).withColumn("accuracy", F.lit(0.9))
    out = allocate.score_allocation(a, LIMITS)
    return out.select(iso("h").alias("h"), *[round6(c).alias(c) for c in ("confidence", "performance", "savings", "risk")])


@query("allocation_recommendations", "K9", f"""
WITH {BALANCED}
SELECT {siso('h')} AS h, concat_ws(' | ',
  CASE WHEN abs(c - cu) > 0.1 THEN 'Recommend ' || CASE WHEN c > cu THEN 'increase' ELSE 'decrease' END || ' CPU allocation by ' || {dec1('abs(c - cu)')} || ' cores' END,
  CASE WHEN abs(m - mu) > 64 THEN 'Recommend ' || CASE WHEN m > mu THEN 'increase' ELSE 'decrease' END || ' memory allocation by ' || {dec0('abs(m - mu)')} || ' MB' END,
  CASE WHEN peak > c THEN 'Warning: Predicted workload exceeds recommended CPU allocation' END) AS recommendations FROM chosen
""")
def allocation_recommendations(spark, sf):
    texts = allocate.allocation_recommendations(LIMITS)
    return balanced(spark, sf).select(iso("h").alias("h"), F.array_join(texts, " | ").alias("recommendations"))


@query("recent_accuracy", "A27", f"""
WITH {UTIL} SELECT {siso('h')} AS h, {r6('coalesce(avg(1 - error_rate) OVER (ORDER BY h ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 1)')} AS accuracy FROM util
""")
def recent_accuracy(spark, sf):
    u = inputs.utilization(spark, sf).select(F.lit("all").alias("service"), "h", (1 - F.col("error_rate")).alias("confidence"))
    return allocate.recent_accuracy(u, ["service"], "h").select(iso("h").alias("h"), round6("accuracy").alias("accuracy"))


@query("latest_tracked_metrics", "L7", """
SELECT 'user-' || c_custkey AS name, coalesce(v, 0) AS last_value FROM customer
LEFT JOIN (SELECT user_id, max_by(value, (ts, event_id)) AS v FROM events GROUP BY 1) ON user_id = c_custkey
""")
def latest_tracked_metrics(spark, sf):
    name = lambda c: F.concat(F.lit("user-"), F.col(c).cast("string")).alias("name")
    p = table(spark, sf, "events").select(name("user_id"), "ts", "event_id", "value")
    return allocate.latest_metrics(p, table(spark, sf, "customer").select(name("c_custkey")), ["event_id"])
