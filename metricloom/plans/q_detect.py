"""Grid, detector and raw window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.scalars import iso
from metricloom.operators import detect, prepare, windows
from metricloom.operators.chunks import positions
from metricloom.plans import inputs
from metricloom.plans.inputs import EVENT_TYPES, HOUR, table
from metricloom.plans.oracle import FILLED, GRID, iso as siso, r6
from metricloom.plans.registry import query
from metricloom.plans.rounding import round6

PERIOD = 24


def grid(spark, sf, step=HOUR):
    return prepare.regular_grid(inputs.metric_points(spark, sf), step)


@query("pivot_mean_per_timestamp", "A1", f"""
SELECT {siso('ts')} AS ts, {', '.join(f"avg(value) FILTER (WHERE event_type = '{n}') AS {n}" for n in EVENT_TYPES)}
FROM events GROUP BY ts
""")
def pivot_mean_per_timestamp(spark, sf):
    out = prepare.pivot_metrics(prepare.mean_per_timestamp(inputs.metric_points(spark, sf)), EVENT_TYPES)
    return out.withColumn("ts", iso("ts"))


@query("resample_to_grid", "A2", f"""
WITH {GRID} SELECT name, {siso('h')} AS h, {r6('v')} AS value FROM grid
""")
def resample_to_grid(spark, sf):
    return grid(spark, sf).select("name", iso("h").alias("h"), round6("value").alias("value"))


@query("forward_fill", "W4", f"""
WITH {FILLED} SELECT name, {siso('h')} AS h, {r6('pv')} AS value FROM near
""")
def forward_fill(spark, sf):
    return grid(spark, sf).select("name", iso("h").alias("h"), round6("carried").alias("value"))


@query("interpolate_gaps", "W5", f"""
WITH {FILLED} SELECT name, {siso('h')} AS h, {r6('v')} AS value FROM filled
""")
def interpolate_gaps(spark, sf):
    return grid(spark, sf).select("name", iso("h").alias("h"), round6("filled").alias("value"))


@query("interpolate_per_user", "W5 A2", f"""
WITH {FILLED.replace('event_type', 'user_id')}
SELECT name, {siso('h')} AS h, {r6('v')} AS value FROM filled
""")
def interpolate_per_user(spark, sf):
    p = inputs.metric_points(spark, sf).withColumn("name", F.col("user_id"))
    return prepare.regular_grid(p, HOUR).select("name", iso("h").alias("h"), round6("filled").alias("value"))


@query("align_series_wide", "J1", f"""
WITH {FILLED}
SELECT {siso('h')} AS h, {', '.join(r6(f"max(v) FILTER (WHERE name = '{n}')") + f' AS {n}' for n in EVENT_TYPES)}
FROM filled GROUP BY h
""")
def align_series_wide(spark, sf):
    out = prepare.aligned_features(inputs.metric_points(spark, sf), EVENT_TYPES, HOUR)
    return out.select(iso("h").alias("h"), *[round6(n).alias(n) for n in EVENT_TYPES])


ROLL = f"""
{FILLED},
roll AS (
  SELECT name, h, i, v,
    CASE WHEN count(v) OVER w = 60 THEN avg(v) OVER w END AS m,
    CASE WHEN count(v) OVER w = 60 THEN stddev_samp(v) OVER w END AS s
  FROM filled WINDOW w AS (PARTITION BY name ORDER BY h ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
z AS (
  SELECT *, CASE WHEN s > 0 THEN (v - m) / s END AS z, coalesce(s > 0 AND abs((v - m) / s) > 2, false) AS bad FROM roll)
"""


@query("rolling_mean_std", "W1", f"""
WITH {ROLL} SELECT name, {siso('h')} AS h, {r6('m')} AS rolling_mean, {r6('s')} AS rolling_std FROM roll
""")
def rolling_mean_std(spark, sf):
    out = detect.rolling_stats(grid(spark, sf))
    return out.select(
        "name", iso("h").alias("h"), round6("rolling_mean").alias("rolling_mean"), round6("rolling_std").alias("rolling_std")
    )


@query("rolling_z_anomalies", "W2", f"""
WITH {ROLL} SELECT name, {siso('h')} AS h, {r6('z')} AS z FROM z WHERE bad
""")
def rolling_z_anomalies(spark, sf):
    out = detect.rolling_anomalies(grid(spark, sf)).filter("anomalous")
    return out.select("name", iso("h").alias("h"), round6("z").alias("z"))


RANGES = f"""
{ROLL},
marked AS (SELECT *, CASE WHEN bad AND NOT coalesce(lag(bad) OVER (PARTITION BY name ORDER BY h), false) THEN 1 ELSE 0 END AS opens FROM z),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY name ORDER BY h) AS run, lead(h) OVER (PARTITION BY name ORDER BY h) AS nh FROM marked),
ranges AS (
  SELECT name, min(h) AS s, coalesce(max_by(nh, h), max(h)) AS e, max(abs(z)) AS severity FROM numbered WHERE bad GROUP BY name, run)
"""


@query("anomaly_ranges", "W3", f"""
WITH {RANGES} SELECT name, {siso('s')} AS start_ts, {siso('e')} AS end_ts, {r6('severity')} AS severity FROM ranges
""")
def anomaly_ranges(spark, sf):
    out = detect.anomaly_ranges(detect.rolling_anomalies(grid(spark, sf)), HOUR)
    return out.select("name", iso("start_ts").alias("start_ts"), iso("end_ts").alias("end_ts"), round6("severity").alias("severity"))


SLOPES = f"""
slopes AS (
  SELECT name, regr_slope(v, i) AS slope, min(h) AS s, max(h) AS e FROM filled
  GROUP BY name HAVING count(v) = count(*))
"""


@query("trend_per_metric", "A8", f"""
WITH {FILLED}, {SLOPES}
SELECT name, {r6('slope')} AS slope, {siso('s')} AS start_ts, {siso('e')} AS end_ts FROM slopes
""")
def trend_per_metric(spark, sf):
    out = detect.trend_slopes(grid(spark, sf))
    return out.select("name", round6("slope").alias("slope"), iso("start_ts").alias("start_ts"), iso("end_ts").alias("end_ts"))


@query("pair_correlation", "A9", f"""
WITH {FILLED.replace("'hour'", "'day'").replace('INTERVAL 1 HOUR', 'INTERVAL 1 DAY')}
SELECT a.name AS metric_a, b.name AS metric_b, {r6('corr(a.v, b.v)')} AS r
FROM filled a JOIN filled b ON a.h = b.h AND a.name < b.name GROUP BY 1, 2 HAVING abs(corr(a.v, b.v)) > 0.2
""")
def pair_correlation(spark, sf):
    out = detect.pair_correlations(grid(spark, sf, 24 * HOUR), EVENT_TYPES).filter(F.abs("r") > 0.2)
    return out.select("metric_a", "metric_b", round6("r").alias("r"))


DECOMPOSE = f"""
centered AS (
  SELECT name, h, i, v,
    CASE WHEN count(v) OVER w = 25 THEN
      (sum(v) OVER w - 0.5 * (lag(v, 12) OVER o + lead(v, 12) OVER o)) / 24 END AS c
  FROM filled WINDOW w AS (PARTITION BY name ORDER BY h ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING),
    o AS (PARTITION BY name ORDER BY h)),
phases AS (SELECT name, i % 24 AS phase, avg(v - c) AS m FROM centered GROUP BY 1, 2),
season AS (SELECT name, phase, m - avg(m) OVER (PARTITION BY name) AS s FROM phases),
strengths AS (
  SELECT c.name, stddev_pop(s) / stddev_pop(v) AS strength, min(h) AS s, max(h) AS e
  FROM centered c JOIN season ON season.name = c.name AND phase = i % 24
  GROUP BY c.name HAVING count(*) >= 48 AND count(v) = count(*))
"""


@query("centered_moving_average", "W7", f"""
WITH {FILLED}, {DECOMPOSE} SELECT name, {siso('h')} AS h, {r6('c')} AS center FROM centered
""")
def centered_moving_average(spark, sf):
    out = detect.centered_average(grid(spark, sf), PERIOD)
    return out.select("name", iso("h").alias("h"), round6("center").alias("center"))


@query("seasonality_strength", "A10 W7", f"""
WITH {FILLED}, {DECOMPOSE} SELECT name, {r6('strength')} AS strength FROM strengths
""")
def seasonality_strength(spark, sf):
    return detect.seasonal_strength(grid(spark, sf), PERIOD).select("name", round6("strength").alias("strength"))


PATTERNS = f"""
{RANGES}, {SLOPES}, {DECOMPOSE},
pairs AS (
  SELECT a.name AS a, b.name AS b, corr(a.v, b.v) AS r, (SELECT min(h) FROM filled) AS s, (SELECT max(h) FROM filled) AS e
  FROM filled a JOIN filled b ON a.h = b.h AND a.name < b.name GROUP BY 1, 2),
patterns AS (
  SELECT 'trend' AS type, least(abs(slope) * 2, 1) AS confidence, s, e, name AS metrics,
    CASE WHEN slope > 0 THEN 'Increasing' ELSE 'Decreasing' END || ' trend detected in ' || name AS description,
    abs(slope) AS severity,
    'Monitor ' || name || ' for continued ' || CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END || ' trend' AS action
  FROM slopes WHERE abs(slope) > 0.004
  UNION ALL
  SELECT 'seasonality', least(strength * 2, 1), s, e, name, 'Seasonal pattern detected in ' || name, strength,
    'Consider implementing predictive scaling for ' || name || ' based on seasonal pattern'
  FROM strengths WHERE strength > 0.2
  UNION ALL
  SELECT 'anomaly', least(severity / 2, 1), s, e, name, 'Anomaly detected in ' || name, severity,
    CASE WHEN severity > 3 THEN 'Urgent: Investigate abnormal behavior in ' || name ELSE 'Monitor ' || name || ' for continued anomalies' END
  FROM ranges
  UNION ALL
  SELECT 'correlation', abs(r), s, e, a || ',' || b, 'Strong correlation between ' || a || ' and ' || b, abs(r),
    'Consider joint scaling strategy for ' || a || ' and ' || b
  FROM pairs WHERE abs(r) > 0.05)
"""
PATTERN_COLUMNS = f"""type, {r6('confidence')} AS confidence, {siso('s')} AS start_ts, {siso('e')} AS end_ts,
  metrics, description, {r6('severity')} AS severity, action AS suggested_action"""


def patterns(spark, sf):
    return detect.detect_patterns(
        inputs.metric_points(spark, sf), EVENT_TYPES, HOUR, PERIOD, trend=0.004, correlation=0.05
    )


def pattern_columns(df):
    return df.select(
        "type", round6("confidence").alias("confidence"), iso("start_ts").alias("start_ts"), iso("end_ts").alias("end_ts"),
        F.array_join("metrics", ",").alias("metrics"), "description", round6("severity").alias("severity"), "suggested_action",
    )


@query("detect_all_patterns", "U1 D6 F6 A8 A9 A10 W2 W3", f"WITH {PATTERNS} SELECT {PATTERN_COLUMNS} FROM patterns")
def detect_all_patterns(spark, sf):
    return pattern_columns(patterns(spark, sf))


@query("recent_patterns", "P3", f"""
WITH {PATTERNS} SELECT {PATTERN_COLUMNS} FROM patterns
WHERE epoch(TIMESTAMP '2024-01-25') - epoch(e) < 864000 AND type = 'anomaly' AND metrics = 'view' AND confidence >= 0.5
""")
def recent_patterns(spark, sf):
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return pattern_columns(detect.recent_patterns(patterns(spark, sf), now, 864_000, "anomaly", "view", 0.5))


@query("moving_average", "W6", f"""
SELECT event_id, name, {r6('m')} AS moving_avg FROM (
  SELECT event_id, event_type AS name, avg(value) OVER w AS m, count(*) OVER w AS c FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE c = 5
""")
def moving_average(spark, sf):
    p = inputs.metric_points(spark, sf).select("name", "ts", "point_id", "value")
    out = windows.moving_average(p, ["name"], ["point_id"])
    return out.select(F.col("point_id").alias("event_id"), "name", round6("moving_avg").alias("moving_avg"))


@query("global_z_anomalies", "W11", f"""
SELECT event_id, {r6('z')} AS z, position FROM (
  SELECT event_id, (value - avg(value) OVER p) / stddev_pop(value) OVER p AS z,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS position
  FROM events WINDOW p AS (PARTITION BY event_type)) WHERE abs(z) > 1.7
""")
def global_z_anomalies(spark, sf):
    p = inputs.metric_points(spark, sf).select("name", "ts", "point_id", "value")
    out = windows.global_anomalies(positions(p, ["name"], "ts", ["point_id"]), ["name"], 1.7)
    return out.select(F.col("point_id").alias("event_id"), round6("z").alias("z"), "position")


@query("min_max_normalised", "W12", f"""
SELECT event_id, {r6('CASE WHEN max(value) OVER p = min(value) OVER p THEN 0.5 ELSE (value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p) END')} AS normalised
FROM events WINDOW p AS (PARTITION BY user_id)
""")
def min_max_normalised(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return windows.min_max_normalise(e, ["user_id"]).select("event_id", round6("normalised").alias("normalised"))


@query("counter_cpu_percent", "W13", f"""
WITH c AS (
  SELECT event_id, user_id, ts, sum(value) OVER w AS cpu_total, sum(1.0::DOUBLE) OVER w AS system_total
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (
  SELECT event_id, cpu_total - lag(cpu_total) OVER w AS dc, system_total - lag(system_total) OVER w AS ds
  FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, {r6('CASE WHEN dc > 0 AND ds > 0 THEN dc / ds * 100 ELSE 0 END')} AS cpu_percent FROM d
""")
def counter_cpu_percent(spark, sf):
    out = windows.counter_cpu_percent(inputs.user_counters(spark, sf), ["user_id"], ["event_id"])
    return out.select("event_id", round6("cpu_percent").alias("cpu_percent"))


@query("autocorrelation_at_lag", "W14", f"""
WITH {FILLED}, l AS (SELECT name, v, lag(v, 60) OVER (PARTITION BY name ORDER BY h) AS x FROM filled)
SELECT name, count(*) AS n_rows, {r6('CASE WHEN count(*) >= 120 THEN corr(v, x) END')} AS acf,
  coalesce(count(*) >= 120 AND abs(corr(v, x)) > 0.7, false) AS seasonal FROM l GROUP BY name
""")
def autocorrelation_at_lag(spark, sf):
    return windows.autocorrelation(grid(spark, sf)).withColumn("acf", round6("acf"))


@query("trailing_training_window", "W17", """
SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY event_type) AS last FROM events)
WHERE ts > last - INTERVAL 7 DAY
""")
def trailing_training_window(spark, sf):
    p = inputs.metric_points(spark, sf)
    return windows.training_window(p, ["name"]).select(F.col("point_id").alias("event_id"))


@query("sliding_sequences", "W16", f"""
WITH {FILLED}, s AS (
  SELECT name, h, list(v) OVER w AS vals, count(v) OVER w AS n, lead(h) OVER (PARTITION BY name ORDER BY h) AS nh FROM filled
  WINDOW w AS (PARTITION BY name ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT name, {siso('h')} AS h, {r6('vals[1]')} AS oldest, {r6('vals[24]')} AS newest,
  {r6('list_sum(vals)')} AS total FROM s WHERE n = 24 AND nh IS NOT NULL
""")
def sliding_sequences(spark, sf):
    out = windows.sliding_sequences(grid(spark, sf))
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "name", iso("h").alias("h"), round6(F.col("sequence")[0]).alias("oldest"),
        round6(F.col("sequence")[23]).alias("newest"), round6(total).alias("total"),
    )
