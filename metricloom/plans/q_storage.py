"""Queries over stored metric points and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.scalars import iso, memory_percent, parse_iso, seconds_between
from metricloom.operators import aggregates as agg
from metricloom.operators.chunks import previous_values
from metricloom.operators.knowledge import update_confidence
from metricloom.operators.oplog import operation_metrics
from metricloom.plans import inputs
from metricloom.plans.inputs import table
from metricloom.plans.oracle import ENTRIES, SNAPSHOTS, iso as siso, r6
from metricloom.plans.registry import query
from metricloom.plans.rounding import round6
from metricloom.session import shared_folder
from metricloom.sources import containers, metrics, tables

NOW = "2024-01-25 00:00:00"
START, STOP = "2024-01-05 00:00:00", "2024-01-20 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("windowed_mean_and_p95", "A5 S1 D1", f"""
SELECT event_type AS name, {siso("date_trunc('hour', ts)")} AS window_start,
  {r6('avg(value)')} AS avg_value, {r6('quantile_cont(value, 0.95)')} AS p_value,
  {r6('sum(value)')} AS sum_value, min(value) AS min_value, max(value) AS max_value,
  count(*) AS n_points
FROM events GROUP BY event_type, date_trunc('hour', ts)
""")
def windowed_mean_and_p95(spark, sf):
    out = agg.windowed_aggregates(inputs.metric_points(spark, sf), ["name"], inputs.HOUR)
    return out.select(
        "name", iso("window_start").alias("window_start"),
        *[round6(c).alias(c) for c in ("avg_value", "p_value", "sum_value")],
        "min_value", "max_value", "n_points",
    )


@query("scan_points_by_name", "S1", f"""
SELECT event_id AS point_id, event_type AS name, {siso('ts')} AS ts, value
FROM events WHERE event_type IN ('click', 'error')
""")
def scan_points_by_name(spark, sf):
    text = inputs.metric_points(spark, sf).withColumn("ts", iso("ts"))
    out = metrics.scan_points(text, names=["click", "error"])
    return out.select("point_id", "name", iso("ts").alias("ts"), "value")


@query("flatten_container_stats", "S2 D2 D17 W13 F5", f"""
WITH c AS (
  SELECT event_id, user_id, ts, value,
    sum(value) OVER w AS cpu_total, sum(1.0::DOUBLE) OVER w AS system_total
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (
  SELECT *, lag(cpu_total) OVER w AS cpu_pre, lag(system_total) OVER w AS system_pre
  FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
long AS (
  SELECT ts, user_id, 'cpu_usage_percent' AS metric,
    CASE WHEN cpu_total - cpu_pre > 0 AND system_total - system_pre > 0
      THEN (cpu_total - cpu_pre) / (system_total - system_pre) * 100 ELSE 0 END AS value FROM p
  UNION ALL SELECT ts, user_id, 'cpu_system_usage', system_total FROM p
  UNION ALL SELECT ts, user_id, 'cpu_online_cpus', 0 FROM p
  UNION ALL SELECT ts, user_id, 'memory_usage', value FROM p
  UNION ALL SELECT ts, user_id, 'memory_limit', 200 FROM p
  UNION ALL SELECT ts, user_id, 'memory_percent', value / 200 * 100 FROM p
  UNION ALL SELECT ts, user_id, 'network_eth0_rx_bytes', value FROM p
  UNION ALL SELECT ts, user_id, 'network_eth0_tx_bytes', value * 2 FROM p
  UNION ALL SELECT ts, user_id, 'network_eth0_rx_packets', 1 FROM p
  UNION ALL SELECT ts, user_id, 'network_eth0_tx_packets', 2 FROM p
  UNION ALL SELECT ts, user_id, 'blkio_read_bytes', value * 3 FROM p
  UNION ALL SELECT ts, user_id, 'blkio_write_bytes', value + 5 FROM p)
SELECT {siso('ts')} AS ts, 'container_' || metric AS name, {r6('CAST(value AS DOUBLE)')} AS value,
  CAST(user_id AS VARCHAR) AS container_id FROM long
""")
def flatten_container_stats(spark, sf):
    counters = inputs.user_counters(spark, sf)
    both = previous_values(
        counters, ["user_id"], "ts", ["event_id"], {"cpu_pre": "cpu_total", "system_pre": "system_total"}
    )
    v = F.col("value")
    number = lambda c, n: F.lit(c).cast("double").alias(n)
    interface = F.struct(v.alias("rx_bytes"), (v * 2).alias("tx_bytes"), number(1, "rx_packets"), number(2, "tx_packets"))
    entry = lambda op, c: F.struct(F.lit(op).alias("op"), c.alias("value"))
    documents = both.select(
        "ts",
        F.col("user_id").cast("string").alias("container_id"),
        F.concat(F.lit("c"), "user_id").alias("container_name"),
        F.lit(None).cast("string").alias("image"),
        F.struct(
            F.col("cpu_total").alias("total_usage"), F.col("system_total").alias("system_cpu_usage"),
            F.lit(None).cast("int").alias("online_cpus"),
        ).alias("cpu_stats"),
        F.struct(
            F.col("cpu_pre").alias("total_usage"), F.col("system_pre").alias("system_cpu_usage")
        ).alias("precpu_stats"),
        F.struct(v.alias("usage"), number(200, "limit")).alias("memory_stats"),
        F.create_map(F.lit("eth0"), interface).alias("networks"),
        F.array(entry("Read", v), entry("write", v + 5), entry("Read", v * 3), entry("Sync", v)).alias("blkio"),
    )
    return containers.flatten_stats(documents).select(
        iso("ts").alias("ts"), "name", round6("value").alias("value"), F.col("labels.container_id").alias("container_id")
    )


@query("system_metrics_long", "S3", f"""
SELECT {siso('ts')} AS ts, 'system_cpu_percent' AS name, value, CAST(user_id AS VARCHAR) AS hostname FROM events
UNION ALL
SELECT {siso('ts')}, 'system_memory_percent', CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS DOUBLE), CAST(user_id AS VARCHAR) FROM events
""")
def system_metrics_long(spark, sf):
    wide = inputs.metric_points(spark, sf).select(
        "ts", F.col("user_id").alias("host"), F.col("value").alias("cpu_percent"),
        F.col("k").cast("double").alias("memory_percent"),
    )
    out = metrics.system_metrics_long(wide, "ts", "host", ["cpu_percent", "memory_percent"])
    return out.select(iso("ts").alias("ts"), "name", "value", F.col("labels.hostname").alias("hostname"))


@query("append_then_range_scan", "S4 S5 P2 S10", f"""
SELECT event_id AS point_id, {siso('ts')} AS ts, value FROM events
WHERE event_type = 'view' AND ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{STOP}' AND user_id = 7
""")
def append_then_range_scan(spark, sf):
    path = shared_folder(spark, "points")
    points = inputs.metric_points(spark, sf)
    metrics.append_points(points.filter(F.col("ts") < F.lit(NOW).cast("timestamp_ntz")), path)
    metrics.append_points(points.filter(F.col("ts") >= F.lit(NOW).cast("timestamp_ntz")), path)
    out = metrics.read_range(spark.read.parquet(path), "view", START, STOP, {"user": "7"})
    return out.select("point_id", iso("ts").alias("ts"), "value")


@query("range_scan_with_labels", "S5 P2", f"""
SELECT event_id AS point_id, {siso('ts')} AS ts, value FROM events
WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{STOP}' AND user_id = 3
""")
def range_scan_with_labels(spark, sf):
    out = metrics.read_range(inputs.metric_points(spark, sf), ["click", "view"], START, STOP, {"user": "3"})
    return out.select("point_id", iso("ts").alias("ts"), "value")


@query("range_response_rows", "S6", f"""
SELECT {siso('ts')} AS ts, value, event_type AS name, CAST(user_id AS VARCHAR) AS label_user FROM events
UNION ALL
SELECT {siso('ts + INTERVAL 60 SECOND')}, value * 2, event_type, CAST(user_id AS VARCHAR) FROM events
""")
def range_response_rows(spark, sf):
    e = table(spark, sf, "events")
    at = lambda shift: (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + shift).cast("decimal(18,6)").cast("string")
    body = F.concat(
        F.lit('{"status":"success","data":{"result":[{"metric":{"__name__":"'), "event_type",
        F.lit('","user":"'), F.col("user_id").cast("string"), F.lit('"},"values":[['),
        at(0), F.lit(',"'), F.col("value").cast("string"), F.lit('"],['),
        at(60), F.lit(',"'), (F.col("value") * 2).cast("string"), F.lit('"]]}]}}'),
    )
    out = tables.flatten_range_response(e.select(body.alias("body")))
    return out.select(
        iso("ts").alias("ts"), "value",
        F.col("labels")["__name__"].alias("name"), F.col("labels")["user"].alias("label_user"),
    )


@query("table_round_trip", "S7 S10 F8 D9", f"""
WITH {SNAPSHOTS}
SELECT snapshot_id, state_type, {siso('ts')} AS ts, priority, price FROM snaps
""")
def table_round_trip(spark, sf):
    path = shared_folder(spark, "table")
    tables.write_table(inputs.snapshots(spark, sf).select("snapshot_id", "state_type", "ts", "data"), path)
    back = tables.read_table(spark, path).withColumn("d", F.from_json("data", "priority string, price double"))
    return back.select(
        "snapshot_id", "state_type", iso("ts").alias("ts"), F.col("d.priority").alias("priority"), F.col("d.price").alias("price")
    )


@query("json_export", "S13", "SELECT event_id, value FROM events")
def json_export(spark, sf):
    path = shared_folder(spark, "json")
    tables.export_json(table(spark, sf, "events").select("event_id", "value"), path)
    return spark.read.schema("event_id bigint, value double").json(path)


@query("parameterised_sql", "S8", """
SELECT event_type, count(*) AS n FROM events WHERE value > 50 AND event_type <> 'error' GROUP BY 1
""")
def parameterised_sql(spark, sf):
    return tables.run_sql(
        spark,
        "SELECT event_type, count(*) AS n FROM {events} WHERE value > :low AND event_type <> :skip GROUP BY event_type",
        {"low": 50, "skip": "error"},
        events=table(spark, sf, "events"),
    )


@query("document_find", "S9", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")
def document_find(spark, sf):
    out = tables.find(table(spark, sf, "orders"), {"o_orderstatus": "P", "o_orderpriority": "5-LOW"})
    return out.select("o_orderkey", "o_totalprice")


@query("document_pipeline", "S9", f"""
SELECT o_orderpriority AS _id, count(*) AS n, {r6('avg(o_totalprice)')} AS mean_price, max(o_totalprice) AS top_price
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY n DESC, _id LIMIT 3
""")
def document_pipeline(spark, sf):
    out = tables.aggregate_pipeline(table(spark, sf, "orders"), [
        {"$match": {"o_orderstatus": "F"}},
        {"$group": {
            "_id": "$o_orderpriority", "n": {"$sum": 1},
            "mean_price": {"$avg": "$o_totalprice"}, "top_price": {"$max": "$o_totalprice"},
        }},
        {"$sort": {"n": -1, "_id": 1}},
        {"$limit": 3},
    ])
    return out.withColumn("mean_price", round6("mean_price"))


@query("filter_by_prefix_and_label", "P1", f"""
SELECT event_id AS point_id, event_type AS name, value FROM events
WHERE starts_with(event_type, 'pur') AND user_id = 11
""")
def filter_by_prefix_and_label(spark, sf):
    out = metrics.filter_points(inputs.metric_points(spark, sf), "pur", {"user": "11"})
    return out.select("point_id", "name", "value")


@query("age_retention_points", "P9", f"""
SELECT event_id AS point_id, {siso('ts')} AS ts FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY
""")
def age_retention_points(spark, sf):
    out = metrics.retain(inputs.metric_points(spark, sf), "ts", now(), 10 * 86_400)
    return out.select("point_id", iso("ts").alias("ts"))


@query("age_retention_entries", "P9", f"""
WITH {ENTRIES} SELECT entry_id FROM entries WHERE ts >= TIMESTAMP '1998-07-01' - INTERVAL 90 DAY
""")
def age_retention_entries(spark, sf):
    at = F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")
    return metrics.retain(inputs.knowledge_entries(spark, sf), "ts", at, 90 * 86_400).select("entry_id")


@query("compound_retention", "P10", """
WITH f AS (SELECT user_id, max(ts) AS ts, count(*) AS frequency FROM events GROUP BY 1)
SELECT user_id, frequency FROM f WHERE NOT (ts < TIMESTAMP '2024-01-29 12:00:00' AND frequency < 70)
""")
def compound_retention(spark, sf):
    f = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.count("*").alias("frequency"))
    old = F.col("ts") < F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")
    return f.filter(~(old & (F.col("frequency") < 70))).select("user_id", "frequency")


@query("delete_metric_range", "P11", f"""
SELECT event_id AS point_id FROM events
WHERE NOT (event_type = 'view' AND ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{STOP}' AND user_id = 7)
""")
def delete_metric_range(spark, sf):
    out = metrics.delete_range(inputs.metric_points(spark, sf), "view", START, STOP, {"user": "7"})
    return out.select("point_id")


@query("update_by_key", "P12", f"""
WITH {ENTRIES}
SELECT entry_id, CASE WHEN outcome_value > 400000 THEN 0.99 ELSE confidence END AS confidence FROM entries
""")
def update_by_key(spark, sf):
    entries = inputs.knowledge_entries(spark, sf)
    updates = entries.filter(F.col("outcome_value") > 400_000).select("entry_id", F.lit(0.99).alias("confidence"))
    return update_confidence(entries, updates).select("entry_id", "confidence")


@query("trailing_stats", "A3", f"""
SELECT event_type AS name, CAST(user_id AS VARCHAR) AS label_user, min(value) AS min_value, max(value) AS max_value,
  {r6('avg(value)')} AS avg_value, {r6('stddev_pop(value)')} AS std_value, count(*) AS n_points, {siso('max(ts)')} AS last_update
FROM events WHERE ts <= TIMESTAMP '{NOW}' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY GROUP BY 1, 2
""")
def trailing_stats(spark, sf):
    points = inputs.metric_points(spark, sf).withColumn("label_user", F.col("labels")["user"])
    out = agg.trailing_stats(points, ["name", "label_user"], now(), 86_400)
    return out.select(
        "name", "label_user", "min_value", "max_value", round6("avg_value").alias("avg_value"),
        round6("std_value").alias("std_value"), "n_points", iso("last_update").alias("last_update"),
    )


@query("range_aggregates", "A4 D5", f"""
SELECT event_type AS name, CAST(user_id AS VARCHAR) AS label_user, {r6('sum(value)')} AS sum_value,
  {r6('avg(value)')} AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n_points,
  {r6('quantile_cont(value, 0.95)')} AS p_value
FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{STOP}' GROUP BY 1, 2
""")
def range_aggregates(spark, sf):
    points = metrics.read_range(inputs.metric_points(spark, sf), inputs.EVENT_TYPES, START, STOP)
    out = agg.range_aggregates(points.withColumn("label_user", F.col("labels")["user"]), ["name", "label_user"])
    return out.select(
        "name", "label_user", "min_value", "max_value", "n_points",
        *[round6(c).alias(c) for c in ("sum_value", "avg_value", "p_value")],
    )


@query("range_average_only", "A4", f"""
SELECT event_type AS name, {r6('avg(value)')} AS avg_value FROM events
WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{STOP}' GROUP BY 1
""")
def range_average_only(spark, sf):
    points = metrics.read_range(inputs.metric_points(spark, sf), inputs.EVENT_TYPES, START, STOP)
    return agg.range_aggregates(points, ["name"], aggregations=["avg"]).withColumn("avg_value", round6("avg_value"))


@query("windowed_choice_filtered", "A5", f"""
SELECT event_type AS name, {siso("date_trunc('day', ts)")} AS window_start, {r6('sum(value)')} AS sum_value, min(value) AS min_value, max(value) AS max_value,
  count(*) AS n_points FROM events
WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{STOP}' AND user_id = 3 GROUP BY 1, 2
""")
def windowed_choice_filtered(spark, sf):
    out = agg.windowed_aggregates(
        inputs.metric_points(spark, sf), ["name"], 86_400, aggregations=["sum", "min", "max", "count"],
        names=["click", "view"], start=START, stop=STOP, labels={"user": "3"},
    )
    return out.select("name", iso("window_start").alias("window_start"), round6("sum_value").alias("sum_value"), "min_value", "max_value", "n_points")


@query("series_metadata", "A6", f"""
SELECT event_type AS name, {siso('min(ts)')} AS ts, min_by(event_id, (ts, event_id)) AS point_id,
  min_by(CAST(json_extract(props, '$.k') AS BIGINT), (ts, event_id)) AS k
FROM events WHERE ts <= TIMESTAMP '{NOW}' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR GROUP BY 1
""")
def series_metadata(spark, sf):
    out = agg.first_point_metadata(inputs.metric_points(spark, sf), ["name"], now(), ["point_id", "k"])
    return out.select("name", iso("ts").alias("ts"), "point_id", "k")


@query("label_names_and_values", "A7", """
SELECT 'name' AS kind, 'user' AS label FROM events WHERE event_type = 'signup' GROUP BY 1, 2
UNION ALL SELECT DISTINCT 'value', CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'signup'
""")
def label_names_and_values(spark, sf):
    points = inputs.metric_points(spark, sf)
    keys = agg.label_names(points, "signup").select(F.lit("name").alias("kind"), "label")
    values = agg.label_values(points, "signup", "user").select(F.lit("value").alias("kind"), F.col("label_value").alias("label"))
    return keys.unionByName(values)


@query("step_aligned_lookup", "J2", f"""
WITH steps AS (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{STOP}', INTERVAL 10 MINUTE)) AS t),
names AS (SELECT DISTINCT event_type AS name FROM events WHERE ts <= TIMESTAMP '{STOP}'),
cand AS (
  SELECT name, t, value, row_number() OVER (PARTITION BY name, t ORDER BY ts DESC, event_id DESC) AS rn
  FROM steps CROSS JOIN names JOIN events ON event_type = name AND ts <= t AND ts > t - INTERVAL 30 MINUTE)
SELECT name, {siso('t')} AS step_ts, value FROM cand WHERE rn = 1
""")
def step_aligned_lookup(spark, sf):
    points = inputs.metric_points(spark, sf)
    out = agg.step_lookup(points, ["name"], START, STOP, 600, 1800, ["point_id"])
    return out.select("name", iso("step_ts").alias("step_ts"), "value")


@query("latest_value_per_series", "J3 L5", f"""
SELECT event_type AS name, CAST(user_id AS VARCHAR) AS label_user, {siso('max(ts)')} AS last_ts,
  max_by(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2
""")
def latest_value_per_series(spark, sf):
    points = inputs.metric_points(spark, sf).withColumn("label_user", F.col("labels")["user"])
    out = agg.latest_values(points, ["name", "label_user"], ["point_id"])
    return out.select("name", "label_user", iso("last_ts").alias("last_ts"), "last_value")


@query("last_value_fresh", "L5", f"""
SELECT event_type AS name, {siso('max(ts)')} AS last_ts, max_by(value, (ts, event_id)) AS last_value
FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1 HAVING max(ts) > TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE
""")
def last_value_fresh(spark, sf):
    points = inputs.metric_points(spark, sf).filter(F.col("ts") <= now())
    out = agg.latest_values(points, ["name"], ["point_id"]).filter(seconds_between("last_ts", now()) < 600)
    return out.select("name", iso("last_ts").alias("last_ts"), "last_value")


@query("container_set_changes", "U3", """
WITH b AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS container_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'),
a AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS container_id FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-12')
SELECT container_id, 'started' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT container_id, 'stopped' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def container_set_changes(spark, sf):
    e = table(spark, sf, "events").select("ts", F.col("user_id").cast("string").alias("container_id"))
    day = lambda d: e.filter(
        (F.col("ts") >= F.lit(f"2024-01-{d}").cast("timestamp_ntz")) & (F.col("ts") < F.lit(f"2024-01-{d + 1}").cast("timestamp_ntz"))
    )
    return containers.container_changes(day(10), day(11))


@query("iso_times", "F1", f"""
SELECT event_id, {siso('ts')} AS text, {siso('ts')} AS parsed_text,
  {r6("epoch_us(ts) / 1e6 - epoch_us(TIMESTAMP '2024-01-01') / 1e6")} AS age_seconds FROM events
""")
def iso_times(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", iso("ts").alias("text"))
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return e.select(
        "event_id", "text", iso(parse_iso("text")).alias("parsed_text"),
        round6(seconds_between(start, "ts")).alias("age_seconds"),
    )


@query("memory_percentage", "F5", f"""
SELECT event_id, {r6("CASE WHEN json_extract(props, '$.k') = '0' THEN 0 ELSE value / CAST(json_extract(props, '$.k') AS DOUBLE) * 100 END")} AS memory_percent
FROM events
""")
def memory_percentage(spark, sf):
    p = inputs.metric_points(spark, sf)
    limit = F.nullif(F.col("k").cast("double"), F.lit(0.0))
    return p.select(F.col("point_id").alias("event_id"), round6(memory_percent(F.col("value"), limit)).alias("memory_percent"))


@query("json_payload_fields", "F8 D19", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS encoded FROM events
""")
def json_payload_fields(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("encoded"))


@query("operation_metric_series", "A32", f"""
WITH span AS (
  SELECT event_id AS operation_id, user_id, ts AS created_at, ts + to_minutes(5 * (1 + CAST(json_extract(props, '$.k') AS BIGINT))) AS completed_at
  FROM events WHERE event_type = 'purchase')
SELECT operation_id, {siso("date_trunc('minute', e.ts)")} AS minute, {r6('avg(e.value)')} AS avg_value, count(*) AS n_points
FROM span JOIN events e ON e.user_id = span.user_id AND e.ts >= span.created_at AND e.ts < span.completed_at
GROUP BY operation_id, date_trunc('minute', e.ts)
""")
def operation_metric_series(spark, sf):
    p = inputs.metric_points(spark, sf)
    minutes = (F.col("k") + 1) * 5
    spans = p.filter(F.col("name") == "purchase").select(
        F.col("point_id").alias("operation_id"), "user_id", F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))).alias("completed_at"),
    )
    out = operation_metrics(p.select("user_id", "ts", "value"), spans, "user_id")
    return out.select("operation_id", iso("minute").alias("minute"), round6("avg_value").alias("avg_value"), "n_points")
