"""Streaming queries, run over everything available, and model queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from metricloom.functions.scalars import iso
from metricloom.operators import aggregates, models, similarity
from metricloom.operators.knowledge import entry_confidence
from metricloom.plans import inputs
from metricloom.plans.inputs import table
from metricloom.plans.oracle import ENTRIES, SNAPSHOTS, iso as siso, r6
from metricloom.plans.q_knowledge import RAW
from metricloom.plans.q_oplog import TALLY, UPDATES
from metricloom.plans.q_thresholds import EVALUATED, FOLD, HOUR, WINDOW, config
from metricloom.plans.registry import query
from metricloom.plans.rounding import round6
from metricloom.session import cut_lineage, shared_folder
from metricloom.streaming import live


def stream_of(spark, sf, name):
    return live.file_stream(spark, sf, f"{name}.parquet", table(spark, sf, name).schema)


def points(spark, sf):
    e = stream_of(spark, sf, "events").select(F.col("event_type").alias("name"), "ts", "value", "event_id", "user_id")
    return live.as_event_time(e, "ts")


@query("live_window_stats", "I1 A3", f"""
SELECT {siso("date_trunc('hour', ts)")} AS window_start, event_type AS name, min(value) AS min_value, max(value) AS max_value,
  {r6('avg(value)')} AS avg_value, {r6('stddev_pop(value)')} AS std_value, count(*) AS n_points, {siso('max(ts)')} AS last_update
FROM events GROUP BY date_trunc('hour', ts), event_type
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 600 SECOND
""")
def live_window_stats(spark, sf):
    out, _ = live.run_to_table(live.live_stats(points(spark, sf), ["name"], HOUR, 600), "live-stats")
    return out.select(
        iso("window_start").alias("window_start"), "name", "min_value", "max_value", round6("avg_value").alias("avg_value"),
        round6("std_value").alias("std_value"), "n_points", iso("last_update").alias("last_update"),
    )


@query("sliding_window_stats", "I1", f"""
WITH w AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)) - INTERVAL 3 HOUR, date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS s, max(ts) AS last FROM events)
SELECT {siso('s')} AS window_start, event_type AS name, count(*) AS n_points, {r6('avg(value)')} AS avg_value
FROM w JOIN events ON ts >= s AND ts < s + INTERVAL 3 HOUR WHERE s + INTERVAL 3 HOUR <= last GROUP BY s, event_type
""")
def sliding_window_stats(spark, sf):
    out, _ = live.run_to_table(live.live_stats(points(spark, sf), ["name"], 3 * HOUR, 0, HOUR), "sliding-stats")
    return out.select(iso("window_start").alias("window_start"), "name", "n_points", round6("avg_value").alias("avg_value"))


@query("collection_cycle_to_topic", "I2 S11 S12 D20", """
SELECT event_id, event_type AS name, value FROM events WHERE event_id % 10 <> 0
""")
def collection_cycle_to_topic(spark, sf):
    p = points(spark, sf).select("event_id", "name", "value")
    good = live.topic_messages(p, "metric")
    other = live.topic_messages(p, "heartbeat")
    # every tenth message is damaged: it must be skipped, not stop the stream
    damaged = F.when(F.col("value").rlike('"event_id":[0-9]*0,'), F.lit("{broken")).otherwise(F.col("value"))
    messages = good.unionByName(other).select(damaged.alias("value"))
    folder = shared_folder(spark, "topic")
    live.start(messages, f"{folder}/data", f"{folder}/checkpoint", fmt="text").awaitTermination()
    routed = live.route(live.read_topic(spark, f"{folder}/data"), "metric", "event_id bigint, name string, value double")
    return live.run_to_table(routed, "routed")[0]


LEARNED = """
learned AS (SELECT quantile_cont(value, 0.9) AS p FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-15'),
judged AS (
  SELECT event_id, event_type AS name, CASE event_type WHEN 'click' THEN value > 60
    WHEN 'error' THEN value >= CASE WHEN hour(ts) < 6 THEN 85 WHEN hour(ts) < 18 THEN 40 WHEN hour(ts) < 20 THEN 5 ELSE 50 END
    WHEN 'purchase' THEN value > (SELECT p FROM learned) WHEN 'signup' THEN value > 65 ELSE value < 20 END AS violation
  FROM events)
"""


def evaluated_stream(spark, sf):
    """Events judged by type: the percentile learned from the first half of the
    month, an adapted limit of 65 for the adaptive metric."""
    past = inputs.metric_points(spark, sf).filter((F.col("name") == "purchase") & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")))
    learned = aggregates.exact_quantile(past, ["name"], "value", 0.9, "percentile_value").withColumn("adaptive_value", F.lit(None).cast("double"))
    adapted = spark.createDataFrame([("signup", None, 65.0)], "name string, percentile_value double, adaptive_value double")
    return live.evaluate_stream(points(spark, sf), config(spark), cut_lineage(learned.unionByName(adapted)))


@query("stream_threshold_counters", "I3", f"""
WITH {LEARNED} SELECT name, count(*) AS evaluations, count(*) FILTER (WHERE violation) AS violations FROM judged GROUP BY 1
""")
def stream_threshold_counters(spark, sf):
    counters = live.running_counters(evaluated_stream(spark, sf))
    return live.run_to_table(counters, "counters", "complete")[0].select("name", "evaluations", "violations")


@query("stream_threshold_points", "I3 P13", f"WITH {LEARNED} SELECT event_id, violation FROM judged")
def stream_threshold_points(spark, sf):
    return live.run_to_table(evaluated_stream(spark, sf).select("event_id", "violation"), "evaluated")[0]


LATE_HOURS = 12


@query("stream_learned_thresholds", "I3 I4 W8 P29 M8", f"""
WITH RECURSIVE {EVALUATED} SELECT event_id, name, {r6('threshold')} AS threshold, violation FROM judged
WHERE name NOT IN ('purchase', 'signup') OR ts <= (SELECT max(ts) FROM events WHERE event_type IS NOT NULL) - INTERVAL {LATE_HOURS} HOUR
""")
def stream_learned_thresholds(spark, sf):
    """Five files, each with points up to six hours out of order: limits are learned on the way."""
    folder = shared_folder(spark, "learned-feed")
    p = inputs.metric_points(spark, sf).select("point_id", "name", F.col("ts").cast("timestamp").alias("ts"), "value")
    arrival = F.unix_seconds("ts") + (F.col("point_id") % 7) * 3600
    span = p.agg(F.min(arrival).alias("lo"), (F.max(arrival) + 1).alias("hi")).first()
    part = F.floor((arrival - span["lo"]) * 5 / (span["hi"] - span["lo"]))
    dealt = cut_lineage(p.withColumn("part", part))
    for k in range(5):
        dealt.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    feed = live.file_stream(spark, f"{folder}/*", "*.parquet", p.schema, files_per_batch=1)
    out, _ = live.run_to_table(live.evaluate_stream_by_itself(feed, config(spark), WINDOW, HOUR, LATE_HOURS * HOUR), "learned")
    return out.select(F.col("point_id").alias("event_id"), "name", round6("threshold").alias("threshold"), "violation")


@query("stream_adaptive_threshold", "I4 M8", f"""
WITH RECURSIVE {FOLD} SELECT name, {siso('t')} AS tick_ts, {r6('threshold')} AS threshold FROM fold
WHERE t <= (SELECT max(ts) FROM events)
""")
def stream_adaptive_threshold(spark, sf):
    panes, _ = live.run_to_table(live.pane_stream(points(spark, sf), HOUR), "panes")
    folder = shared_folder(spark, "pane-feed")
    panes.write.parquet(folder)
    feed = live.file_stream(spark, folder, "*.parquet", panes.schema)
    out, _ = live.run_to_table(live.adaptive_stream(feed, config(spark), 24), "adaptive")
    at = F.timestamp_seconds((F.col("tick") + 1) * HOUR)
    return out.select("name", iso(at).alias("tick_ts"), round6("threshold").alias("threshold"))


@query("stream_latest_state", "I5 P22", f"""
WITH {UPDATES}
SELECT state_type, CAST(max(version) AS BIGINT) AS version, max_by(update_id, (version, -update_id)) AS update_id FROM updates WHERE node <> 2 GROUP BY 1
""")
def stream_latest_state(spark, sf):
    o = stream_of(spark, sf, "orders")
    days = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    u = o.select(
        F.col("o_orderkey").alias("update_id"), F.col("o_orderstatus").alias("state_type"), (F.col("o_custkey") % 5).alias("node"),
        (F.floor("o_totalprice") % 5000 + days).cast("bigint").alias("version"),
    )
    return live.run_to_table(live.latest_state(u, 2, ["update_id"]), "state", "complete")[0]


def vote_stream(spark, sf):
    v = stream_of(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("proposal_id"), (F.col("l_suppkey") % 3).alias("voter"), (F.col("l_returnflag") != "R").alias("vote"),
        F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("tie1"), F.col("l_linenumber").alias("tie2"), F.col("l_extendedprice").alias("tie3"),
    )
    return live.as_event_time(v, "ts")


@query("stream_vote_tally", "I6 A21", f"""
WITH {TALLY}
SELECT t.proposal_id, total, yes, CASE WHEN state = 'open' THEN 'expired' ELSE state END AS state
FROM decided t JOIN proposals p USING (proposal_id)
WHERE state <> 'open' OR expiration <= (SELECT max(v.ts) FROM votes v JOIN proposals USING (proposal_id))
""")
def stream_vote_tally(spark, sf):
    times = [F.col(c).cast("timestamp").alias(n) for c, n in (("ts", "proposed_at"), ("expiration", "expiration"))]
    votes = vote_stream(spark, sf).join(inputs.proposals(spark, sf).select("proposal_id", *times), "proposal_id")
    return live.run_to_table(live.tally_stream(votes), "tally")[0]


@query("stream_votes_in_time", "J10", f"WITH {TALLY} SELECT proposal_id, voter, tie1, tie3, {siso('ts')} AS ts FROM valid")
def stream_votes_in_time(spark, sf):
    p = stream_of(spark, sf, "orders").select(
        F.col("o_orderkey").alias("proposal_id"), F.col("o_orderdate").alias("ts"),
        (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("expiration"),
    )
    joined = live.votes_in_time(vote_stream(spark, sf), live.as_event_time(p, "ts", "expiration"), 365 * 86_400)
    out, _ = live.run_to_table(joined.select("proposal_id", "voter", "tie1", "tie3", "ts"), "in-time")
    return out.withColumn("ts", iso("ts"))


@query("stream_first_proposals", "P28", f"""
SELECT l_partkey AS proposal_id, {siso('min(l_shipdate)')} AS ts, min_by(l_suppkey, (l_shipdate, l_orderkey, l_suppkey, l_linenumber, l_extendedprice)) AS proposer
FROM lineitem GROUP BY 1
""")
def stream_first_proposals(spark, sf):
    m = stream_of(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("proposal_id"), F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("proposer"),
        "l_orderkey", "l_linenumber", "l_extendedprice",
    )
    first = live.first_proposals_stream(live.as_event_time(m, "ts"), ["l_orderkey", "proposer", "l_linenumber", "l_extendedprice"])
    out, _ = live.run_to_table(first, "first")
    return out.select("proposal_id", iso("ts").alias("ts"), "proposer")


@query("stream_cooldown", "I7", """
WITH RECURSIVE c AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value > 60),
f AS (
  SELECT event_id, user_id, k, ts AS last, true AS applied FROM c WHERE k = 1
  UNION ALL SELECT c.event_id, c.user_id, c.k, CASE WHEN c.ts - f.last >= INTERVAL 2 DAY THEN c.ts ELSE f.last END, c.ts - f.last >= INTERVAL 2 DAY
  FROM f JOIN c ON c.user_id = f.user_id AND c.k = f.k + 1)
SELECT event_id AS candidate_id, user_id AS service, applied FROM f
""")
def stream_cooldown(spark, sf):
    c = points(spark, sf).filter("value > 60").select(F.col("user_id").alias("service"), F.col("event_id").alias("candidate_id"), "ts")
    return live.run_to_table(live.cooldown_stream(c, 2 * 86_400), "cooldown")[0]


@query("stream_snapshot_log", "I8 W15 J15 F2", f"""
WITH {SNAPSHOTS}, b AS (SELECT *, snapshot_id % 2 AS half FROM snaps)
SELECT snapshot_id, state_type, row_number() OVER w AS version, lag(snapshot_id) OVER w AS parent_id FROM b
WINDOW w AS (PARTITION BY state_type ORDER BY half, ts, snapshot_id)
""")
def stream_snapshot_log(spark, sf):
    folder = shared_folder(spark, "snapshot-feed")
    snaps = inputs.snapshots(spark, sf).select("snapshot_id", "state_type", "ts", "data")
    halves = snaps.withColumn("half", F.col("snapshot_id") % 2)
    log = None
    # two runs of one log: the second goes on from the versions of the first
    sink = f"{folder}/log"
    for half in (0, 1):
        halves.filter(F.col("half") == half).drop("half").write.mode("append").parquet(f"{folder}/feed")
        feed = live.file_stream(spark, f"{folder}/feed", "*.parquet", snaps.schema)
        live.start(feed, sink, f"{folder}/checkpoint", each_batch=live.append_snapshots(sink)).awaitTermination()
        log = spark.read.parquet(sink)
    return log.select("snapshot_id", "state_type", "version", "parent_id")


@query("stream_late_data", "I9", f"""
WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15')
SELECT {siso("date_trunc('hour', ts)")} AS window_start, event_type AS name, count(*) AS n_points FROM e
GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 DAY
""")
def stream_late_data(spark, sf):
    folder = shared_folder(spark, "late-feed")
    e = table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts"), "value")
    late = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    sink = None
    # the newer half arrives first; the older half is then behind the watermark
    for part in (~late, late):
        e.filter(part).write.mode("append").parquet(f"{folder}/feed")
        feed = live.file_stream(spark, f"{folder}/feed", "*.parquet", e.schema)
        stats = live.live_stats(feed, ["name"], HOUR, 86_400)
        sink = f"{folder}/data"
        live.start(stats, sink, f"{folder}/checkpoint").awaitTermination()
    out = spark.read.schema(stats.schema).parquet(sink)
    return out.select(iso("window_start").alias("window_start"), "name", "n_points")


# --- models --------------------------------------------------------------------------


def model_entries(spark, sf):
    e = similarity.standardise(inputs.knowledge_entries(spark, sf), RAW)
    bucket = F.least(F.floor(F.col("outcome_value") / 125_000), F.lit(3)).cast("double")
    return e.withColumns({"label": bucket, "target": F.col("outcome_value") / 500_000})


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CLASSIFIED = {"1-URGENT", "2-HIGH"}
MODELLED = f"""
{ENTRIES}, modelled AS (SELECT * FROM entries WHERE type IN (SELECT type FROM entries GROUP BY type HAVING count(*) >= 50))
"""


@lru_cache(maxsize=2)
def fitted_confidence(spark, sf):
    """(entries, confidence of each): written tables.  The forests are fitted once in a
    session for the queries that ask them."""
    e = cut_lineage(model_entries(spark, sf).withColumn("vector", F.array(*RAW)))
    fitted = models.fit_models(e, RAW, PRIORITIES, CLASSIFIED)
    return e, cut_lineage(models.model_confidence(e, fitted))


@query("knowledge_model_confidence", "M4 M5", f"""
WITH {MODELLED} SELECT entry_id, type, CASE WHEN type IN ('1-URGENT', '2-HIGH') THEN 'class' ELSE 'value' END AS kind, true AS in_bounds FROM modelled
""")
def knowledge_model_confidence(spark, sf):
    _, out = fitted_confidence(spark, sf)
    kind = F.when(F.col("type").isin(*CLASSIFIED), "class").otherwise("value")
    sure = F.col("model_confidence")
    # the likeliest of four classes has a quarter at least
    in_bounds = (sure > 0) & (sure <= 1 + 1e-9) & ((kind == "value") | (sure >= 0.25))
    return out.select("entry_id", "type", kind.alias("kind"), in_bounds.alias("in_bounds"))


@query("gated_knowledge_matches", "M4 M5 J6", f"""
WITH {MODELLED} SELECT entry_id, type, true AS gate_held FROM modelled
""")
def gated_knowledge_matches(spark, sf):
    e, confidence = fitted_confidence(spark, sf)
    sure = models.gated(e, confidence, 0.9)
    matched = entry_confidence(sure.select("entry_id", "type", "ts", "vector", "outcome_value"), e)
    # every entry of a model: matches are looked for exactly where the model is sure
    all_of = confidence.join(matched.select("entry_id", "n_similar"), "entry_id", "left")
    held = (F.col("model_confidence") >= 0.9) == F.col("n_similar").isNotNull()
    return all_of.select("entry_id", "type", held.alias("gate_held"))
