"""Operation log, snapshot and vote queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.scalars import iso
from metricloom.operators import oplog
from metricloom.plans import inputs
from metricloom.plans.inputs import table
from metricloom.plans.oracle import OPERATIONS, SNAPSHOTS, VOTES, iso as siso, r6
from metricloom.plans.registry import query
from metricloom.plans.rounding import round6


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


@query("snapshot_history", "P6 L1", f"""
WITH {SNAPSHOTS} SELECT snapshot_id, {siso('ts')} AS ts FROM snaps
WHERE state_type = 'P' AND ts <= TIMESTAMP '1996-12-31' ORDER BY ts DESC, snapshot_id DESC LIMIT 100
""")
def snapshot_history(spark, sf):
    out = oplog.history(inputs.snapshots(spark, sf), "state_type", "ts", "snapshot_id", "P", end=stamp("1996-12-31"), limit=100)
    return out.select("snapshot_id", iso("ts").alias("ts"))


@query("rollback_history", "P7 L1", f"""
WITH {OPERATIONS} SELECT operation_id, {siso('created_at')} AS created_at, status FROM ops
WHERE operation_type = '3-MEDIUM' AND created_at >= TIMESTAMP '1995-01-01' AND created_at <= TIMESTAMP '1995-12-31'
ORDER BY created_at DESC, operation_id DESC LIMIT 40
""")
def rollback_history(spark, sf):
    out = oplog.history(
        inputs.operations(spark, sf), "operation_type", "created_at", "operation_id", "3-MEDIUM",
        stamp("1995-01-01"), stamp("1995-12-31"), 40,
    )
    return out.select("operation_id", iso("created_at").alias("created_at"), "status")


@query("event_filter", "P8 D19", """
SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND user_id IN (1, 2, 3, 5, 8, 13, 21, 34)
  AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-28' AND CAST(json_extract(props, '$.k') AS BIGINT) = 7
UNION ALL SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 42
""")
def event_filter(spark, sf):
    e = table(spark, sf, "events").withColumnsRenamed({"user_id": "source", "props": "metadata"})
    narrow = oplog.filter_events(
        e, ["click", "purchase"], [1, 2, 3, 5, 8, 13, 21, 34], stamp("2024-01-03"), stamp("2024-01-28"), {"k": "7"}
    )
    return narrow.unionByName(oplog.filter_events(e, metadata={"k": "42"})).select("event_id")


@query("operation_timeouts", "P23 D16", f"""
WITH {OPERATIONS}, f AS (SELECT *, status = 'in_progress' AND created_at < TIMESTAMP '1997-06-01' - INTERVAL 300 SECOND AS late FROM ops)
SELECT operation_id, CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN 'Operation timeout exceeded' END AS error FROM f
""")
def operation_timeouts(spark, sf):
    return oplog.flag_timeouts(inputs.operations(spark, sf), stamp("1997-06-01")).select("operation_id", "status", "error")


LOG = """
log AS (SELECT o_orderkey AS operation_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey - 1 END AS rollback_for FROM orders)
"""


@query("rolled_back_operations", "J16", f"""
WITH {LOG} SELECT a.operation_id, CASE WHEN a.status = 'failed' AND b.status = 'completed' THEN 'rolled_back' ELSE a.status END AS status
FROM log a LEFT JOIN log b ON b.rollback_for = a.operation_id
""")
def rolled_back_operations(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    key = F.col("o_orderkey")
    log = table(spark, sf, "orders").select(
        key.alias("operation_id"), status.alias("status"), F.when(key % 3 == 1, key - 1).alias("rollback_for")
    )
    return oplog.rolled_back(log).select("operation_id", "status")


@query("rollback_step_errors", "A25", """
SELECT l_orderkey AS operation_id, CASE WHEN bool_and(l_returnflag <> 'R') THEN 'completed' ELSE 'failed' END AS status,
  coalesce(string_agg(CASE WHEN l_returnflag = 'R' THEN 'Step ' || l_linenumber || ' failed: part ' || l_suppkey END, chr(10)
    ORDER BY l_linenumber, l_suppkey, l_shipdate, l_extendedprice), '') AS error
FROM lineitem GROUP BY 1
""")
def rollback_step_errors(spark, sf):
    steps = inputs.operation_steps(spark, sf).withColumn("error", F.concat(F.lit("part "), F.col("part_id").cast("string")))
    return oplog.rollback_outcome(steps, ["step_id", "part_id", "finished_at", "after"])


@query("rollback_error_parts", "A25", """
WITH failed AS (
  SELECT l_orderkey AS operation_id, 'Step ' || l_linenumber || ' failed: part ' || l_suppkey AS said,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_shipdate, l_extendedprice) - 1 AS place
  FROM lineitem WHERE l_returnflag = 'R'),
parts AS (SELECT operation_id, place // 2 AS part, string_agg(said, chr(10) ORDER BY place) AS error FROM failed GROUP BY ALL),
states AS (SELECT l_orderkey AS operation_id, CASE WHEN bool_and(l_returnflag <> 'R') THEN 'completed' ELSE 'failed' END AS status,
  count(*) FILTER (l_returnflag = 'R') AS failures FROM lineitem GROUP BY 1)
SELECT operation_id, status, failures, part, error FROM states LEFT JOIN parts USING (operation_id)
""")
def rollback_error_parts(spark, sf):
    """Texts of long operations as rows, two lines each here, beside one status row."""
    steps = inputs.operation_steps(spark, sf).withColumn("error", F.concat(F.lit("part "), F.col("part_id").cast("string")))
    parts = oplog.rollback_error_parts(steps, ["step_id", "part_id", "finished_at", "after"], size=2)
    return oplog.rollback_status(steps).join(parts, "operation_id", "left")


@query("rollback_state_rows", "A30", """
SELECT l_orderkey AS operation_id, l_linenumber AS step_id, max_by(l_quantity, (l_shipdate, l_suppkey, l_extendedprice, l_quantity)) AS before,
  max_by(l_extendedprice, (l_shipdate, l_suppkey, l_extendedprice, l_quantity)) AS after FROM lineitem GROUP BY 1, 2
""")
def rollback_state_rows(spark, sf):
    return oplog.state_snapshot_rows(inputs.operation_steps(spark, sf), ["finished_at", "part_id", "after", "before"])


@query("rollback_state_snapshots", "A30", f"""
WITH last AS (
  SELECT l_orderkey AS operation_id, l_linenumber AS step_id, max_by(l_quantity, (l_shipdate, l_suppkey, l_extendedprice, l_quantity)) AS b,
    max_by(l_extendedprice, (l_shipdate, l_suppkey, l_extendedprice, l_quantity)) AS a FROM lineitem GROUP BY 1, 2)
SELECT operation_id, string_agg(step_id || '=' || CAST(b AS VARCHAR) || '>' || CAST(a AS VARCHAR), ',' ORDER BY step_id) AS states FROM last GROUP BY 1
""")
def rollback_state_snapshots(spark, sf):
    out = oplog.state_snapshots(inputs.operation_steps(spark, sf), ["finished_at", "part_id", "after", "before"])
    shown = F.transform(F.map_entries("states"), lambda e: F.concat(
        e["key"].cast("string"), F.lit("="), e["value"]["before"].cast("string"), F.lit(">"), e["value"]["after"].cast("string")
    ))
    return out.select("operation_id", F.array_join(shown, ",").alias("states"))


@query("step_durations", "F10", f"""
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, {r6('epoch(l_shipdate) - epoch(o_orderdate)')} AS duration_seconds
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""")
def step_durations(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = oplog.step_durations(j, "o_orderdate", "l_shipdate")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", round6("duration_seconds").alias("duration_seconds"))


@query("container_records_kept", "P27", """
SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE NOT coalesce(o_orderstatus = 'F' AND done < TIMESTAMP '1998-01-01' - INTERVAL 7 DAY, false)
""")
def container_records_kept(spark, sf):
    done = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("finished_at"))
    c = table(spark, sf, "orders").join(done, "o_orderkey", "left").withColumn(
        "state", F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("running")
    )
    return oplog.container_retention(c, stamp("1998-01-01")).select("o_orderkey")


@query("container_config_merge", "P27", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'always' ELSE 'no' END AS restart_policy,
  CASE WHEN c_nationkey % 5 = 0 THEN c_mktsegment ELSE 'bridge' END AS network_mode, c_name AS hostname FROM customer
""")
def container_config_merge(spark, sf):
    defaults = F.create_map(
        F.lit("restart_policy"), F.lit("no"), F.lit("network_mode"), F.lit("bridge"), F.lit("hostname"), F.col("c_name")
    )
    pair = lambda on, k, v: F.when(on, F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,string>"))
    given = F.map_concat(
        pair(F.col("c_custkey") % 2 == 0, "restart_policy", F.lit("always")),
        pair(F.col("c_nationkey") % 5 == 0, "network_mode", F.col("c_mktsegment")),
    )
    c = table(spark, sf, "customer").select("c_custkey", oplog.merge_config(defaults, given).alias("m"))
    return c.select("c_custkey", *[F.col("m")[k].alias(k) for k in ("restart_policy", "network_mode", "hostname")])


@query("snapshot_versions_and_parents", "J15 W15 D14 F2", f"""
WITH {SNAPSHOTS}
SELECT snapshot_id, state_type, row_number() OVER w AS version, lag(snapshot_id) OVER w AS parent_id,
  sha256('{{"priority":"' || priority || '","price":' || CAST(price AS VARCHAR) || '}}') AS checksum
FROM snaps WINDOW w AS (PARTITION BY state_type ORDER BY ts, snapshot_id)
""")
def snapshot_versions_and_parents(spark, sf):
    return oplog.snapshot_log(inputs.snapshots(spark, sf)).select("snapshot_id", "state_type", "version", "parent_id", "checksum")


@query("latest_snapshot_per_type", "L4", f"""
WITH {SNAPSHOTS}, v AS (SELECT *, row_number() OVER (PARTITION BY state_type ORDER BY ts, snapshot_id) AS version FROM snaps)
SELECT 'latest' AS kind, state_type, max(version) AS version, max_by(snapshot_id, version) AS snapshot_id FROM v GROUP BY state_type
UNION ALL SELECT 'at', state_type, version, snapshot_id FROM v WHERE state_type = 'O' AND version = 17
""")
def latest_snapshot_per_type(spark, sf):
    log = oplog.snapshot_log(inputs.snapshots(spark, sf))
    columns = lambda kind, df: df.select(F.lit(kind).alias("kind"), "state_type", "version", "snapshot_id")
    return columns("latest", oplog.latest_snapshots(log)).unionByName(columns("at", oplog.snapshot_at(log, "O", 17)))


UPDATES = """
updates AS (SELECT o_orderkey AS update_id, o_orderstatus AS state_type, o_orderdate AS ts, o_custkey % 5 AS node,
  CAST(floor(o_totalprice) AS BIGINT) % 5000 + epoch(o_orderdate) // 86400 AS version FROM orders)
"""


def updates(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("update_id"), F.col("o_orderstatus").alias("state_type"), F.col("o_orderdate").alias("ts"),
        (F.col("o_custkey") % 5).alias("node"),
        (F.floor("o_totalprice") % 5000 + F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)).cast("bigint").alias("version"),
    )


@query("version_gated_updates", "P22 I5", f"""
WITH {UPDATES}
SELECT update_id, state_type, CAST(version AS BIGINT) AS version FROM (
  SELECT *, max(version) OVER (PARTITION BY state_type ORDER BY ts, update_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
  FROM updates WHERE node <> 2) WHERE version > coalesce(held, 0)
""")
def version_gated_updates(spark, sf):
    return oplog.version_gate(updates(spark, sf), 2).select("update_id", "state_type", "version")


@query("paged_listing", "L6 D19", """
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total_count
FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50
""")
def paged_listing(spark, sf):
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "O").select("o_orderkey", "o_totalprice")
    return oplog.page(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, 25)


@query("first_proposal_messages", "P28 D15", f"""
SELECT l_partkey AS proposal_id, {siso('min(l_shipdate)')} AS ts, min_by(l_suppkey, (l_shipdate, l_orderkey, l_suppkey, l_linenumber, l_extendedprice)) AS proposer,
  {siso('min(l_shipdate) + INTERVAL 30 SECOND')} AS expiration FROM lineitem GROUP BY 1
""")
def first_proposal_messages(spark, sf):
    m = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("proposal_id"), F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("proposer"),
        "l_orderkey", "l_linenumber", "l_extendedprice",
    )
    out = oplog.first_proposals(m, ["l_orderkey", "proposer", "l_linenumber", "l_extendedprice"])
    return out.select("proposal_id", iso("ts").alias("ts"), "proposer", iso("expiration").alias("expiration"))


ORDER = ["ts", "tie1", "tie2", "tie3"]
TALLY = f"""
{VOTES},
valid AS (SELECT v.* FROM votes v JOIN proposals p ON p.proposal_id = v.proposal_id AND v.ts >= p.ts AND v.ts <= expiration),
steps AS (SELECT *, lag(vote) OVER mine AS had FROM valid WINDOW mine AS (PARTITION BY proposal_id, voter ORDER BY ts, tie1, tie2, tie3)),
running AS (
  SELECT *, count(*) FILTER (had IS NULL) OVER upto AS total, CAST(sum(vote::INT - coalesce(had::INT, 0)) OVER upto AS BIGINT) AS yes
  FROM steps WINDOW upto AS (PARTITION BY proposal_id ORDER BY ts, tie1, tie2, tie3 ROWS UNBOUNDED PRECEDING)),
judged AS (SELECT *, CASE WHEN total >= 2 AND yes >= 2 THEN 'accepted' WHEN total >= 2 AND total - yes > 1 THEN 'rejected' END AS s FROM running),
decided AS (
  SELECT proposal_id, coalesce(min_by(total, (ts, tie1, tie2, tie3)) FILTER (s IS NOT NULL), max_by(total, (ts, tie1, tie2, tie3))) AS total,
    coalesce(min_by(yes, (ts, tie1, tie2, tie3)) FILTER (s IS NOT NULL), max_by(yes, (ts, tie1, tie2, tie3))) AS yes,
    coalesce(min_by(s, (ts, tie1, tie2, tie3)) FILTER (s IS NOT NULL), 'open') AS state
  FROM judged GROUP BY 1)
"""


@query("votes_before_expiry", "J10", f"""
WITH {TALLY} SELECT proposal_id, count(*) AS n_votes, {siso('max(ts)')} AS last_ts FROM valid GROUP BY 1
""")
def votes_before_expiry(spark, sf):
    v = oplog.accepted_votes(inputs.votes(spark, sf), inputs.proposals(spark, sf))
    return v.groupBy("proposal_id").agg(F.count("*").alias("n_votes"), iso(F.max("ts")).alias("last_ts"))


@query("vote_tally", "A21 J10", f"WITH {TALLY} SELECT proposal_id, total, yes, state FROM decided")
def vote_tally(spark, sf):
    return oplog.tally(oplog.accepted_votes(inputs.votes(spark, sf), inputs.proposals(spark, sf)), ORDER)


@query("allowed_proposals", "J11", f"""
WITH {VOTES} SELECT proposal_id FROM proposals
WHERE proposal_type IN (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING avg(o_totalprice) > (SELECT avg(o_totalprice) FROM orders))
  AND proposer IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
""")
def allowed_proposals(spark, sf):
    o = table(spark, sf, "orders")
    mean = o.agg(F.avg("o_totalprice")).scalar()
    types = o.groupBy(F.col("o_orderpriority").alias("proposal_type")).agg(F.avg("o_totalprice").alias("m")).filter(F.col("m") > mean)
    members = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("proposer"))
    return oplog.allowed_proposals(inputs.proposals(spark, sf), types, members).select("proposal_id")


@query("final_proposal_status", "A31 A21", f"""
WITH {TALLY}
SELECT p.proposal_id, CASE coalesce(state, 'open') WHEN 'accepted' THEN 'executed' ELSE coalesce(state, 'open') END AS state
FROM proposals p LEFT JOIN decided USING (proposal_id)
WHERE coalesce(state, 'open') <> 'open' OR expiration >= TIMESTAMP '1998-06-01'
""")
def final_proposal_status(spark, sf):
    p = inputs.proposals(spark, sf)
    t = oplog.tally(oplog.accepted_votes(inputs.votes(spark, sf), p), ORDER)
    return oplog.final_status(p, t, stamp("1998-06-01")).select("proposal_id", "state")


@query("cooldown_applied_actions", "I7", """
WITH RECURSIVE c AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value > 60),
f AS (
  SELECT event_id, user_id, k, ts AS last, true AS applied FROM c WHERE k = 1
  UNION ALL
  SELECT c.event_id, c.user_id, c.k, CASE WHEN c.ts - f.last >= INTERVAL 2 DAY THEN c.ts ELSE f.last END, c.ts - f.last >= INTERVAL 2 DAY
  FROM f JOIN c ON c.user_id = f.user_id AND c.k = f.k + 1)
SELECT event_id, user_id, applied FROM f
""")
def cooldown_applied_actions(spark, sf):
    c = table(spark, sf, "events").filter("value > 60").select("event_id", "user_id", "ts")
    out = oplog.apply_cooldown(c, ["user_id"], "ts", ["event_id"], 2 * 86_400)
    return out.select("event_id", "user_id", "applied")
