"""SQL twins of the derived inputs, as common table expressions for DuckDB."""

from __future__ import annotations


def r6(expr: str) -> str:
    """Rounding as in ``plans.rounding.round6``."""
    return f"(round(({expr}) + 3.3e-8, 6) + 0)"


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%f')"


POINTS = """
mp AS (
  SELECT event_id AS point_id, event_type AS name, ts, value, user_id,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)
"""

GRID = """
per_ts AS (SELECT event_type AS name, ts, avg(value) AS v FROM events GROUP BY event_type, ts),
hourly AS (SELECT name, date_trunc('hour', ts) AS h, avg(v) AS v FROM per_ts GROUP BY 1, 2),
span AS (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events),
hours AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h FROM span),
names AS (SELECT DISTINCT event_type AS name FROM events),
grid AS (
  SELECT names.name, hours.h, hourly.v
  FROM names CROSS JOIN hours
  LEFT JOIN hourly ON hourly.name = names.name AND hourly.h = hours.h)
"""

FILLED = GRID + """,
near AS (
  SELECT name, h, v,
    last_value(v IGNORE NULLS) OVER back AS pv,
    last_value(CASE WHEN v IS NOT NULL THEN h END IGNORE NULLS) OVER back AS ph,
    first_value(v IGNORE NULLS) OVER ahead AS nv,
    first_value(CASE WHEN v IS NOT NULL THEN h END IGNORE NULLS) OVER ahead AS nh,
    row_number() OVER (PARTITION BY name ORDER BY h) - 1 AS i
  FROM grid
  WINDOW back AS (PARTITION BY name ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY name ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT name, h, i, CASE
      WHEN v IS NOT NULL THEN v
      WHEN pv IS NULL THEN NULL
      WHEN nv IS NULL THEN pv
      ELSE pv + (nv - pv) * (epoch(h) - epoch(ph)) / (epoch(nh) - epoch(ph)) END AS v
  FROM near)
"""

UTIL = """
util AS (
  SELECT date_trunc('hour', ts) AS h,
    avg(value) FILTER (WHERE event_type = 'click') / 100 AS cpu,
    avg(value) FILTER (WHERE event_type = 'view') / 100 AS memory,
    CAST(count(*) AS DOUBLE) AS request_rate,
    count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS DOUBLE) AS error_rate,
    avg(value) FILTER (WHERE event_type = 'purchase') AS response_time
  FROM events GROUP BY 1)
"""

USER_POINTS = """
up AS (
  SELECT event_id, user_id, ts, event_type, value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx
  FROM events)
"""

ENTRIES = """
feat AS (
  SELECT l_orderkey, avg(l_quantity) AS f_quantity, avg(l_discount) AS f_discount,
    avg(l_tax) AS f_tax, avg(l_extendedprice) AS f_price
  FROM lineitem GROUP BY 1),
entries AS (
  SELECT o_orderkey AS entry_id, o_orderpriority AS type, o_orderdate AS ts,
    (o_orderkey % 100) / 100.0::DOUBLE AS confidence, o_totalprice AS outcome_value,
    f_quantity, f_discount, f_tax, f_price
  FROM orders JOIN feat ON o_orderkey = l_orderkey)
"""

SNAPSHOTS = """
snaps AS (
  SELECT o_orderkey AS snapshot_id, o_orderstatus AS state_type, o_orderdate AS ts,
    o_totalprice AS price, o_orderpriority AS priority
  FROM orders)
"""

OPERATIONS = """
ops AS (
  SELECT o_orderkey AS operation_id, o_orderpriority AS operation_type, o_custkey AS service,
    o_orderdate AS created_at, done AS completed_at,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'pending' END AS status
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem GROUP BY 1)
    ON o_orderkey = l_orderkey)
"""

VOTES = """
proposals AS (
  SELECT o_orderkey AS proposal_id, o_orderpriority AS proposal_type, o_custkey AS proposer,
    o_orderdate AS ts, o_orderdate + INTERVAL 365 DAY AS expiration
  FROM orders),
votes AS (
  SELECT l_orderkey AS proposal_id, l_suppkey % 3 AS voter, l_returnflag <> 'R' AS vote,
    l_shipdate AS ts, l_suppkey AS tie1, l_linenumber AS tie2, l_extendedprice AS tie3
  FROM lineitem)
"""
