"""Helpers that split hot keys, against brute force."""

import random
import tracemalloc
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricloom.operators import clustering, oplog, similarity, sliding, thresholds
from metricloom.operators.aggregates import exact_quantile, range_aggregates
from metricloom.operators.chunks import CHUNK, in_order, ordered_chunks, positions, previous_values, running_total
from metricloom.operators.windows import trailing_count
from metricloom.session import cut_lineage

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(7)
    rows = [(i, "hot" if rnd.random() < 0.9 else f"k{rnd.randrange(5)}", T0 + timedelta(seconds=rnd.randrange(20 * 86_400)), rnd.gauss(0, 10))
            for i in range(4000)]
    pdf = pd.DataFrame(rows, columns=["id", "key", "ts", "value"]).sort_values(["key", "ts", "id"]).reset_index(drop=True)
    df = spark.createDataFrame(rows, "id bigint, key string, ts timestamp_ntz, value double")
    return df, pdf


def by_id(df, column):
    return {r["id"]: r[column] for r in df.select("id", column).collect()}


def test_positions_previous_and_totals(frame):
    df, pdf = frame
    g = pdf.groupby("key")
    want = dict(zip(pdf["id"], g.cumcount()))
    assert by_id(positions(df, ["key"], "ts", ["id"], chunk_seconds=3600), "position") == want
    got = by_id(previous_values(df, ["key"], "ts", ["id"], {"prev": "id"}, 3600), "prev")
    prev = dict(zip(pdf["id"], g["id"].shift()))
    assert all((got[i] is None and pd.isna(p)) or got[i] == p for i, p in prev.items())
    totals = by_id(running_total(df, ["key"], "ts", ["id"], {"n": F.lit(1), "s": F.col("value")}, 3600), "s")
    assert all(abs(totals[i] - s) < 1e-9 * 4000 for i, s in zip(pdf["id"], g["value"].cumsum()))


def test_trailing_count(frame):
    df, pdf = frame
    got = by_id(trailing_count(df, ["key"], "ts", 7200, chunk_seconds=3600), "n_recent")
    for _, part in pdf.groupby("key"):
        t = part["ts"].to_numpy().astype("datetime64[s]").astype(np.int64)
        n = np.searchsorted(t, t, side="right") - np.searchsorted(t, t - 7200, side="left")
        assert [got[i] for i in part["id"]] == n.tolist()


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_quantile_of_a_key_larger_than_the_sketch(spark, frame, q):
    df, pdf = frame
    got = {r["key"]: r["p"] for r in exact_quantile(df, ["key"], "value", q, "p", accuracy=200).collect()}
    want = pdf.groupby("key")["value"].quantile(q)
    assert set(got) == set(want.index) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_quantile_with_heavy_copies(spark):
    df = spark.range(30_000).select(F.lit("k").alias("key"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 1000.0).alias("value"))
    values = np.where(np.arange(30_000) % 3 == 0, 5.0, np.arange(30_000) / 1000.0)
    for q in (0.2, 0.5, 0.9):
        got = exact_quantile(df, ["key"], "value", q, "p", accuracy=500).first()["p"]
        assert abs(got - np.quantile(values, q)) < 1e-9


def test_range_aggregates_of_a_large_key(frame):
    df, pdf = frame
    got = {r["key"]: r for r in range_aggregates(df, ["key"], "value", 0.9, accuracy=200).collect()}
    for key, part in pdf.groupby("key")["value"]:
        r = got[key]
        assert r["n_points"] == len(part) and r["min_value"] == part.min() and r["max_value"] == part.max()
        assert abs(r["sum_value"] - part.sum()) < 1e-6 and abs(r["avg_value"] - part.mean()) < 1e-9
        assert abs(r["p_value"] - part.quantile(0.9)) < 1e-9


def test_best_match_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 6))
    v[10] = v[50] = v[90]  # equal vectors tie: the first id wins
    v[20] = 0
    df = spark.createDataFrame([(i, "t", row.tolist()) for i, row in enumerate(v)], "id bigint, type string, vector array<double>")
    p, q = df.withColumnRenamed("id", "probe_id"), df.withColumnRenamed("id", "library_id")
    results = [
        {r["probe_id"]: (r["library_id"], round(r["similarity"], 9)) for r in similarity.best_matches(p, q, ["type"], 0.2, block_rows=b, exclude_self=True).collect()}
        for b in (4096, 17)
    ]
    assert results[0] == results[1] and results[0][90][0] == 10 and results[0][10][0] == 50 and 20 not in results[0]


def test_density_clusters_agree_with_a_plain_search(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(c, 0.25, size=(60, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 4, 1))] + [rng.uniform(-6, 6, size=(40, 3))])
    pts = np.vstack([pts, rng.normal((-4, 3, 0), 0.04, size=(80, 3))])  # one dense ball
    pts = np.vstack([pts, np.repeat([[9.0, 9.0, 9.0]], 6, axis=0)])  # copies make one core point
    eps, need = 0.4, 5
    near = np.linalg.norm(pts[:, None] - pts[None], axis=2) <= eps
    core = near.sum(axis=1) >= need
    label = np.full(len(pts), -1)
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        stack, label[i] = [i], i
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & core):
                if label[j] < 0:
                    label[j] = i
                    stack.append(j)
    for i in np.flatnonzero(~core):
        reach = label[np.flatnonzero(near[i] & core)]
        label[i] = reach.min() if len(reach) else -1
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id bigint, a double, b double, c double")
    got = {r["id"]: (r["core"], r["label"]) for r in clustering.density_clusters(df, "id", ["a", "b", "c"], eps, need).collect()}
    assert got == {i: (bool(core[i]), int(label[i])) for i in range(len(pts))}


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    other = spark.createDataFrame([(1000, 1001), (1001, 1002)], "u bigint, v bigint")
    roots = {r["node"]: r["root"] for r in clustering.connected_components(edges.unionByName(other)).collect()}
    assert set(roots.values()) == {0, 1000} and len(roots) == 204


# --- a hot minute ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def minute(spark):
    """90 % of the rows in one key and minute, half of these at one instant."""
    rnd = random.Random(11)
    rows = []
    for i in range(6000):
        if rnd.random() < 0.9:
            rows.append((i, "hot", T0 + timedelta(hours=5, seconds=0 if rnd.random() < 0.5 else rnd.randrange(60), microseconds=rnd.randrange(3)), rnd.randrange(100)))
        else:
            rows.append((i, f"k{rnd.randrange(3)}", T0 + timedelta(seconds=rnd.randrange(5 * 86_400)), rnd.randrange(100)))
    pdf = pd.DataFrame(rows, columns=["id", "key", "ts", "value"]).sort_values(["key", "ts", "id"]).reset_index(drop=True)
    return cut_lineage(spark.createDataFrame(rows, "id bigint, key string, ts timestamp_ntz, value bigint").repartition(4)), pdf


def test_chunks_are_bounded_by_rows_and_keep_the_order(minute):
    df, pdf = minute
    chunked = ordered_chunks(df, ["key"], "ts", ["id"], rows=400)
    own = {r["id"]: tuple(r[CHUNK]) for r in chunked.collect()}
    assert len(own) == len(pdf)
    for key, part in pdf.groupby("key"):
        chunks = [own[i] for i in part["id"]]
        assert chunks == sorted(chunks) and max(Counter(chunks).values()) < 1000
    hot = {own[i] for i in pdf.loc[pdf["key"] == "hot", "id"]}
    assert len(hot) > 8


def test_order_inside_a_hot_minute(minute):
    """Positions, totals and lags of cut and of whole spans equal brute force."""
    df, pdf = minute
    g = pdf.groupby("key")
    want = {r.id: r for r in pdf.assign(position=g.cumcount(), total=g["value"].cumsum(), before=g["id"].shift()).itertuples()}
    for rows in (400, 1_000_000):
        out = in_order(df, ["key"], "ts", ["id"], position="position", sums={"total": F.col("value")}, previous={"before": "id"}, rows=rows).collect()
        assert len(out) == len(pdf)
        for r in out:
            w = want[r.id]
            assert (r.position, r.total) == (w.position, w.total) and (pd.isna(w.before) if r.before is None else r.before == w.before)
    assert set(out[0].asDict()) == {"id", "key", "ts", "value", "position", "total", "before"}


def test_trailing_count_of_a_hot_minute(minute):
    df, pdf = minute
    for seconds in (0, 7, 3600, 86_400):
        got = by_id(trailing_count(df, ["key"], "ts", seconds, rows=300), "n_recent")
        for _, part in pdf.groupby("key"):
            t = part["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            n = np.searchsorted(t, t, side="right") - np.searchsorted(t, t - seconds * 10**6, side="left")
            assert [got[i] for i in part["id"]] == n.tolist()


@pytest.mark.parametrize("seconds, rows", [(300, 100_000), (3, 25), (40_000, 400), (1, 25), (0, 25)])
def test_cooldown_by_composed_chunks(minute, seconds, rows):
    """One island may span everything: maps of chunks give what the plain fold gives."""
    df, pdf = minute
    got = {r["id"]: r["applied"] for r in oplog.apply_cooldown(df, ["key"], "ts", ["id"], seconds, rows=rows).collect()}
    want = {}
    for _, part in pdf.groupby("key"):
        last = None
        for i, t in zip(part["id"], part["ts"]):
            want[i] = last is None or (t - last).total_seconds() >= seconds
            last = t if want[i] else last
    assert got == want


def test_cooldown_map_by_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        t = np.array(sorted(rnd.sample(range(100, 160), rnd.randrange(1, 20))))
        cooldown = rnd.randrange(1, 40)
        starts, exits = oplog._cooldown_map(t, cooldown)
        for entry in range(40, int(t[0])):
            last = entry
            for x in t:
                last = x if x - last >= cooldown else last
            i = np.searchsorted(starts, entry + cooldown)
            assert (exits[i] if i < len(starts) else entry) == last


# --- sliding quantiles by panes -------------------------------------------------------


def plain_quantile(part, window, q):
    """Quantile of (t - window, t] for every instant of a key, from sorted slices."""
    t, v = part["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), part["value"].to_numpy(float)
    out = {}
    for x in np.unique(t):
        own = v[(t > x - window * 10**6) & (t <= x)]
        own = own[~np.isnan(own)]
        out[x] = np.quantile(own, q) if len(own) else None
    return out


@pytest.mark.parametrize("window, q, events, bins", [(60, 0.9, 300, 16), (2, 0.5, 150, 256), (40_000, 0.99, 500, 4), (3600, 0.0, 400, 8), (3600, 1.0, 400, 8)])
def test_sliding_quantile_by_panes(minute, window, q, events, bins):
    df, pdf = minute
    pdf = pdf.assign(value=np.where(pdf["id"] % 50 == 0, np.nan, pdf["value"] + (pdf["id"] % 7) / 10))
    values = F.when(F.col("id") % 50 != 0, F.col("value") + (F.col("id") % 7) / 10)
    points = df.withColumn("value", values).withColumn("pct", F.lit(100 * q))
    got = sliding.sliding_quantile(points, ["key"], "pct", window_seconds=window, events=events, bins=bins).collect()
    found = {(r["key"], int((r["ts"] - datetime(1970, 1, 1)) / timedelta(microseconds=1))): r["percentile_value"] for r in got}
    assert len(found) == len(got)
    want = {(key, t): x for key, part in pdf.groupby("key") for t, x in plain_quantile(part, window, q).items()}
    assert set(found) == set(want)
    assert all((found[k] is None) if x is None else abs(found[k] - x) < 1e-9 for k, x in want.items())


def test_both_forms_of_the_trailing_percentile_agree(minute):
    df, pdf = minute
    points = df.withColumn("pct", F.lit(75.0))
    one = thresholds.trailing_percentile(points, ["key"], "pct", window_seconds=30)
    two = thresholds.trailing_percentile(points, ["key"], "pct", window_seconds=30, task_rows=200)
    a, b = by_id(one, "percentile_value"), by_id(two, "percentile_value")
    assert one.columns == two.columns and len(a) == len(b) == len(pdf) and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_cooldown_of_many_small_keys(spark):
    """Keys on both sides of 1970, some cut: no call per key, each its own fold."""
    rnd = random.Random(7)
    rows = [(k, i, rnd.randrange(-400, 400)) for i, k in enumerate([rnd.randrange(600) for _ in range(3000)] + [1000] * 500)]
    df = spark.createDataFrame(rows + [(None, 9000, 5), (3, 9001, None)], "key long, id long, s long").selectExpr("key", "id", "timestamp_seconds(s * 86400) AS ts")
    for size in (100_000, 40):
        out = oplog.apply_cooldown(df, ["key"], "ts", ["id"], 30 * 86_400, rows=size)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        want, last = {}, {}
        for k, i, s in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
            want[i] = k not in last or s - last[k] >= 30
            last[k] = s if want[i] else last[k]
        assert {r["id"]: r["applied"] for r in out.collect()} == want


def test_small_keys_are_ordered_whole(spark):
    """No shuffle beside the one by key, and what chunks would give: nulls included."""
    rnd = random.Random(11)
    rows = [(rnd.randrange(40) or None, i, rnd.randrange(9) * 40_000 or None, rnd.choice([None, 1, 2, 5])) for i in range(4000)]
    df = spark.createDataFrame(rows, "key long, id long, s long, v long").selectExpr("key", "id", "timestamp_seconds(s) AS ts", "v")
    ask = {"position": "place", "sums": {"total": F.col("v")}, "previous": {"had": "v"}}
    whole = in_order(df.repartition("key"), ["key"], "ts", ["id"], **ask)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    cut = in_order(df, ["key"], "ts", ["id"], rows=100, **ask)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.select(whole.columns).collect()))


def test_similarity_blocks_hold_one_tile_of_cosines():
    """Two blocks of 4,096 rows: the whole table of cosines would be 134 MB."""
    rows = np.random.default_rng(5).normal(size=(4096, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    sims = np.round(rows @ rows.T, 12)
    np.fill_diagonal(sims, -2.0)
    best, some = sims.argmax(axis=1), np.nonzero(sims >= 0.95)
    del sims
    index = np.arange(len(rows))
    tracemalloc.start()
    at, top = similarity.best_rows(rows, rows, lambda part: index[part, None] == index[None, :])
    i, j, close = similarity.close_rows(rows, rows, 0.95, lambda a, b: a != b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    assert (at == best).all() and (close >= 0.95).all()
    assert (i == some[0]).all() and (j == some[1]).all()


def test_edges_of_a_partition_become_a_forest(spark):
    """A dense graph of 60,000 edges over 300 nodes: no partition passes on more than a forest, in parts smaller than its edges."""
    edges = [(i, j) for c in range(2) for i in range(c * 150, c * 150 + 150) for j in range(c * 150, c * 150 + 150)] + [(400, 400), (7, None), (None, None)]
    df = spark.createDataFrame(edges * 2, "u bigint, v bigint").repartition(3)
    before, clustering.FOREST_EDGES = clustering.FOREST_EDGES, 1000
    try:
        thin = clustering.spanning_forest(df).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    finally:
        clustering.FOREST_EDGES = before
    assert len(thin) <= 3 and all(r["count"] <= 298 for r in thin)
    roots = {r["node"]: r["root"] for r in clustering.connected_components(df).collect()}
    assert roots == {i: 0 if i < 150 else 150 for i in range(300)}


def test_stars_against_a_plain_search():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (30, 20), (200, 150), (200, 400)):
        u, v = rng.integers(0, n, m) * 7 - 50, rng.integers(0, n, m) * 7 - 50
        low = {x: x for x in [*u, *v]}
        for _ in range(len(low)):
            for a, b in zip(u, v):
                low[a] = low[b] = min(low[a], low[b])
        got = dict(zip(*clustering.stars(u, v)))
        assert got == {x: r for x, r in low.items() if x != r}
