"""Small cases computed by hand."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions.scalars import clamp, cosine, outcome_similarity
from metricloom.operators import allocate, decide, detect, features, oplog, prepare, quality, thresholds, windows
from metricloom.operators.knowledge import assign_versions, entry_confidence
from metricloom.operators.library import merge_into_library, query_library, temporal_histogram

T0 = datetime(2024, 3, 1)


def points(spark, series, step=60):
    rows = [(i, n, T0 + timedelta(seconds=step * k), float(v)) for n, vs in series.items()
            for i, (k, v) in enumerate((k, v) for k, v in enumerate(vs) if v is not None)]
    return spark.createDataFrame(rows, "point_id bigint, name string, ts timestamp_ntz, value double")


def test_slope_of_a_line_and_its_texts(spark):
    p = points(spark, {"cpu_usage": [50 + 0.5 * i for i in range(120)], "memory_usage": [90 - 0.2 * i for i in range(120)]})
    found = {r["metrics"][0]: r for r in detect.trends(prepare.regular_grid(p)).collect()}
    cpu, mem = found["cpu_usage"], found["memory_usage"]
    assert math.isclose(cpu["severity"], 0.5, abs_tol=1e-9) and cpu["confidence"] == 1.0
    assert cpu["description"] == "Increasing trend detected in cpu_usage"
    assert cpu["suggested_action"] == "Consider scaling up CPU resources"
    assert mem["suggested_action"] == "Consider decreasing memory allocation"
    assert math.isclose(mem["confidence"], 0.4, abs_tol=1e-9)


def test_trend_needs_no_leading_gap(spark):
    p = points(spark, {"a": [None, 1, 2, 3, 4], "b": [0, 1, 2, 3, 4]})
    assert [r["name"] for r in detect.trend_slopes(prepare.regular_grid(p)).collect()] == ["b"]


def test_two_stage_mean_counts_a_repeated_timestamp_once(spark):
    rows = [(T0, 10.0), (T0, 20.0), (T0 + timedelta(seconds=30), 100.0)]
    p = spark.createDataFrame([("m", *r) for r in rows], "name string, ts timestamp_ntz, value double")
    assert prepare.regular_grid(p).collect()[0]["value"] == (15 + 100) / 2


def test_interpolation_keeps_leading_nulls_and_carries_the_end(spark):
    p = points(spark, {"a": [None, 1, None, None, 4, None], "b": [0, 0, 0, 0, 0, 0]})
    got = prepare.regular_grid(p).filter("name = 'a'").orderBy("i").collect()
    assert [r["filled"] for r in got] == [None, 1, 2, 3, 4, 4]
    assert [r["carried"] for r in got] == [None, 1, 1, 1, 4, 4]
    assert [r["value"] for r in got] == [None, 1, None, None, 4, None]


def test_anomaly_run_at_the_end_ends_at_the_last_bucket(spark):
    p = points(spark, {"a": [1.0, 1.1] * 40 + [50.0]})
    got = detect.anomaly_ranges(detect.rolling_anomalies(prepare.regular_grid(p)), 60).collect()
    assert len(got) == 1 and got[0]["end_ts"] == got[0]["start_ts"] == T0 + timedelta(minutes=80)


def test_constant_series_has_no_anomaly_no_correlation_and_half_scale(spark):
    p = points(spark, {"a": [5.0] * 80, "b": [float(i) for i in range(80)]})
    grid = prepare.regular_grid(p)
    assert detect.rolling_anomalies(grid).filter("anomalous and name = 'a'").count() == 0
    assert detect.pair_correlations(grid, ["a", "b"]).first()["r"] is None
    assert {r[0] for r in windows.min_max_normalise(p.filter("name = 'a'"), ["name"]).select("normalised").collect()} == {0.5}
    assert windows.global_anomalies(p.filter("name = 'a'"), ["name"]).count() == 0


def test_anomaly_list(spark):
    p = points(spark, {"a": [1, 2, 3, 10, 2, 3]})
    assert [r["value"] for r in windows.global_anomalies(p, ["name"]).collect()] == [10.0]
    averages = windows.moving_average(p, ["name"], ["point_id"]).orderBy("position").collect()
    assert [r["moving_avg"] for r in averages] == [3.6, 4.0]


def test_moving_average_across_chunks(spark):
    values = [float((i * 37) % 11) for i in range(50)]
    p = points(spark, {"a": values})
    got = windows.moving_average(p, ["name"], ["point_id"], width=5, size=7).orderBy("position").collect()
    want = [sum(values[i - 4:i + 1]) / 5 for i in range(4, 50)]
    assert [r["position"] for r in got] == list(range(4, 50))
    assert all(math.isclose(r["moving_avg"], w) for r, w in zip(got, want))


def test_seasonality_of_a_pure_season(spark):
    p = points(spark, {"a": [math.sin(2 * math.pi * i / 12) for i in range(60)]})
    assert math.isclose(detect.seasonal_strength(prepare.regular_grid(p), 12).first()["strength"], 1.0, abs_tol=1e-6)
    assert detect.seasonal_strength(prepare.regular_grid(p), 60).count() == 0  # fewer than two periods


def test_sine_is_periodic_and_spike_wins_over_trend(spark):
    series = [
        (1, [math.sin(2 * math.pi * i / 8) for i in range(24)]),
        (2, [float(v) for v in (10, 15, 25, 40, 60, 45, 30, 20, 15, 10)]),
        (3, [float(i) for i in range(20)]),
        (4, [7.0] * 12),
        (5, [1.0, 2.0]),
        (6, [0.0] * 19 + [100.0]),
    ]
    df = spark.createDataFrame(series, "pattern_id bigint, values array<double>")
    got = {r["pattern_id"]: r for r in features.with_category(features.series_features(df)).collect()}
    assert got[1]["category"] == "periodic" and math.isclose(got[1]["dominant_frequency"], 1 / 8)
    assert abs(got[1]["spectral_entropy"]) < 1e-6
    assert got[2]["mean"] == 27.0 and got[2]["max_rate_of_change"] == 20.0 and got[2]["dominant_frequency"] is None
    assert got[3]["category"] == "gradual" and math.isclose(got[3]["trend_strength"], 1.0)
    assert got[4]["category"] == "random" and got[4]["trend_strength"] is None
    assert 5 not in got and got[6]["category"] == "spike"


def test_adaptive_fold_matches_a_plain_loop(spark):
    targets = [(k, float((k * 53) % 90)) for k in range(40)]
    df = spark.createDataFrame([("m", k, t) for k, t in targets], "name string, tick bigint, target double").withColumn(
        "tick_ts", F.lit("2024-01-01").cast("timestamp_ntz")
    )
    cfg = thresholds.config_table(spark, [("m", "adaptive", ">", 70.0, 0.3, 40.0, 60.0, None, None)])
    got = [r["threshold"] for r in thresholds.adapt_thresholds(df, cfg, ticks_per_chunk=7).orderBy("tick").collect()]
    t, want = 70.0, []
    for _, target in targets:
        t = min(max(t * 0.7 + target * 0.3, 40.0), 60.0)
        want.append(t)
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want)) and len(got) == 40


def test_time_windows_first_match_and_no_midnight_wrap(spark):
    rows = [(datetime(2024, 1, 1, h),) for h in (3, 7, 20, 23)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz").withColumn("w", F.expr(
        "array(named_struct('hours', '0-6', 'value', 85D), named_struct('hours', '6-18', 'value', 75D), named_struct('hours', '22-4', 'value', 1D))"
    ))
    got = [r[0] for r in df.select(thresholds.time_based_value(F.col("ts"), F.col("w"), F.lit(80.0))).collect()]
    assert got == [85.0, 75.0, 80.0, 80.0]


def test_sliding_percentile_is_strict_at_the_far_end(spark):
    rows = [("m", T0 + timedelta(seconds=s), float(v), 50.0) for s, v in ((0, 100), (3599, 2), (3600, 4))]
    df = spark.createDataFrame(rows, "name string, ts timestamp_ntz, value double, pct double")
    got = thresholds.trailing_percentile(df, ["name"], "pct").orderBy("ts").collect()
    assert [r["percentile_value"] for r in got] == [100.0, 51.0, 3.0]


def test_outcome_similarity_and_cosine(spark):
    row = spark.range(1).select(
        outcome_similarity(F.lit(0.0), F.lit(0.0)).alias("zero"), outcome_similarity(F.lit(50.0), F.lit(100.0)).alias("half"),
        outcome_similarity(F.lit(-10.0), F.lit(10.0)).alias("opposite"),
        cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("none"),
        clamp(F.lit(3.0), 0.0, 1.0).alias("top"),
    ).first()
    assert (row["zero"], row["half"], row["opposite"], row["none"], row["top"]) == (1.0, 0.5, 0.0, 0.0, 1.0)


def test_entry_without_similar_ones_gets_the_base_confidence(spark):
    schema = "entry_id bigint, type string, ts timestamp, vector array<double>, outcome_value double"
    new = spark.createDataFrame([(1, "t", T0, [1.0, 0.0], 10.0), (2, "t", T0, [0.0, 0.0], 10.0), (3, "u", T0, [1.0, 0.0], 10.0)], schema)
    past, later = T0 - timedelta(days=1), T0 + timedelta(days=1)
    held = [(7, "t", past, [2.0, 0.1], 5.0, 0.8), (8, "t", past, [0.0, 1.0], 5.0, 0.8)]
    # stored later, or at the same time under the same or a higher id: not looked at
    held += [(9, "t", later, [1.0, 0.0], 10.0, 1.0), (1, "t", T0, [1.0, 0.0], 10.0, 1.0), (4, "t", T0, [1.0, 0.0], 10.0, 1.0)]
    got = {r["entry_id"]: r["new_confidence"] for r in entry_confidence(new, spark.createDataFrame(held, schema + ", confidence double"), block_rows=1).collect()}
    assert math.isclose(got[1], 0.4) and got[2] == 0.5 and got[3] == 0.5


def test_merge_updates_and_inserts(spark):
    schema = "pattern_id bigint, pattern_type string, vector array<double>, tags array<string>, frequency bigint, confidence double"
    lib = spark.createDataFrame([(1, "w", [1.0, 0.0], ["a"], 1, 0.95), (2, "w", [0.0, 1.0], ["b"], 3, 0.5)], schema)
    inc = spark.createDataFrame([(10, "w", [3.0, 0.1], ["x", "a"], 1, 1.0), (11, "w", [2.0, 0.0], ["y"], 1, 1.0),
                                 (12, "r", [1.0, 0.0], ["z"], 1, 1.0), (12, "r", [1.0, 0.0], ["q"], 1, 1.0)], schema)
    got = {r["pattern_id"]: r for r in merge_into_library(lib, inc).collect()}
    assert got[1]["frequency"] == 3 and got[1]["confidence"] == 1.0 and set(got[1]["tags"]) == {"a", "x", "y"}
    assert got[2]["frequency"] == 3 and got[2]["tags"] == ["b"]
    assert got[12]["frequency"] == 2 and set(got[12]["tags"]) == {"q", "z"} and set(got) == {1, 2, 12}


def test_library_query_orders_by_frequency(spark):
    df = spark.createDataFrame([(1, "w", "spike", ["a", "b"], 0.9, 2), (2, "w", "spike", ["a"], 0.9, 9), (3, "w", "spike", ["b", "a", "c"], 0.9, 5)],
                               "pattern_id bigint, pattern_type string, category string, tags array<string>, confidence double, frequency bigint")
    assert [r[0] for r in query_library(df, tags=["a", "b"], limit=5).select("pattern_id").collect()] == [3, 1]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(T0 + timedelta(seconds=s),) for s in (0, 1, 5, 10)], "ts timestamp_ntz")
    got = temporal_histogram(df).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 1, 1] and sum(r["n"] for r in got) == 4
    assert temporal_histogram(df.limit(1)).count() == 0


def test_optimizer_sample_leaves_headroom(spark):
    row = [("a", 1.5, 2048.0, 150.0, [1.8, 2.0, 1.7, 1.9]), ("b", 3.95, 100.0, 150.0, None)]
    d = spark.createDataFrame(row, "service string, cpu_usage double, memory_usage double, response_time double, predicted array<double>")
    limits = allocate.Limits(memory_cost=0.1)
    got = {r["service"]: r for r in allocate.best_allocation(allocate.with_strategies(d, ["balanced"]), limits).collect()}
    a = got["a"]
    assert a["cpu_allocation"] >= 1.7 and a["memory_allocation"] >= 2048.2 and got["b"]["cpu_allocation"] is None

    def cost(c, m):
        over = max(0.0, 150 * max(1.5 / c, 2048 / m) - 100)
        return 0.4 * over ** 2 + 0.3 * (c + 0.1 * m) + 0.3 * (-min((c - 1.5) / c, (m - 2048) / m) + max(0.0, 2.0 - c))

    best = min(cost(0.1 + i * 0.1, 128 + j * 64) for i in range(40) for j in range(127)
               if 0.1 + i * 0.1 - 1.7 >= 0 and 128 + j * 64 - 2048.2 >= 0)
    assert math.isclose(a["cost"], best, rel_tol=1e-9)


def test_decision_sample_scales_out(spark):
    schema = ("service string, h bigint, cpu_usage double, memory_usage double, request_rate double, error_rate double, response_time double, "
              "predicted array<double>, instances bigint, allocated_cpu double, allocated_memory double, target_cpu double, target_memory double, target_confidence string")
    df = spark.createDataFrame([("a", 1, 0.8, 0.7, 100.0, 0.01, 100.0, [0.85, 0.9, 0.82, 0.88], 4, 2.0, 4096.0, 2.0, 4096.0, None)], schema)
    c = decide.candidates(df, ["service", "h"]).orderBy("position").collect()
    assert [r["action"] for r in c] == ["scale_out", "none"] and c[0]["magnitude"] == 1.0
    none = decide.score_candidates(decide.candidates(df, ["service", "h"])).filter("action = 'none'").first()
    assert math.isclose(none["score"], 0.75)  # no-action without history
    step = decide.horizontal_step(df).first()
    assert step["h_action"] == "scale_out" and math.isclose(step["factor"], 1.2) and step["h_target"] == 5


def test_rule_conditions_treat_missing_fields(spark):
    df = spark.createDataFrame([(None, "x"), (5.0, "y")], "a double, b string")
    rule = lambda op, v: {"id": op, "level": "s", "priority": "HIGH", "conditions": [{"field": "a", "operator": op, "value": v}],
                          "constraints": [{"type": "pattern", "field": "b", "pattern": "q"}]}
    errors, _ = quality.rule_findings([rule("not_equals", 5.0), rule("less_than", 9.0)], "S", F.col)
    got = [r[0] for r in df.select(errors).collect()]
    assert got == [["not_equals: Value x does not match pattern q"], ["less_than: Value y does not match pattern q"]]


def test_votes_after_expiry_and_quorum(spark):
    p = spark.createDataFrame([(1, T0), (2, T0), (3, T0)], "proposal_id bigint, expiration timestamp_ntz")
    v = [(1, "a", True, -2), (1, "b", False, -2), (1, "b", True, -1), (2, "a", False, -2), (2, "b", False, -1), (3, "a", True, -1), (3, "b", True, 1)]
    votes = spark.createDataFrame([(i, w, y, T0 + timedelta(seconds=s)) for i, w, y, s in v], "proposal_id bigint, voter string, vote boolean, ts timestamp_ntz")
    got = {r["proposal_id"]: r["state"] for r in oplog.tally(oplog.accepted_votes(votes, p), ["ts"]).collect()}
    assert got == {1: "accepted", 2: "rejected", 3: "open"}


def test_old_version_is_ignored_and_versions_go_on(spark):
    u = spark.createDataFrame([(i, "s", T0 + timedelta(days=40 * i), n, v) for i, (n, v) in enumerate([("x", 3), ("x", 2), ("me", 9), ("x", 4), ("x", 4)])],
                              "update_id bigint, state_type string, ts timestamp_ntz, node string, version bigint")
    assert sorted(r["update_id"] for r in oplog.version_gate(u, "me").collect()) == [0, 3]
    e = spark.createDataFrame([(1, "t", T0), (2, "t", T0 + timedelta(days=3))], "entry_id bigint, type string, ts timestamp_ntz")
    held = spark.createDataFrame([("t", 7)], "type string, version bigint")
    assert sorted(r["version"] for r in assign_versions(e, held).collect()) == [8, 9]


def test_validation_sample(spark):
    df = spark.sql("""SELECT named_struct('cpu_usage', 0.8D, 'memory_usage', 0.7D, 'request_rate', 100D, 'error_rate', 0.01D) AS pattern,
      named_struct('action', 'scale_out', 'magnitude', 2D, 'success', true, 'metrics', named_struct('response_time', 200D, 'throughput', 90D, 'error_rate', 0.02D)) AS outcome""")
    r = quality.validate_knowledge(df).first()
    pattern = (1 / 2.5 + 1 / (1 + 2 / 3) + 1 + 1) / 4
    outcome = (1 + 1 / 1.2 + 0.98) / 3
    assert r["is_valid"] and r["warnings"] == [] and math.isclose(r["confidence"], 0.4 + 0.3 * pattern + 0.3 * outcome)


@pytest.mark.parametrize("frame", ["grid", "quantile"])
def test_empty_input_gives_empty_output(spark, frame):
    p = points(spark, {"a": [1.0]}).filter("value > 5")
    if frame == "grid":
        assert detect.detect_patterns(p, ["a", "b"]).filter("type <> 'correlation'").count() == 0
    else:
        from metricloom.operators.aggregates import range_aggregates

        assert range_aggregates(p, ["name"]).count() == 0


def test_outcome_and_item_types(spark):
    """Nested minimums, boolean and item types of the schemas."""
    row = spark.sql("""SELECT named_struct('action', 'scale_out', 'magnitude', 2D, 'success', 'perhaps', 'metrics',
      named_struct('response_time', -1D, 'throughput', 90D, 'error_rate', -0.5D)) AS outcome, array('1', 'x', '-2') AS request_rate, 'spike' AS pattern_type""")
    found = row.select(
        quality.schema_errors(quality.SCHEMAS["scaling_outcome"], quality.fields_of("outcome")).alias("o"),
        quality.schema_errors(quality.SCHEMAS["workload_pattern"], F.col).alias("w"),
    ).first()
    assert [m.removeprefix("Schema validation error: ") for m in found.o] == [
        "'perhaps' is not of type 'boolean'", "-1.0 is less than the minimum of 0", "-0.5 is less than the minimum of 0"]
    assert [m.removeprefix("Schema validation error: ") for m in found.w] == [
        "an item of 'request_rate' is not of type 'number'", "an item of 'request_rate' is less than the minimum of 0"]


def test_baselines_and_rules_keep_every_row(spark):
    table = spark.createDataFrame([(f"f{i}", 1.0, 1.0, 0.0, 2.0) for i in range(6)], "field string, mean double, std double, min double, max double")
    assert len(quality.baselines_of(table)) == 6
    rules = spark.createDataFrame([(2, "s", '{"id": "a", "v": 2}'), (1, "s", '{"id": "a", "v": 1}'), (3, "s", '{"id": "b"}')], "position int, scope string, rule string")
    assert quality.load_rules(rules) == {"s": [{"id": "a", "v": 2}, {"id": "b"}]}


def test_pair_correlation_of_many_metrics(spark):
    """Three hundred metrics plan and run; every pair is there, gaps and constants included."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 300)) + 50
    x[:, 1], x[:, 2] = 2 * x[:, 0] - 3, 7.1
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(f"m{j:03d}", T0 + timedelta(hours=i), None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    grid = spark.createDataFrame(rows, "name string, h timestamp_ntz, filled double")
    got = {(r.metric_a, r.metric_b): r.r for r in detect.pair_correlations(grid, [f"m{j:03d}" for j in range(300)]).collect()}
    assert len(got) == 300 * 299 // 2 and got["m001", "m002"] is None and math.isclose(got["m000", "m001"], 1)
    for a, b in [(0, 5), (17, 200), (298, 299)]:
        both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        assert math.isclose(got[f"m{a:03d}", f"m{b:03d}"], np.corrcoef(x[both, a], x[both, b])[0, 1], abs_tol=1e-9)


def test_pair_correlation_by_blocks(spark):
    """Blocks of any width give the same pairs; a threshold keeps exactly those above it."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 11)) * 3 + 1e6
    x[:, 1], x[:, 2], x[:, 10] = -x[:, 0], 7.1, np.nan
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:30, 4], x[30:, 5] = np.nan, np.nan  # never known together
    rows = [(f"m{j:03d}", T0 + timedelta(hours=i), None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    grid = spark.createDataFrame(rows, "name string, h timestamp_ntz, filled double").repartition(4)
    names = [f"m{j:03d}" for j in range(11)]
    for block in (256, 4, 1):
        got = {(r.metric_a, r.metric_b): r.r for r in detect.pair_correlations(grid, names, block=block).collect()}
        assert len(got) == 55
        for i in range(11):
            for j in range(i + 1, 11):
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                if {i, j} & {2, 10} or (i, j) == (4, 5):
                    assert got[names[i], names[j]] is None
                else:
                    assert math.isclose(got[names[i], names[j]], np.corrcoef(x[both, i], x[both, j])[0, 1], abs_tol=1e-8)
        high = {(r.metric_a, r.metric_b) for r in detect.pair_correlations(grid, names, threshold=0.25, block=block).collect()}
        assert high == {k for k, r in got.items() if r is not None and abs(r) > 0.25} and (names[0], names[1]) in high
