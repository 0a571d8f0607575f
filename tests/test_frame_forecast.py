"""Least squares over a frame of metrics against the library's solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import forecast

STEP = 60


def frame(spark, columns):
    n = len(next(iter(columns.values())))
    rows = [(i, *[None if c[i] is None else float(c[i]) for c in columns.values()]) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"`{c}` double" for c in columns))
    return df.withColumn("h", F.timestamp_seconds(F.col("i") * STEP).cast("timestamp_ntz")).drop("i").repartition(3)


def values(df, target, features, steps=3):
    rows = forecast.frame_forecast(df, target, features, steps * STEP, STEP).orderBy("ts").collect()
    assert len({r.value for r in rows}) <= 1 and all(r.confidence == 0.7 for r in rows)
    return [r.value for r in rows]


def test_fit_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5000, 3, (200, 4)) * [1, 1e-6, 1e6, 1]
    y = x @ [0.3, 2e5, 1e-6, -1.5] + rng.normal(0, 1, 200)
    columns = {f"m {k}": x[:, k] for k in range(4)} | {"y": y}
    got = values(frame(spark, columns), "y", [f"m {k}" for k in range(4)])
    centred = x - x.mean(0)
    weights = np.linalg.lstsq(centred / centred.std(0), y - y.mean(), rcond=None)[0]
    assert len(got) == 3 and got[0] == pytest.approx(y.mean() + (centred[-1] / centred.std(0)) @ weights, rel=1e-9)


def test_constant_dependent_and_own_columns(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=50)
    y = 3 * a + 1 + rng.normal(0, 0.1, 50)
    df = frame(spark, {"a": a, "twice": 2 * a, "flat": np.full(50, 7.3), "y": y})
    alone = values(df, "y", ["a"])[0]
    assert values(df, "y", ["a", "flat"])[0] == pytest.approx(alone) and values(df, "y", ["a", "twice", "flat"])[0] == pytest.approx(alone)
    assert values(df, "y", ["flat"])[0] == pytest.approx(y.mean())
    assert values(df, "y", ["a", "y"])[0] == pytest.approx(y[-1])  # the target among its features repeats itself


def test_missing_values(spark):
    a, y = [None, 1.0, 2.0, 3.0, 5.0], [9.0, 2.0, 4.0, None, 10.0]
    assert values(frame(spark, {"a": a, "y": y}), "y", ["a"])[0] == pytest.approx(10.0)
    assert values(frame(spark, {"a": [*a[:4], None], "y": y}), "y", ["a"]) == [None] * 3
    assert values(frame(spark, {"a": a, "y": y}).limit(0), "y", ["a"]) == []
