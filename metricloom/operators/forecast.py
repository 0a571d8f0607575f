"""Workload forecasts and their combination."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.operators.models import fit_forest, side_by_side, with_tree_spread
from metricloom.operators.windows import sliding_sequences
from metricloom.session import cut_lineage

# Forecast defaults.
LINEAR_CONFIDENCE = 0.7
MIN_TRAINING_ROWS = 100
ACCURACY_HISTORY = 1000
SEQUENCE = 24
FOREST_TREES, FOREST_DEPTH, FOREST_SEED = 100, 10, 42
ERROR_FLOOR = 1e-9


def _future(fitted: DataFrame, steps: int, step_seconds: int) -> DataFrame:
    """One row per future step after each metric's last bucket."""
    out = fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    ahead = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("step") * F.lit(float(step_seconds)))
    return out.withColumn("ts", F.col("last_h") + ahead)


def linear_forecast(grid: DataFrame, horizon_seconds: int, step_seconds: int) -> DataFrame:
    """Straight line through each metric's grid, continued over the horizon."""
    fitted = grid.groupBy("name").agg(
        F.regr_slope("filled", F.col("i").cast("double")).alias("slope"),
        F.regr_intercept("filled", F.col("i").cast("double")).alias("base"),
        F.max("i").alias("last_i"), F.max("h").alias("last_h"),
    )
    value = F.col("base") + F.col("slope") * (F.col("last_i") + F.col("step"))
    return _future(fitted, horizon_seconds // step_seconds, step_seconds).select(
        "name", "ts", value.alias("value"), F.lit(LINEAR_CONFIDENCE).alias("confidence"), F.lit("linear").alias("model")
    )


def frame_forecast(
    frame: DataFrame, target: str, features: Sequence[str], horizon_seconds: int, step_seconds: int, index: str = "h"
) -> DataFrame:
    """Least squares of one metric on others over an aligned frame, its last row continued.

    ``frame`` has one row per ``index`` and a column per metric.  The normal equations
    are covariances of pairs of columns, which merge from partial aggregates; one row
    of them is solved, whatever the length of the frame.  Rows with a missing value are
    left out of the fit.  A constant column has no weight, and of columns that depend on
    each other the solution with the smallest weights (of scaled columns) is taken; the
    target among its own features therefore repeats its last value.  Without a row to
    fit, or with a missing value in the last row, the forecast is null.
    """
    columns = list(dict.fromkeys([target, *features]))
    at = {c: i for i, c in enumerate(columns)}
    whole = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])
    known = [F.when(whole, F.col(f"`{c}`").cast("double")) for c in columns]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = frame.agg(
        F.array(*[F.avg(c) for c in known]).alias("means"), F.array(*[F.covar_pop(known[i], known[j]) for i, j in pairs]).alias("products"),
        F.max_by(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]), index).alias("last"), F.max(index).alias("last_h"),
    )
    used = [at[c] for c in dict.fromkeys(features)]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            values = []
            for means, products, last in zip(pdf["means"], pdf["products"], pdf["last"]):
                if last is None or any(x is None or np.isnan(x) for x in [*means, *last]):
                    values.append(None)
                    continue
                cov = np.zeros((len(columns), len(columns)))
                for (i, j), x in zip(pairs, products):
                    cov[i, j] = cov[j, i] = x
                scale = np.sqrt(np.diag(cov))[used]
                scale[scale <= 1e-12 * np.abs(np.asarray(means, float)[used])] = 0.0
                inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
                gram = cov[np.ix_(used, used)] * np.outer(inverse, inverse)
                weights = np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ (cov[used, 0] * inverse) * inverse
                values.append(float(means[0] + weights @ (np.asarray(last, float) - np.asarray(means, float))[used]))
            yield pd.DataFrame({"last_h": pdf["last_h"], "value": pd.array(values, dtype="Float64")})

    fitted = sums.filter("last_h is not null").mapInPandas(solve, f"last_h {frame.schema[index].dataType.simpleString()}, value double")
    return _future(fitted, horizon_seconds // step_seconds, step_seconds).select(
        F.lit(target).alias("name"), "ts", "value", F.lit(LINEAR_CONFIDENCE).alias("confidence"), F.lit("linear_frame").alias("model")
    )


def seasonal_forecast(grid: DataFrame, horizon_seconds: int, step_seconds: int) -> DataFrame:
    """Line plus mean residual by hour of day, then by weekday; confidence is a quarter of the 95% width.

    The first forecast row is the last known bucket itself (step 0 is the fit's
    end); seasonal parts are aggregates of at most 24 and 7 rows per metric.
    """
    line = grid.groupBy("name").agg(
        F.regr_slope("filled", F.col("i").cast("double")).alias("slope"),
        F.regr_intercept("filled", F.col("i").cast("double")).alias("base"),
        F.max("i").alias("last_i"), F.max("h").alias("last_h"),
    )
    fit = F.col("base") + F.col("slope") * F.col("i")
    detrended = grid.join(line, "name").withColumns({
        "r": F.col("filled") - fit, "hour": F.hour("h"), "day": F.dayofweek("h"),
    })
    daily = detrended.groupBy("name", "hour").agg(F.avg("r").alias("daily"))
    left = detrended.join(daily, ["name", "hour"]).withColumn("r2", F.col("r") - F.col("daily"))
    weekly = left.groupBy("name", "day").agg(F.avg("r2").alias("weekly"))
    noise = left.join(weekly, ["name", "day"]).groupBy("name").agg(
        F.stddev_pop(F.col("r2") - F.col("weekly")).alias("sigma")
    )
    future = _future(line, horizon_seconds // step_seconds, step_seconds).withColumns(
        {"hour": F.hour("ts"), "day": F.dayofweek("ts")}
    )
    value = (
        F.col("base") + F.col("slope") * (F.col("last_i") + F.col("step"))
        + F.coalesce("daily", F.lit(0.0)) + F.coalesce("weekly", F.lit(0.0))
    )
    return (
        future.join(daily, ["name", "hour"], "left").join(weekly, ["name", "day"], "left").join(noise, "name")
        .select("name", "ts", value.alias("value"), (2 * 1.96 * F.col("sigma") / 4).alias("confidence"),
                F.lit("seasonal").alias("model"))
    )


def supervised_frame(
    grid: DataFrame, length: int = SEQUENCE, min_rows: int = MIN_TRAINING_ROWS
) -> DataFrame:
    """Features (first length - 1 values) and target (last value) of every window.

    Metrics with fewer than ``min_rows`` grid rows give nothing.
    """
    enough = grid.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows).select("name")
    windows = sliding_sequences(grid.join(enough, "name", "left_semi"), length)
    return windows.select(
        "name", "h", "i", F.slice("sequence", 1, length - 1).alias("features"), F.element_at("sequence", -1).alias("target")
    )


def forest_forecast(
    grid: DataFrame, horizon_seconds: int, step_seconds: int, lags: int = 6,
    trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, seed: int = FOREST_SEED,
) -> DataFrame:
    """Random-forest forecast of one metric from its lags and hour of day.

    The future repeats the last known lags.  Confidence is the deviation across
    trees: as in the weighted ensemble, a larger spread counts as a larger weight.
    """
    frame = supervised_frame(grid, lags + 1)
    inputs = [f"x{j}" for j in range(lags)] + ["hour"]
    as_columns = [F.element_at("features", j + 1).alias(f"x{j}") for j in range(lags)]
    assembler = VectorAssembler(inputCols=inputs, outputCol="x")
    # the fit reads its input several times: written once, it is not recomputed
    train = assembler.transform(cut_lineage(
        frame.select(*as_columns, F.hour("h").cast("double").alias("hour"), "target")
    ))
    model = fit_forest(train, RandomForestRegressor(featuresCol="x", labelCol="target", numTrees=trees, maxDepth=depth, seed=seed), train.count())
    newest = Window.partitionBy("name").orderBy(F.col("i").desc())
    last = (
        grid.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= lags)
        .groupBy("name").agg(
            F.sort_array(F.collect_list(F.struct("i", "filled"))).alias("s"), F.max("h").alias("last_h")
        )
        .select("name", "last_h", F.col("s.filled").alias("features"))
    )
    future = _future(last, horizon_seconds // step_seconds, step_seconds)
    rows = assembler.transform(future.select("name", "ts", *as_columns, F.hour("ts").cast("double").alias("hour")))
    rows = with_tree_spread(rows, model)
    return rows.select(
        "name", "ts", F.col("tree_mean").alias("value"), F.col("tree_deviation").alias("confidence"),
        F.lit("random_forest").alias("model"),
    )


def forest_forecasts(grid: DataFrame, names: Sequence[str], horizon_seconds: int, step_seconds: int, **how) -> DataFrame:
    """A forest per metric of the configured ``names``; a metric with too few rows
    for training gives nothing."""
    enough = grid.filter(F.col("name").isin(list(names))).groupBy("name").count().filter(F.col("count") >= MIN_TRAINING_ROWS)
    found = {r["name"] for r in enough.collect()}
    parts = side_by_side(grid.sparkSession, [
        partial(forest_forecast, grid.filter(F.col("name") == n), horizon_seconds, step_seconds, **how) for n in names if n in found
    ])
    if parts:
        return reduce(DataFrame.unionByName, parts)
    return grid.select("name", F.col("h").alias("ts"), *[F.lit(None).cast("double").alias(c) for c in ("value", "confidence")], F.lit("random_forest").alias("model")).filter(F.lit(False))


def prediction_errors(predictions: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute error of each prediction whose actual value is known."""
    known = actual.select(*keys, F.col("value").alias("actual"))
    return predictions.join(known, keys).withColumn("error", F.abs(F.col("value") - F.col("actual")))


def model_weights(errors: DataFrame, models: DataFrame, order: list[Column], last: int = ACCURACY_HISTORY) -> DataFrame:
    """Weight per model: (1 / MAE) / sum(1 / MAE) over the newest records; 0 without history.

    A mean error of zero counts as 1e-9, so a perfect model takes all the weight.
    """
    newest = errors.orderBy(*order).limit(last)
    mae = newest.groupBy("model").agg(F.avg("error").alias("mae"))
    inverse = F.when(F.col("mae").isNull(), F.lit(0.0)).otherwise(1 / F.greatest("mae", F.lit(ERROR_FLOOR)))
    joined = models.join(mae, "model", "left").withColumn("inverse", inverse)
    total = joined.agg(F.sum("inverse")).scalar()
    return joined.select("model", "mae", F.coalesce(F.try_divide("inverse", total), F.lit(0.0)).alias("weight"))


def ensemble(predictions: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean per key, weight = model weight x confidence; plain mean confidence."""
    w = F.col("weight") * F.col("confidence")
    return (
        predictions.join(weights.select("model", "weight"), "model")
        .groupBy(*keys)
        .agg(
            F.try_divide(F.sum(F.col("value") * w), F.sum(w)).alias("value"),
            F.avg("confidence").alias("confidence"), F.sum(w).alias("_w"),
        )
        .filter(F.col("_w") > 0).drop("_w")
    )
