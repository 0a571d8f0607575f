"""One operation of a million steps: its texts and states are rows of bounded size."""

from pyspark.sql import functions as F

from metricloom.operators import oplog
from metricloom.session import cut_lineage

N = 1_000_000


def test_a_million_steps_of_one_operation(spark):
    # step numbers come back in another order than they are stored in
    number = (F.col("id") * 7919) % N
    steps = cut_lineage(spark.range(N).select(
        F.lit(1).cast("long").alias("operation_id"), number.alias("step_id"), F.when(number % 4 == 0, "failed").otherwise("completed").alias("status"),
        F.concat(F.lit("e"), number.cast("string")).alias("error"), number.cast("double").alias("before"), (number + 1).cast("double").alias("after"),
    ).repartition(4))
    parts = oplog.rollback_error_parts(steps, ["step_id"], rows=20_000).orderBy("part").collect()
    assert len(parts) == N // 4 // 1000 and [p.part for p in parts] == list(range(len(parts)))
    lines = "\n".join(p.error for p in parts).split("\n")
    assert lines == [f"Step {k} failed: e{k}" for k in range(0, N, 4)]
    assert [tuple(r) for r in oplog.rollback_status(steps).collect()] == [(1, "failed", N // 4)]
    states = oplog.state_snapshot_rows(steps.unionByName(steps.withColumn("after", F.col("after") + 1)), ["after"])
    assert states.count() == N and states.filter(F.col("after") != F.col("before") + 2).count() == 0


def test_parts_make_up_the_whole_text(spark):
    rows = [(1, 2, "failed", "b", 0.0, 0.0), (1, 1, "failed", "a", 0.0, 0.0), (1, 3, "completed", None, 0.0, 0.0), (2, 1, "completed", None, 0.0, 0.0), (3, 5, None, None, 0.0, 0.0)]
    steps = spark.createDataFrame(rows, "operation_id long, step_id long, status string, error string, before double, after double")
    parts = {(r.operation_id, r.part): r.error for r in oplog.rollback_error_parts(steps, ["step_id"], size=1).collect()}
    assert parts == {(1, 0): "Step 1 failed: a", (1, 1): "Step 2 failed: b"}
    assert {tuple(r) for r in oplog.rollback_status(steps).collect()} == {(1, "failed", 2), (2, "completed", 0), (3, "failed", 0)}
    whole = {r.operation_id: r.error for r in oplog.rollback_outcome(steps, ["step_id"]).collect()}
    assert whole[1] == "\n".join(parts[1, k] for k in (0, 1))
