"""Inputs derived from the test tables.  Each definition is repeated as SQL in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.scalars import floor_time
from metricloom.operators.chunks import positions, running_total

HOUR = 3600
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def metric_points(spark: SparkSession, sf: str) -> DataFrame:
    """Long metric points: one row per event."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("point_id"),
        F.col("event_type").alias("name"),
        "ts",
        "value",
        "user_id",
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def utilization(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly utilisation: one partial aggregate over the events."""
    e = table(spark, sf, "events")

    def mean_of(kind: str):
        return F.avg(F.when(F.col("event_type") == kind, F.col("value")))

    return e.groupBy(floor_time("ts", HOUR).alias("h")).agg(
        (mean_of("click") / 100).alias("cpu"),
        (mean_of("view") / 100).alias("memory"),
        F.count("*").cast("double").alias("request_rate"),
        (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("error_rate"),
        mean_of("purchase").alias("response_time"),
    )


def user_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points with their position in the user's series."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return positions(e, ["user_id"], "ts", ["event_id"], "idx")


def user_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative counters per user."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return running_total(
        e, ["user_id"], "ts", ["event_id"],
        {"cpu_total": F.col("value"), "system_total": F.lit(1.0)},
    )


def knowledge_entries(spark: SparkSession, sf: str) -> DataFrame:
    """One entry per order with raw line features."""
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("f_quantity"),
        F.avg("l_discount").alias("f_discount"),
        F.avg("l_tax").alias("f_tax"),
        F.avg("l_extendedprice").alias("f_price"),
    )
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.col("o_orderkey").alias("entry_id"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_orderdate").alias("ts"),
        (F.col("o_orderkey") % 100 / 100.0).alias("confidence"),
        F.col("o_totalprice").alias("outcome_value"),
        "f_quantity", "f_discount", "f_tax", "f_price",
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_orderstatus").alias("state_type"),
        F.col("o_orderdate").alias("ts"),
        F.to_json(F.struct(
            F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")
        )).alias("data"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )


def operations(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("completed_at")
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "in_progress")
        .otherwise("pending")
    )
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.col("o_orderkey").alias("operation_id"),
        F.col("o_orderpriority").alias("operation_type"),
        F.col("o_custkey").alias("service"),
        F.col("o_orderdate").alias("created_at"),
        "completed_at",
        status.alias("status"),
    )


def operation_steps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("operation_id"),
        F.col("l_linenumber").cast("bigint").alias("step_id"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"),
        F.col("l_suppkey").alias("part_id"),
        F.col("l_shipdate").alias("finished_at"),
        F.col("l_quantity").alias("before"),
        F.col("l_extendedprice").alias("after"),
    )


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("proposal_id"),
        F.col("o_orderpriority").alias("proposal_type"),
        F.col("o_custkey").alias("proposer"),
        F.col("o_orderdate").alias("ts"),
        (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("expiration"),
    )


def votes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("proposal_id"),
        (F.col("l_suppkey") % 3).alias("voter"),
        (F.col("l_returnflag") != "R").alias("vote"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_suppkey").alias("tie1"),
        F.col("l_linenumber").cast("bigint").alias("tie2"),
        F.col("l_extendedprice").alias("tie3"),
    )
