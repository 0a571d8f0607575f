"""Relational and document access, JSON responses, bulk and topic writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE_SCHEMA = (
    "status string, data struct<result: array<struct<"
    "metric: map<string,string>, values: array<array<string>>>>>"
)


def flatten_range_response(documents: DataFrame, body: str = "body") -> DataFrame:
    """Range-query JSON ``data.result[].values[[ts, value]]`` to (ts, value, labels) rows."""
    series = documents.select(
        F.explode(F.from_json(body, RESPONSE_SCHEMA)["data"]["result"]).alias("s")
    )
    return series.select(F.col("s.metric").alias("labels"), F.explode("s.values").alias("v")).select(
        F.timestamp_micros(F.round(F.col("v")[0].cast("double") * 1_000_000).cast("bigint"))
        .cast("timestamp_ntz").alias("ts"),
        F.col("v")[1].cast("double").alias("value"),
        "labels",
    )


def run_sql(spark: SparkSession, text: str, args: Mapping[str, Any], **tables: DataFrame) -> DataFrame:
    """Parameterised SQL over the given tables; ``:name`` marks a parameter."""
    return spark.sql(text, args=dict(args), **tables)


def find(collection: DataFrame, equals: Mapping[str, Any]) -> DataFrame:
    """Document find: rows whose (dotted) fields equal the given values."""
    for field, value in equals.items():
        collection = collection.filter(F.col(field) == F.lit(value))
    return collection


_ACCUMULATORS = {
    "$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max,
}


def aggregate_pipeline(collection: DataFrame, stages: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Match, group, sort and limit stages as DataFrame steps.

    ``{"$group": {"_id": "$type", "n": {"$sum": 1}, "mean": {"$avg": "$value"}}}``
    """
    def ref(x: Any):
        return F.col(x[1:]) if isinstance(x, str) and x.startswith("$") else F.lit(x)

    for stage in stages:
        (kind, spec), = stage.items()
        if kind == "$match":
            collection = find(collection, spec)
        elif kind == "$group":
            outputs = [
                _ACCUMULATORS[op](ref(arg)).alias(name)
                for name, acc in spec.items() if name != "_id"
                for op, arg in acc.items()
            ]
            collection = collection.groupBy(ref(spec["_id"]).alias("_id")).agg(*outputs)
        elif kind == "$sort":
            collection = collection.orderBy(*[
                F.col(c).asc() if d > 0 else F.col(c).desc() for c, d in spec.items()
            ])
        elif kind == "$limit":
            collection = collection.limit(spec)
        else:
            raise ValueError(f"unsupported stage {kind}")
    return collection


def read_table(spark: SparkSession, location: str, jdbc: Mapping[str, str] | None = None) -> DataFrame:
    """A relational table by JDBC, or its parquet stand-in when no driver is set."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=location, **jdbc).load()
    return spark.read.parquet(location)


def write_table(
    df: DataFrame, location: str, jdbc: Mapping[str, str] | None = None,
    mode: str = "append", batch_size: int = 1000,
) -> None:
    """Bulk insert; ``batch_size`` rows per JDBC batch."""
    if jdbc:
        df.write.format("jdbc").options(dbtable=location, batchsize=str(batch_size), **jdbc).mode(mode).save()
    else:
        df.write.mode(mode).parquet(location)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_messages(events: DataFrame, topic: str, message_type: str) -> DataFrame:
    """Rows as JSON messages of one topic: (key, value, topic)."""
    fields = [F.col(c) for c in events.columns]
    return events.select(
        F.lit(topic).alias("topic"),
        F.to_json(F.struct(F.lit(message_type).alias("type"), *fields)).alias("value"),
    )
