"""Append-only event log in parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "id long, task_id string, ts double, type string, exp_id string, payload string"


def append_events(events: DataFrame, path: str) -> None:
    """Append events; files are laid out by type so that type filters prune folders."""
    events.write.mode("append").partitionBy("type").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def query_events(events: DataFrame, task_id: str | None = None, type: str | None = None, exp_id: str | None = None, after_id: int | None = None) -> DataFrame:
    """Filtered events in id order."""
    out = events
    for column, value in (("task_id", task_id), ("type", type), ("exp_id", exp_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if after_id is not None:
        out = out.where(F.col("id") > after_id)
    return out.orderBy("id")
