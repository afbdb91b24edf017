"""Adapters from the driver's tables to the load-with-weather schema.

``events(event_id, ts, user_id, event_type, value, props)`` is bucketed into a
regular series (one row per non-empty bucket):

datetime = bucket start, load = round(sum(value), 2), temp = round(avg(value), 6),
dwpt = min(value), rhum = max(value), wspd = count(*), pres = round(avg(user_id), 6),
wdir = max(event_id % 360) over click events (null when the bucket has none),
plus the raw calendar columns year, month, day, hour, minute of the bucket.

Partial aggregation runs map-side, so a bucket holding a large share of all
events never lands in one task unaggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

RAW_COLUMNS = ["datetime", "load", "temp", "dwpt", "rhum", "wspd", "pres", "wdir",
               "year", "month", "day", "hour", "minute"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_series(events: DataFrame, minutes: int, series_keys: Sequence[str] = ()) -> DataFrame:
    bucket = F.window("ts", f"{minutes} minutes").start.alias("datetime")
    v = F.col("value")
    agg = (events.groupBy(*series_keys, bucket)
           .agg(F.round(F.sum(v), 2).alias("load"),
                F.round(F.avg(v), 6).alias("temp"),
                F.min(v).alias("dwpt"),
                F.max(v).alias("rhum"),
                F.count(F.lit(1)).cast("double").alias("wspd"),
                F.round(F.avg("user_id"), 6).alias("pres"),
                F.max(F.when(F.col("event_type") == "click", F.col("event_id") % 360))
                .cast("double").alias("wdir")))
    ts = F.col("datetime")
    return agg.select(*series_keys, "datetime", "load", "temp", "dwpt", "rhum", "wspd", "pres", "wdir",
                      F.year(ts).alias("year"), F.month(ts).alias("month"),
                      F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"),
                      F.minute(ts).alias("minute"))


def load_hourly(spark: SparkSession, sf_dir: str, series_keys: Sequence[str] = ()) -> DataFrame:
    return load_series(table(spark, sf_dir, "events"), 60, series_keys)


def load_5min(spark: SparkSession, sf_dir: str, series_keys: Sequence[str] = ()) -> DataFrame:
    return load_series(table(spark, sf_dir, "events"), 5, series_keys)


def hourly_type_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly ``avg(value)`` per event type, one column per type (missing types give nulls)."""
    ev = table(spark, sf_dir, "events")
    bucket = F.window("ts", "60 minutes").start.alias("datetime")
    return (ev.groupBy(bucket).pivot("event_type", EVENT_TYPES).agg(F.round(F.avg("value"), 6)))
