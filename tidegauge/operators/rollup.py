"""Minute and hour summaries and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import dims_text
from ..functions.times import bucket
from ..schema import TAGS

SERIES = ["metric", *TAGS, "dims_key"]


def with_series(points: DataFrame) -> DataFrame:
    """Adds ``dims_key``, the text form of the dimension map, which can be a key."""
    return points if "dims_key" in points.columns else points.withColumn("dims_key", dims_text(F.col("dims")))


def summarise(points: DataFrame, seconds: int, keys: list[str] | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Level 1 (A2): mean, min, max and count of every full series per bucket.

    Partial aggregation runs before the shuffle, so a hot series leaves each
    task as one row per bucket.
    """
    keys = keys or SERIES
    df = with_series(points) if "dims_key" in keys else points
    return df.groupBy(*keys, bucket(F.col(ts), seconds).alias("bucket")).agg(
        F.avg(value).alias("value_avg"), F.min(value).alias("value_min"), F.max(value).alias("value_max"),
        F.count(value).cast("double").alias("value_count"))


def weighted_mean() -> Column:
    return F.sum(F.col("value_avg") * F.col("value_count")) / F.sum("value_count")


def summarise_again(level: DataFrame, seconds: int, keys: list[str] | None = None) -> DataFrame:
    """Level 2 (A3): from a finer summary, exact against the raw mean."""
    return level.groupBy(*(keys or SERIES), bucket(F.col("bucket"), seconds).alias("bucket")).agg(
        weighted_mean().alias("value_avg"), F.min("value_min").alias("value_min"),
        F.max("value_max").alias("value_max"), F.sum("value_count").alias("value_count"))


def two_level_mean(points: DataFrame, seconds: int, series: list[str], over: list[str], ts: str = "ts", value: str = "value",
                   name: str = "value") -> DataFrame:
    """Mean per series and bucket, then the plain mean across series.

    Not a flat mean: a series with more samples does not weigh more.
    """
    per = points.groupBy(*series, bucket(F.col(ts), seconds).alias("bucket")).agg(F.avg(value).alias("_m"))
    return per.groupBy(*over, "bucket").agg(F.avg("_m").alias(name))


def hourly_use(hours: DataFrame) -> DataFrame:
    """Busy fraction per asset and hour, CPU = 1 - idle, memory = used, count-weighted.

    ``hours`` is the hour summary with the dimension map in ``dims``.
    """
    state = F.col("dims")["state"]
    kind = (F.when((F.col("metric") == "system_cpu_utilization") & (state == "idle"), "cpu")
            .when((F.col("metric") == "system_memory_utilization") & (state == "used"), "memoria"))
    v = weighted_mean()
    return (hours.withColumn("kind", kind).where("kind is not null")
            .groupBy("asset_id", "kind", "bucket").agg(v.alias("v"))
            .select("asset_id", "kind", "bucket",
                    F.bround(F.when(F.col("kind") == "cpu", 1 - F.col("v")).otherwise(F.col("v")), 4).alias("busy")))


def recent_busy(points: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """A10: 1 - mean idle over the last minutes, 4 decimals."""
    w = points.where((F.col("metric") == "system_cpu_utilization") & (F.col("dims")["state"] == "idle")
                     & (F.col("ts") >= as_of - F.expr(f"interval {minutes} minutes")))
    return w.groupBy("asset_id").agg(F.bround(1 - F.avg("value"), 4).alias("cpu_busy"))


def resampled(df: DataFrame, key: str, ts: str, seconds: int, columns: list[str], spine: bool = False) -> DataFrame:
    """Mean per bucket; with ``spine`` the empty buckets between a key's ends come as null rows.

    The spine is built per (key, day) from the range of the key, so no task
    holds a long sequence.
    """
    m = df.groupBy(key, bucket(F.col(ts), seconds).alias(ts)).agg(*[F.avg(c).alias(c) for c in columns])
    if not spine:
        return m
    ends = m.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    days = ends.select(key, "_a", "_z", F.explode(F.sequence(
        F.date_trunc("day", "_a"), F.date_trunc("day", "_z"), F.expr("interval 1 day"))).alias("_d"))
    step = F.expr(f"interval {seconds} seconds")
    grid = days.select(key, F.explode(F.sequence(
        F.greatest("_a", "_d"), F.least(F.col("_z"), F.col("_d") + F.expr("interval 1 day") - step), step)).alias(ts))
    return grid.join(m, [key, ts], "left")
