"""Checks on stored data: schema health, reconciliation, retention, completeness, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TAGS
from .quantiles import exact_percentile

COLUMN_LIMIT = 250  # warn at 80 % of it


def schema_health(points: DataFrame, since: Column) -> DataFrame:
    """Per metric: rows, nulls in tags (fail), dimensions that some rows lack (warn), column count."""
    p = points.where(F.col("ts") >= since)
    g = p.groupBy("metric").agg(F.count(F.lit(1)).alias("rows"),
                                sum((F.count_if(F.col(t).isNull() | (F.col(t) == "")) for t in TAGS), F.lit(0)).alias("null_tags"))
    own = p.select("metric", F.explode(F.map_keys("dims")).alias("dim")).groupBy("metric", "dim").agg(F.count(F.lit(1)).alias("n"))
    d = own.join(g.select("metric", "rows"), "metric").groupBy("metric").agg(
        F.count(F.lit(1)).alias("dims"), F.count_if(F.col("n") < F.col("rows")).alias("optional_dims"))
    cols = F.coalesce("dims", F.lit(0)) + len(TAGS) + 2
    return g.join(d, "metric", "left").select(
        "metric", "rows", "null_tags", F.coalesce("optional_dims", F.lit(0)).alias("optional_dims"), cols.alias("columns"),
        ((F.col("null_tags") > 0) | (cols > COLUMN_LIMIT * 0.8)).alias("fails"))


def reconciliation(routed: DataFrame, signal: str = "signal", route: str = "route") -> DataFrame:
    """received = emitted + no value + errors + rejected + queued, per signal."""
    n = lambda v: F.count_if(F.col(route) == v)
    return routed.groupBy(signal).agg(F.count(F.lit(1)).alias("received"), n("valid").alias("emitted"), n("no_value").alias("no_value"),
                                      n("error").alias("errors"), n("rejected").alias("rejected")).withColumn(
        "queued", F.col("received") - F.col("emitted") - F.col("no_value") - F.col("errors") - F.col("rejected"))


def sender_mismatch(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks whose certificate name is not their host, and hosts that sent none."""
    odd = blocks.agg(F.count_if(F.col("sender") != F.col("host_name")).alias("mismatched"))
    return odd, blocks.where("sender is null").groupBy("host_name").agg(F.count(F.lit(1)).alias("requests"))


def retention_edges(points: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """Rows in the hour just outside and just inside the window."""
    edge = as_of - F.expr(f"interval {days} days")
    hour = lambda a, z: F.count_if((F.col(ts) >= edge + F.expr(f"interval {a} hours")) & (F.col(ts) < edge + F.expr(f"interval {z} hours")))
    near = points.where(F.col(ts).between(edge - F.expr("interval 2 hours"), edge + F.expr("interval 2 hours")))
    return near.agg(hour(-2, -1).alias("outside"), hour(1, 2).alias("inside"))


def completeness(rows: DataFrame, keys: list[str], expected: Column | float, pass_at: float = 0.999) -> DataFrame:
    """A35."""
    e = expected if isinstance(expected, Column) else F.lit(float(expected))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("stored")).withColumn("completeness", F.col("stored") / e).withColumn(
        "passes", F.col("completeness") >= pass_at)


def ingest_report(internal: DataFrame, gauges: list[str], name: str = "indicator", value: str = "value") -> DataFrame:
    """Highest level of gauges, growth of counters."""
    g = internal.groupBy(name).agg(F.max(value).alias("_x"), F.min(value).alias("_n"))
    is_g = F.col(name).isin(*gauges)
    return g.select(name, F.when(is_g, "max").otherwise("aumento").alias("how"), F.when(is_g, F.col("_x")).otherwise(F.col("_x") - F.col("_n")).alias("value"))


def latency(seen: DataFrame, keys: list[str], emitted: str, seen_at: str, limit_s: float = 30.0) -> DataFrame:
    """First seen minus emitted; p50, p95 and max, exact, with the interpolation of the reference."""
    first = seen.groupBy(*keys, emitted).agg(F.min(seen_at).alias("_s")).withColumn(
        "latency", (F.unix_micros("_s") - F.unix_micros(F.col(emitted))) / 1000000)
    p50, p95 = (exact_percentile(first, keys, "latency", p, n) for p, n in ((0.5, "p50"), (0.95, "p95")))
    top = first.groupBy(*keys).agg(F.count("latency").alias("points"), F.max("latency").alias("longest"))
    return top.join(p50, keys).join(p95, keys).withColumn("passes", F.col("p95") <= limit_s)


def lag(level: DataFrame, as_of: Column, step: int) -> DataFrame:
    """Seconds between now and the end of the newest summary bucket."""
    return level.agg(F.max("bucket").alias("newest")).select(
        "newest", (F.unix_seconds(as_of) - F.unix_seconds("newest") - step).alias("lag_s"))
