"""Checks on stored data."""

from pyspark.sql import functions as F

from ..operators import audit, series
from .base import HOUR, query, r, text


@query("a31_schema_health", "SELECT metric, count(*) AS rows, 0 AS null_tags, 0 AS optional_dims, 9 AS columns, false AS fails FROM points WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1", "points")
def _(t):
    return audit.schema_health(t.points, F.to_timestamp(F.lit("2024-01-29 00:00:00")))


@query("a32_reconciliation", """SELECT event_type AS signal, count(*) AS received, count_if(k % 10 > 2) AS emitted, count_if(k % 10 = 0) AS no_value, count_if(k % 10 = 1) AS errors, count_if(k % 10 = 2) AS rejected, 0 AS queued
  FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def _(t):
    k = F.col("k") % 10
    route = F.when(k == 0, "no_value").when(k == 1, "error").when(k == 2, "rejected").otherwise("valid")
    return audit.reconciliation(t.events.select(F.col("event_type").alias("signal"), route.alias("route")))


@query("a33_sample_gaps", """SELECT asset_id, rnd(sum(s), 3) AS seconds, count(*) AS gaps FROM (SELECT asset_id, (epoch_us(coalesce(lead(ts) OVER (PARTITION BY asset_id ORDER BY ts), TIMESTAMP '2024-01-31')) - epoch_us(ts)) / 1000000 AS s
  FROM (SELECT DISTINCT asset_id, ts FROM points UNION ALL SELECT DISTINCT asset_id, TIMESTAMP '2024-01-01' FROM points)) WHERE s > 7200 GROUP BY 1""", "points")
def _(t):
    ts = lambda s: F.to_timestamp(F.lit(s))
    g = series.sample_gaps(t.points, ["asset_id"], ts("2024-01-01 00:00:00"), ts("2024-01-31 00:00:00"), 7200)
    return g.groupBy("asset_id").agg(r(F.sum("seconds"), 3, "seconds"), F.count(F.lit(1)).alias("gaps"))


@query("a34_retention_edges", """SELECT count_if(ts >= TIMESTAMP '2024-01-09 22:00:00' AND ts < TIMESTAMP '2024-01-09 23:00:00') AS outside, count_if(ts >= TIMESTAMP '2024-01-10 01:00:00' AND ts < TIMESTAMP '2024-01-10 02:00:00') AS inside FROM points""", "points")
def _(t):
    return audit.retention_edges(t.points, F.to_timestamp(F.lit("2024-02-09 00:00:00")), 30)


@query("a35_completeness", "SELECT asset_id, metric, count(*) AS stored, rnd(count(*) / 200.0, 4) AS completeness, count(*) / 200.0 >= 0.999 AS passes FROM points GROUP BY 1, 2", "points")
def _(t):
    return audit.completeness(t.points, ["asset_id", "metric"], 200.0).select("asset_id", "metric", "stored", r("completeness"), "passes")


@query("a36_ingest_report", "SELECT metric AS indicator, CASE WHEN metric IN ('view', 'click') THEN 'max' ELSE 'aumento' END AS how, rnd(CASE WHEN metric IN ('view', 'click') THEN max(value) ELSE max(value) - min(value) END, 4) AS value FROM points GROUP BY 1", "points")
def _(t):
    return audit.ingest_report(t.points.withColumnRenamed("metric", "indicator"), ["view", "click"]).select("indicator", "how", r("value"))


@query("a37_latency", """SELECT asset_id, count(*) AS points, rnd(quantile_cont(l, 0.5), 4) AS p50, rnd(quantile_cont(l, 0.95), 4) AS p95, rnd(max(l), 4) AS longest, quantile_cont(l, 0.95) <= 150 AS passes
  FROM (SELECT asset_id, floor(value * 1000000) / 1000000 AS l FROM points) GROUP BY 1""", "points")
def _(t):
    p = t.points.withColumn("seen_at", F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 1000000).cast("bigint")))
    return audit.latency(p, ["asset_id"], "ts", "seen_at", 150.0).select("asset_id", "points", r("p50"), r("p95"), r("longest"), "passes")


@query("a46_rollup_lag", "SELECT strftime(max(bucket), '%Y-%m-%d %H:%M:%S') AS newest, CAST(epoch(TIMESTAMP '2024-02-01') - epoch(max(bucket)) - 3600 AS BIGINT) AS lag_s FROM hours", "hours")
def _(t):
    return audit.lag(t.hours, F.to_timestamp(F.lit("2024-02-01 00:00:00")), HOUR).select(text("newest"), F.col("lag_s").cast("bigint").alias("lag_s"))


@query("a53_hosts_without_certificate", "SELECT host_name, count(*) AS requests FROM arrivals WHERE provider IS NULL GROUP BY 1", "arrivals")
def _(t):
    return audit.sender_mismatch(t.arrivals.withColumnRenamed("provider", "sender"))[1]


@query("a53_sender_mismatch", "SELECT count_if(provider <> host_name) AS mismatched FROM arrivals", "arrivals")
def _(t):
    return audit.sender_mismatch(t.arrivals.withColumnRenamed("provider", "sender"))[0]
