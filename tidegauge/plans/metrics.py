"""Roll-ups and series."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions.times import as_lit
from ..operators import rollup, series
from .base import DAY, HOUR, query, r, text

_KEYS = "metric, asset_id, host_name, service_name, slot"
_TEXT = "strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket"
T0, T1 = datetime(2024, 1, 3, tzinfo=timezone.utc), datetime(2024, 1, 28, tzinfo=timezone.utc)
LONG = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 3, 2, tzinfo=timezone.utc)
A, Z = "TIMESTAMP '2024-01-03'", "TIMESTAMP '2024-01-28'"


def _level(df):
    return df.withColumn("slot", F.get_json_object("dims_key", "$.slot"))


@query("flagship_rollup_completeness", f"""SELECT metric, asset_id, strftime(date_trunc('day', bucket), '%Y-%m-%d %H:%M:%S') AS day, rnd(sum(value_avg * value_count) / sum(value_count), 4) AS value,
  min(value_min) AS low, max(value_max) AS high, sum(value_count) AS samples, count(DISTINCT bucket) AS hours, 24 - count(DISTINCT bucket) AS empty_hours,
  count(DISTINCT CASE WHEN value_count < 2 THEN bucket END) AS incomplete_hours FROM hours GROUP BY metric, asset_id, date_trunc('day', bucket)""", "hours")
def _(t):
    lvl = t.hours
    day = F.date_trunc("day", "bucket")
    hour = lvl.groupBy("metric", "asset_id", day.alias("day"), "bucket").agg(
        F.sum(F.col("value_avg") * F.col("value_count")).alias("s"), F.sum("value_count").alias("n"), F.min("value_min").alias("lo"), F.max("value_max").alias("hi"),
        F.min("value_count").alias("least"))
    return hour.groupBy("metric", "asset_id", text("day")).agg(
        r(F.sum("s") / F.sum("n"), 4, "value"), F.min("lo").alias("low"), F.max("hi").alias("high"), F.sum("n").alias("samples"), F.count(F.lit(1)).alias("hours"),
        (24 - F.count(F.lit(1))).alias("empty_hours"), F.count_if(F.col("least") < 2).alias("incomplete_hours"))


@query("a01_raw_bins", """SELECT asset_id, metric, slot AS grp, strftime(to_timestamp(epoch_us(ts) // 1000000 // 600 * 600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS bucket, rnd(avg(value), 4) AS value
  FROM points GROUP BY 1, 2, 3, 4""", "points")
def _(t):
    return series.binned(t.points, 600, ["asset_id", "metric"], F.col("dims")["slot"]).select("asset_id", "metric", F.col("group").alias("grp"), text("bucket"), r("value"))


@query("a02_fine_summaries", f"SELECT {_KEYS}, {_TEXT}, rnd(value_avg, 4) AS value_avg, value_min, value_max, value_count FROM hours", "hours")
def _(t):
    return _level(t.hours).select("metric", "asset_id", "host_name", "service_name", "slot", text("bucket"), r("value_avg"), "value_min", "value_max", "value_count")


@query("a03_coarse_summaries", f"""SELECT {_KEYS}, strftime(date_trunc('day', bucket), '%Y-%m-%d %H:%M:%S') AS bucket, rnd(sum(value_avg * value_count) / sum(value_count), 4) AS value_avg,
  min(value_min) AS value_min, max(value_max) AS value_max, sum(value_count) AS value_count FROM hours GROUP BY {_KEYS}, date_trunc('day', bucket)""", "hours")
def _(t):
    return _level(rollup.summarise_again(t.hours, DAY)).select(
        "metric", "asset_id", "host_name", "service_name", "slot", text("bucket"), r("value_avg"), "value_min", "value_max", "value_count")


@query("a04_rebucketed", """SELECT metric, asset_id, slot AS grp, strftime(to_timestamp(epoch_us(bucket) // 1000000 // 21600 * 21600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS bucket,
  rnd(sum(value_avg * value_count) / sum(value_count), 4) AS value, min(value_count) AS least, min(value_count) < 2 AS incomplete FROM hours GROUP BY 1, 2, 3, 4""", "hours")
def _(t):
    return series.rebucketed(t.hours, 21600, ["metric", "asset_id"], 2, F.get_json_object("dims_key", "$.slot")).select(
        "metric", "asset_id", F.col("group").alias("grp"), text("bucket"), r("value"), "least", "incomplete")


@query("a05_empty_intervals", f"""SELECT asset_id, metric, CAST(sum(CASE WHEN d > 7200 THEN d // 3600 - 1 ELSE 0 END) AS BIGINT) AS empty, CAST(count(*) - 1 AS BIGINT) AS with_data FROM (
  SELECT asset_id, metric, CAST(epoch(bucket) AS BIGINT) - CAST(epoch(lag(bucket, 1, {A} - INTERVAL 1 HOUR) OVER (PARTITION BY asset_id, metric ORDER BY bucket)) AS BIGINT) AS d FROM (
    SELECT DISTINCT asset_id, metric, bucket FROM hourly WHERE bucket >= {A} AND bucket < {Z} UNION ALL SELECT DISTINCT asset_id, metric, {Z} FROM hourly)) GROUP BY 1, 2""", "hourly")
def _(t):
    return series.empty_intervals(t.hourly, ["asset_id", "metric"], as_lit(T0), as_lit(T1), HOUR)


@query("a06_series_summary", f"""SELECT '1h' AS level, 3600 AS step, 1464 AS expected, 1464 - count(DISTINCT bucket) AS empty, count(DISTINCT CASE WHEN least < 360 THEN bucket END) AS incomplete, 0 AS omitted
  FROM (SELECT slot, bucket, min(value_count) AS least FROM hours WHERE asset_id = 'asset-3' AND metric = 'view' GROUP BY 1, 2)""", "hours")
def _(t):
    lvl = t.hours.withColumn("dims", F.create_map(F.lit("slot"), F.get_json_object("dims_key", "$.slot")))
    _, s = series.series(t.points, lvl, lvl, "asset-3", "view", *LONG, group="slot", known=["slot"])
    return s.select("level", "step", F.col("expected").cast("int").alias("expected"), "empty", "incomplete", "omitted")


@query("p08_series_request", f"""SELECT slot AS grp, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, rnd(sum(value_avg * value_count) / sum(value_count), 4) AS value FROM hours
  WHERE asset_id = 'asset-3' AND metric = 'view' GROUP BY 1, 2""", "hours")
def _(t):
    lvl = t.hours.withColumn("dims", F.create_map(F.lit("slot"), F.get_json_object("dims_key", "$.slot")))
    pts, _ = series.series(t.points, lvl, lvl, "asset-3", "view", *LONG, group="slot", known=["slot"])
    return pts.select(F.col("group").alias("grp"), text("bucket"), r("value"))


@query("p09_dimension_filter", "SELECT metric, asset_id, count(*) AS n, rnd(avg(value), 4) AS value FROM points WHERE slot = '2' GROUP BY 1, 2", "points")
def _(t):
    return series.with_filters(t.points, {"slot": "2"}, ["slot"]).groupBy("metric", "asset_id").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4, "value"))


@query("a07_metrics_seen", "SELECT DISTINCT metric FROM points WHERE asset_id = 'asset-3' AND ts >= TIMESTAMP '2024-01-30 20:00:00'", "points")
def _(t):
    return series.metrics_seen(t.points, "asset-3", F.to_timestamp(F.lit("2024-01-30 20:00:00")))


@query("a08_dimension_values", """SELECT metric, dim, val FROM (SELECT *, row_number() OVER (PARTITION BY metric, dim ORDER BY val) AS rk FROM (SELECT DISTINCT event_type AS metric, 'k' AS dim,
  json_extract_string(props, '$.k') AS val FROM events)) WHERE rk <= 60""")
def _(t):
    p = t.events.select(F.col("event_type").alias("metric"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("dims"))
    return series.dimension_values(p, ["metric"], 60)


@query("a10_recent_busy", """SELECT asset_id, round_even(1 - avg(value / 500), 4) AS cpu_busy FROM points WHERE metric = 'view' AND slot = '1' AND ts >= TIMESTAMP '2024-01-20' GROUP BY 1""", "points")
def _(t):
    p = t.points.where("metric = 'view'").withColumn("metric", F.lit("system_cpu_utilization")).withColumn("value", F.col("value") / 500).withColumn(
        "dims", F.create_map(F.lit("state"), F.when(F.col("slot") == "1", "idle").otherwise("user")))
    return rollup.recent_busy(p, F.to_timestamp(F.lit("2024-01-30 00:00:00")), 14400)


_USE = """SELECT asset_id, CASE metric WHEN 'view' THEN 'cpu' ELSE 'memoria' END AS kind, bucket, round_even(CASE metric WHEN 'view' THEN 1 - v ELSE v END, 4) AS busy
  FROM (SELECT asset_id, metric, bucket, sum(value_avg / 500 * value_count) / sum(value_count) AS v FROM hours WHERE (metric = 'view' AND slot = '1') OR (metric = 'click' AND slot = '2') GROUP BY ALL)"""


def use_hours(t):
    h = _level(t.hours).where("metric in ('view', 'click')").withColumn("value_avg", F.col("value_avg") / 500)
    cpu = F.col("metric") == "view"
    state = F.when(cpu & (F.col("slot") == "1"), "idle").when(~cpu & (F.col("slot") == "2"), "used").otherwise("other")
    h = h.withColumn("dims", F.create_map(F.lit("state"), state)).withColumn(
        "metric", F.when(cpu, "system_cpu_utilization").otherwise("system_memory_utilization"))
    return rollup.hourly_use(h)


@query("a11_hourly_use", f"SELECT asset_id, kind, {_TEXT}, busy FROM ({_USE})", "hours")
def _(t):
    return use_hours(t).select("asset_id", "kind", text("bucket"), "busy")


@query("w06_rates", """SELECT asset_id, metric, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, rnd(dv / dt, 6) AS value FROM (SELECT asset_id, metric, bucket,
  value - lag(value) OVER w AS dv, epoch(bucket) - epoch(lag(bucket) OVER w) AS dt FROM (SELECT asset_id, metric, bucket, value % 1000 AS value FROM counter) WINDOW w AS (PARTITION BY asset_id, metric ORDER BY bucket)) WHERE dt > 0 AND dv >= 0""", "counter")
def _(t):
    # the counter restarts at every thousand
    c = t.counter.withColumn("value", F.col("value") % 1000)
    return series.rate(c, ["asset_id", "metric"]).select("asset_id", "metric", text("bucket"), r("value", 6))


@query("w07_rates_per_asset", """SELECT asset_id, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, rnd(sum(CASE WHEN x >= 0 THEN x END), 6) AS value FROM (SELECT asset_id, bucket,
  (value - lag(value) OVER w) / (epoch(bucket) - epoch(lag(bucket) OVER w)) AS x FROM (SELECT asset_id, metric, bucket, value % 1000 AS value FROM counter) WINDOW w AS (PARTITION BY asset_id, metric ORDER BY bucket)) GROUP BY asset_id, bucket""", "counter")
def _(t):
    c = t.counter.withColumn("value", F.col("value") % 1000)
    return series.rate_per_asset(c, ["asset_id", "metric"], ["asset_id"]).select("asset_id", text("bucket"), r("value", 6))


@query("w08_two_level_mean", """SELECT asset_id, metric, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, rnd(avg(m), 4) AS value FROM (SELECT asset_id, metric, slot, date_trunc('day', ts) AS bucket, avg(value) AS m
  FROM points GROUP BY ALL) GROUP BY asset_id, metric, bucket""", "points")
def _(t):
    return rollup.two_level_mean(t.points, DAY, ["asset_id", "metric", "slot"], ["asset_id", "metric"]).select("asset_id", "metric", text("bucket"), r("value"))


@query("w14_peaks", """SELECT asset_id, metric, slot, strftime(arg_max(bucket, (value, -epoch_us(bucket))), '%Y-%m-%d %H:%M:%S') AS bucket, rnd(max(value), 4) AS value FROM (
  SELECT *, CASE WHEN n <= 40 THEN i ELSE (SELECT max(s) FROM range(40) q(s) WHERE floor(s * (n / 40.0)) <= i) END AS slot FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, metric ORDER BY bucket) - 1 AS i,
  count(*) OVER (PARTITION BY asset_id, metric) AS n FROM hourly)) GROUP BY asset_id, metric, slot""", "hourly")
def _(t):
    return series.peaks(t.hourly, ["asset_id", "metric"], "bucket", "value", 40).select("asset_id", "metric", "slot", text("bucket"), r("value"))


@query("w15_every", """SELECT asset_id, metric, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, metric ORDER BY bucket) - 1 AS i,
  count(*) OVER (PARTITION BY asset_id, metric) AS n FROM hourly) WHERE n <= 30 OR i IN (SELECT floor(s * (n / 30.0)) FROM range(30) q(s))""", "hourly")
def _(t):
    return series.every(t.hourly, ["asset_id", "metric"], "bucket", 30).select("asset_id", "metric", text("bucket"))


@query("w17_first_groups", "SELECT asset_id AS grp, count(*) AS n FROM points WHERE asset_id IN (SELECT DISTINCT asset_id FROM points ORDER BY 1 LIMIT 8) GROUP BY 1", "points")
def _(t):
    return series.top_groups(t.points, "asset_id").groupBy(F.col("asset_id").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("w17_omitted_groups", "SELECT greatest(0, count(DISTINCT asset_id) - 8) AS omitted FROM points", "points")
def _(t):
    return series.omitted_groups(t.points, "asset_id")


@query("w20_filled", """SELECT asset_id, metric, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, rnd(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY asset_id, metric ORDER BY bucket ROWS UNBOUNDED PRECEDING),
  first_value(v IGNORE NULLS) OVER (PARTITION BY asset_id, metric ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS value FROM (SELECT asset_id, metric, bucket, CASE WHEN value > 45 THEN value END AS v FROM hourly)""", "hourly")
def _(t):
    from ..operators.ordered import filled
    h = t.hourly.withColumn("value", F.when(F.col("value") > 45, F.col("value")))
    return filled(h, ["asset_id", "metric"], "bucket", DAY, ["value"]).select("asset_id", "metric", text("bucket"), r("value"))


@query("w26_resampled_with_spine", """SELECT m.metric, strftime(m.ts, '%Y-%m-%d %H:%M:%S') AS ts, rnd(v, 4) AS value FROM (SELECT metric, unnest(generate_series(a, z, INTERVAL 10 MINUTE)) AS ts FROM
  (SELECT metric, min(b) AS a, max(b) AS z FROM (SELECT metric, to_timestamp(epoch_us(ts) // 1000000 // 600 * 600) AT TIME ZONE 'UTC' AS b FROM points) GROUP BY 1)) m
  LEFT JOIN (SELECT metric, to_timestamp(epoch_us(ts) // 1000000 // 600 * 600) AT TIME ZONE 'UTC' AS ts, avg(value) AS v FROM points GROUP BY 1, 2) x USING (metric, ts)""", "points")
def _(t):
    return rollup.resampled(t.points, "metric", "ts", 600, ["value"], spine=True).select("metric", text("ts"), r("value"))


@query("w27_chart_rows", """WITH s AS (SELECT asset_id, bucket, lead(bucket) OVER (PARTITION BY asset_id ORDER BY bucket) AS nx FROM (SELECT DISTINCT asset_id, bucket FROM hourly)),
  i AS (SELECT asset_id, bucket FROM s UNION ALL SELECT asset_id, bucket + INTERVAL 1 HOUR FROM s WHERE nx - bucket > INTERVAL 2 HOUR)
  SELECT i.asset_id, l.metric, strftime(i.bucket, '%Y-%m-%d %H:%M:%S') AS bucket, rnd(h.value, 4) AS value FROM i JOIN (SELECT DISTINCT asset_id, metric FROM hourly) l USING (asset_id)
  LEFT JOIN hourly h ON h.asset_id = i.asset_id AND h.metric = l.metric AND h.bucket = i.bucket""", "hourly")
def _(t):
    return series.chart_rows(t.hourly, ["asset_id"], "metric", "bucket", "value", HOUR, 2 * HOUR).select("asset_id", "metric", text("bucket"), r("value"))


@query("x01_union_and_difference", """SELECT metric, asset_id FROM (SELECT DISTINCT metric, asset_id FROM points WHERE value > 200 UNION SELECT DISTINCT metric, asset_id FROM points WHERE slot = '1'
  EXCEPT SELECT DISTINCT metric, asset_id FROM points WHERE value > 300)""", "points")
def _(t):
    p = t.points
    pick = lambda c: p.where(c).select("metric", "asset_id")
    return pick("value > 200").unionByName(pick("slot = '1'")).distinct().join(pick("value > 300").distinct(), ["metric", "asset_id"], "left_anti")


@query("x04_intersection", "SELECT DISTINCT asset_id FROM points WHERE value > 250 INTERSECT SELECT DISTINCT asset_id FROM points WHERE value < 0.2", "points")
def _(t):
    return t.points.where("value > 250").select("asset_id").intersect(t.points.where("value < 0.2").select("asset_id"))


@query("x02_first_values_of_dimensions", "SELECT asset_id, 'slot' AS dim, slot AS val FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY slot) AS rk FROM (SELECT DISTINCT asset_id, slot FROM points)) WHERE rk <= 2", "points")
def _(t):
    return series.dimension_values(t.points, ["asset_id"], 2)
