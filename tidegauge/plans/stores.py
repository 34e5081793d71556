"""Writers, readers and jobs over the driver tables: what is written is read back."""

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import incidents, series
from ..schema import TAGS
from ..sources import files, sinks, versions
from ..streaming import ingest, rollup
from .base import query, r, text
from .ingest import _batch, _metrics_lines, _ROWS
from .streams import scratch


def _of_day(d, ts="ts"):
    return d.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("s06_signal_store", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM logs GROUP BY 1", "logs")
def _(t):
    path = scratch(t.spark)
    d = t.logs.withColumn("trace_id", F.lpad(F.col("event_id").cast("string"), 32, "0"))
    sinks.write_signal(d, path, "ts")
    return _of_day(t.spark.read.schema(d.schema).parquet(path))


@query("s07_json_lines", "SELECT strftime(ts, '%Y-%m-%d') AS day, severity, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM logs GROUP BY 1, 2", "logs")
def _(t):
    path = scratch(t.spark)
    sinks.write_json_lines(t.logs.select("event_id", "ts", "severity", "body"), path, "registros", "ts")
    d = t.spark.read.schema("event_id bigint, severity string, signal string, date date").json(path).where("signal = 'registros'")
    return d.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day"), "severity").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("s09_exported_range", """SELECT metric, count(*) AS n, rnd(sum(value), 2) AS total FROM points WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1""", "points")
def _(t):
    path = scratch(t.spark)
    p = t.points.select("metric", "ts", "time_ns", "value", *TAGS, "dims", F.col("ts").alias("received_at"), F.to_date("ts").alias("date"))
    gaps = t.points.groupBy("asset_id").agg(F.min("ts").alias("since"))
    sinks.export_range(p, t.injections, gaps, datetime(2024, 1, 5), datetime(2024, 1, 12), path)
    return sinks.read_export(t.spark, path).groupBy("metric").agg(F.count("*").alias("n"), r(F.sum("value"), 2, "total"))


@query("s10_export_of_one_metric", """SELECT asset_id, count(*) AS n FROM points WHERE metric = 'view' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1""", "points")
def _(t):
    path = scratch(t.spark)
    p = t.points.select("metric", "ts", "time_ns", "value", *TAGS, "dims", F.col("ts").alias("received_at"), F.to_date("ts").alias("date"))
    sinks.export_range(p, t.injections, t.points.groupBy("asset_id").agg(F.min("ts").alias("since")), datetime(2024, 1, 5), datetime(2024, 1, 12), path)
    return sinks.read_export(t.spark, path, "view").groupBy("asset_id").agg(F.count("*").alias("n"))


@query("s11_labelled_rows", "SELECT asset_id, count(*) AS n, rnd(sum(value), 2) AS total, strftime(min(bucket), '%Y-%m-%d %H:%M:%S') AS first FROM hourly GROUP BY 1", "hourly")
def _(t):
    path, h = scratch(t.spark), t.hourly
    names = [x.split()[:2] for x in files.LABELLED.split(", ")]
    put = {"time": F.date_format("bucket", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "activo": F.col("asset_id"), "cpu_user": F.col("value"), "ref_uid": F.col("metric")}
    h.select(*[put.get(n, F.lit(None).cast(k)).alias(n) for n, k in names]).write.csv(path, header=True)
    d = files.labelled_rows(t.spark, path)
    return d.groupBy("asset_id").agg(F.count("*").alias("n"), r(F.sum("cpu_user"), 2, "total"), F.date_format(F.min("time"), "yyyy-MM-dd HH:mm:ss").alias("first"))


@query("t04_summary_store", "SELECT metric, strftime(bucket, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(value_count) AS BIGINT) AS samples FROM hours GROUP BY 1, 2", "hours")
def _(t):
    path = scratch(t.spark)
    for _ in range(2):  # the second write replaces the first
        rollup.write_level(t.hours, path)
    d = t.spark.read.parquet(path)
    return d.groupBy("metric", F.date_format("bucket", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("value_count").cast("bigint").alias("samples"))


@query("t07_last_good_version", "SELECT key, asset_id FROM keys", "keys")
def _(t):
    root = scratch(t.spark)
    versions.publish(t.keys.limit(1), root, 0)
    versions.publish(t.keys, root, versions.next_version(t.spark, root))
    return versions.last_good(t.spark, root, ingest.KEYS).select("key", "asset_id")


@query("t03_backfill", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def _(t):
    root = scratch(t.spark)
    e = t.read("events")
    e.write.parquet(f"{root}/in")
    done = lambda b, i: b.write.mode("overwrite").parquet(f"{root}/out/batch={i}")
    for _ in range(2):  # the second run finds everything done
        rollup.backfill(t.spark, f"{root}/in", e.schema, f"{root}/checkpoint", done, 1).awaitTermination()
    return t.spark.read.schema(e.schema).parquet(f"{root}/out").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("t13_days_kept", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM logs WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1", "logs")
def _(t):
    path = scratch(t.spark)
    sinks.write_signal(t.logs.withColumn("trace_id", F.lit("")), path, "ts")
    sinks.drop_old(t.spark, path, 10, date(2024, 1, 20))
    return _of_day(t.spark.read.schema(t.logs.schema).parquet(path))


@query("t09_metric_job", f"""SELECT coalesce(k.asset_id, 'sin_resolver') AS asset_id, count(*) FILTER (WHERE route = 'valid') AS received, count(*) FILTER (WHERE route = 'error') AS errors
  FROM ({_ROWS}) LEFT JOIN keys k ON k.key = 'host-' || user_id GROUP BY 1""", "keys")
def _(t):
    paths = ingest.Paths(scratch(t.spark))
    versions.publish(t.keys, paths.keys, 0)
    _metrics_lines(t).write.text(f"{paths.root}/inbox")
    ingest.start_metrics(t.spark, f"{paths.root}/inbox", paths, available_now=True).awaitTermination()
    return ingest.all_sources(t.spark, paths).groupBy("asset_id").agg(F.sum("received").alias("received"), F.sum("errors").alias("errors"))


def _signal_job(t, kind, scope, item, rec):
    paths = ingest.Paths(scratch(t.spark))
    versions.publish(t.keys, paths.keys, 0)
    _batch(t, *scope, item, rec).unionByName(t.spark.createDataFrame([("no batch",)], "value string")).write.text(f"{paths.root}/inbox")
    ingest.start_signal(t.spark, f"{paths.root}/inbox", paths, kind, available_now=True).awaitTermination()
    return paths


@query("t09_log_job", """SELECT coalesce(k.asset_id, 'sin_resolver') AS asset_id, count(*) AS rows, count(*) AS received, count(*) FILTER (event_type = 'error') AS truth FROM events LEFT JOIN keys k ON k.key = 'host-' || user_id GROUP BY 1""", "keys")
def _(t):
    ns = (F.unix_micros("ts") * 1000).cast("string")
    told = F.when(F.col("event_type") == "error", F.format_string('{"uid": "p%d", "evento": "inicio"}', F.col("event_id"))).otherwise(F.col("event_type"))
    rec = F.struct(ns.alias("timeUnixNano"), F.struct(told.alias("stringValue")).alias("body"), F.lpad(F.col("event_id").cast("string"), 32, "0").alias("traceId"))
    paths = _signal_job(t, "logs", ("resourceLogs", "scopeLogs"), "logRecords", rec)
    rows = ingest.read_signal(t.spark, paths, "logs").groupBy("asset_id").agg(F.count("*").alias("rows"))
    truth = ingest.read_signal(t.spark, paths, "logs", "truth").groupBy("asset_id").agg(F.count("*").alias("truth"))
    led = ingest.all_sources(t.spark, paths).where("signal = 'registros'").groupBy("asset_id").agg(F.sum("received").alias("received"))
    return led.join(rows, "asset_id").join(truth, "asset_id", "left").select("asset_id", "rows", "received", F.coalesce("truth", F.lit(0)).alias("truth"))


@query("t09_span_job", """SELECT 'host-' || user_id AS key, count(*) AS traces, count(*) AS rows FROM events WHERE 'host-' || user_id NOT IN (SELECT key FROM keys) GROUP BY 1""", "keys")
def _(t):
    ns = (F.unix_micros("ts") * 1000).cast("string")
    rec = F.struct(ns.alias("startTimeUnixNano"), ns.alias("endTimeUnixNano"), F.lpad(F.col("event_id").cast("string"), 32, "0").alias("traceId"), F.lit("01").alias("spanId"), F.col("event_type").alias("name"))
    paths = _signal_job(t, "spans", ("resourceSpans", "scopeSpans"), "spans", rec)
    rows = ingest.read_signal(t.spark, paths, "spans").where("asset_id = 'sin_resolver'").groupBy(F.col("host_name").alias("key")).agg(F.count("*").alias("rows"))
    return ingest.all_orphans(t.spark, paths).select("key", "traces").join(rows, "key")


@query("t10_associated_orphans", f"""SELECT metric, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour FROM (SELECT 'app_' || event_type AS metric, ts, user_id, route FROM ({_ROWS}) WHERE event_type <> 'error'
  UNION ALL SELECT 'app_error_count', ts, user_id, route FROM ({_ROWS}) WHERE event_type = 'error' UNION ALL SELECT 'app_error_sum', ts, user_id, route FROM ({_ROWS}) WHERE event_type = 'error' AND k % 3 <> 0)
  WHERE route = 'valid' AND 'host-' || user_id NOT IN (SELECT key FROM keys WHERE regexp_matches(key, '[02468]$')) AND 'host-' || user_id IN (SELECT key FROM keys WHERE kind = 'host.name') GROUP BY 1, 2""", "keys")
def _(t):
    """Hosts that the catalogue knows later: their rows move, and their hours are to be redone."""
    paths = ingest.Paths(scratch(t.spark))
    versions.publish(t.keys.where("key rlike '[02468]$'"), paths.keys, 0)
    _metrics_lines(t).write.text(f"{paths.root}/inbox")
    ingest.start_metrics(t.spark, f"{paths.root}/inbox", paths, available_now=True).awaitTermination()
    orphans = ingest.all_orphans(t.spark, paths).withColumn("first_seen", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    _, hours, _ = ingest.associate(ingest.read_points(t.spark, paths), orphans, t.keys)
    return hours.select("metric", text("hour"))


@query("t11_ingest_metrics", f"""SELECT unnest(['received', 'valid', 'no_value', 'error']) AS indicator, unnest([count(*), count(*) FILTER (route = 'valid'), count(*) FILTER (route = 'no_value'), count(*) FILTER (route = 'error')])::DOUBLE AS total FROM ({_ROWS})""")
def _(t):
    """Half of the table comes in each of two runs of the job; the running totals end at the whole."""
    paths = ingest.Paths(scratch(t.spark))
    versions.publish(t.spark.createDataFrame([], ingest.KEYS), paths.keys, 0)
    lines = _metrics_lines(t)
    for k in range(2):
        lines.where(F.pmod(F.crc32("value"), F.lit(2)) == k).write.mode("append").text(f"{paths.root}/inbox")
        ingest.start_metrics(t.spark, f"{paths.root}/inbox", paths, available_now=True).awaitTermination()
    return ingest.read_metrics(t.spark, paths, "metrics").groupBy("indicator").agg(F.max("total").alias("total"))


@query("t12_stored_truth", """SELECT uid, type, coalesce(p.asset_id, k.asset_id) AS asset_id, state, strftime("end", '%Y-%m-%d %H:%M:%S') AS "end" FROM (SELECT user_id || '-' || strftime(ts, '%d') AS uid, ['cpu', 'memoria', 'disco', 'caida'][arg_max(user_id, event_id) % 4 + 1] AS type,
    CASE WHEN arg_max(user_id, event_id) % 3 <> 0 THEN 'u' || arg_max(user_id, event_id) END AS asset_id, 'host-' || arg_max(user_id, event_id) AS node FROM events WHERE event_type = 'view' GROUP BY 1) p
  LEFT JOIN (SELECT user_id || '-' || strftime(ts, '%d') AS uid, date_trunc('second', arg_max(ts, event_id)) AS "end", 'completada' AS fs FROM events WHERE event_type = 'click' GROUP BY 1) f USING (uid)
  LEFT JOIN (SELECT key, asset_id FROM keys WHERE kind = 'host.name') k ON k.key = p.node, LATERAL (SELECT CASE WHEN fs IS NULL THEN 'en_curso' ELSE fs END AS state)""", "keys")
def _(t):
    """Truth logs are loaded twice, the ends before the starts the first time; the second time changes nothing."""
    at, start = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("event_type") == "view"
    kind = F.element_at(F.array(*map(F.lit, ("cpu", "memoria", "disco", "caida"))), (F.col("user_id") % 4 + 1).cast("int"))
    body = F.to_json(F.struct(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "dd")).alias("uid"), F.when(start, "inicio").otherwise("fin").alias("evento"), kind.alias("tipo"), F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("nodo"),
        F.when(start, at).alias("inicio"), F.when(~start, at).alias("fin"), F.when(~start, "completada").alias("estado")))
    logs = t.events.where("event_type in ('view', 'click')").select(
        body.alias("body"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise("sin_resolver").alias("asset_id"), F.col("event_id").alias("time_ns"), start.alias("start"))
    root, keys = scratch(t.spark), t.keys.where("kind = 'host.name'")
    ingest.load_truth(t.spark, logs.where("not start").drop("start"), keys, root)
    for _ in range(2):
        out = ingest.load_truth(t.spark, logs.drop("start"), keys, root)
    return out.select("uid", "type", "asset_id", "state", text("end"))


@query("j04_with_diagnosis", "SELECT anomaly_id, anomaly_id IN (SELECT anomaly_id FROM diagnoses) AS has_diagnosis FROM anomalies", "anomalies diagnoses")
def _(t):
    return incidents.incident_list(t.anomalies, t.diagnoses, limit=None).select("anomaly_id", "has_diagnosis")


@query("j05_never_diagnosed", "SELECT anomaly_id FROM anomalies WHERE state = 'detectada' AND anomaly_id NOT IN (SELECT anomaly_id FROM diagnoses)", "anomalies diagnoses")
def _(t):
    return incidents.awaiting_diagnosis(t.anomalies, t.diagnoses, F.to_timestamp(F.lit("2024-03-01 00:00:00")), ("alta", "media", "baja"), 144000).select("anomaly_id")


@query("p11_level_and_step", "SELECT asset_id, strftime(to_timestamp(epoch_us(ts) // 1000000 // 1800 * 1800) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS bucket, rnd(avg(value), 4) AS value FROM points GROUP BY 1, 2", "points")
def _(t):
    start, end = datetime(2024, 1, 1), datetime(2024, 1, 29)
    step = series.step_for(series.level_for(start, end), start, end)  # 28 days: minutes, half-hour steps
    d = series.binned(t.points, step, ["asset_id"])
    return d.select("asset_id", text("bucket"), r("value"))
