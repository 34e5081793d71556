"""Baselines, events, closing, runs."""

from pyspark.sql import functions as F

from ..operators import detect, incidents, signals
from .base import DAY, query, r, text

_BASE = """SELECT *, CASE WHEN mad > 0 THEN mad ELSE sd END AS raw FROM (SELECT *, CASE WHEN len(h) >= 60 THEN list_median(list_transform(h, lambda x: abs(x - med))) * 1.4826 END AS mad FROM (
  SELECT *, CASE WHEN len(h) >= 60 THEN list_median(h) END AS med FROM (SELECT asset_id, metric, bucket, value, list(value) OVER w AS h, stddev_pop(value) OVER w AS sd, row_number() OVER (PARTITION BY asset_id, metric ORDER BY bucket) AS pos
  FROM hourly WINDOW w AS (PARTITION BY asset_id, metric ORDER BY bucket ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))))"""
SCORED = f"""SELECT asset_id, metric, bucket, value, med, CASE WHEN med IS NOT NULL AND greatest(raw, floor) > 0 THEN greatest(raw, floor) END AS scale, pos,
  CASE WHEN med IS NULL THEN NULL WHEN greatest(raw, floor) > 0 THEN (value - med) / greatest(raw, floor) ELSE 0 END AS z FROM (SELECT *, 1.0 AS floor FROM ({_BASE}))"""
EVENTS = f"""SELECT * FROM (SELECT *, sum(c) OVER (PARTITION BY asset_id, metric ORDER BY bucket ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS run,
  lag(c, 2, 0) OVER (PARTITION BY asset_id, metric ORDER BY bucket) AS prev FROM (SELECT *, CASE WHEN z >= 3.5 THEN 1 ELSE 0 END AS c FROM ({SCORED}))) WHERE run = 2 AND prev = 0"""
SEV = "CASE WHEN z / 3.5 >= 100 THEN 'alta' WHEN z / 3.5 >= 10 THEN 'media' ELSE 'baja' END"
KEYS = ["asset_id", "metric"]


def scored(t, run=2):
    """The tables hold single spikes, so two points make a run here."""
    return detect.scored(t.hourly, KEYS, run=run, floor=1.0, bucket_seconds=DAY, chunk_rows=1024)


@query("w01_rolling_baseline", f"SELECT asset_id, metric, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, rnd(med, 4) AS med, rnd(scale, 4) AS scale FROM ({SCORED})", "hourly")
def _(t):
    return scored(t).select(*KEYS, text("bucket"), r("med"), r("scale"))


@query("w02_scores", f"""SELECT asset_id, metric, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, rnd(z, 4) AS z, CASE WHEN z IS NULL THEN NULL WHEN z >= 3.5 THEN 'critico' WHEN z >= 1.5 THEN 'normal' ELSE 'bueno' END AS state
  FROM ({SCORED})""", "hourly")
def _(t):
    return scored(t).select(*KEYS, text("bucket"), r("z"), "state")


@query("w03_severities", "SELECT CASE WHEN value / 3.5 >= 100 THEN 'alta' WHEN value / 3.5 >= 10 THEN 'media' ELSE 'baja' END AS severity, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(detect.severity(F.col("value")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("w04_events", f"SELECT asset_id, metric, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, rnd(z, 4) AS z, {SEV} AS severity FROM ({EVENTS})", "hourly")
def _(t):
    return detect.events(scored(t)).select(*KEYS, text("bucket"), r("z"), "severity")


@query("w05_latest_events", f"""SELECT asset_id, metric, strftime(max(bucket), '%Y-%m-%d %H:%M:%S') AS start, rnd(arg_max(value, bucket), 4) AS observed, rnd(arg_max(med, bucket), 4) AS expected, rnd(arg_max(scale, bucket), 4) AS scale
  FROM ({EVENTS}) GROUP BY 1, 2""", "hourly")
def _(t):
    e = detect.latest_events(scored(t), KEYS, least_rows=62)
    return e.select(*KEYS, text("start"), r("value", 4, "observed"), r("med", 4, "expected"), r("scale"))


@query("p15_long_enough", "SELECT asset_id, metric, count(*) AS points, count(*) >= 150 AS ok FROM hourly GROUP BY 1, 2", "hourly")
def _(t):
    return t.hourly.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("points"), (F.count(F.lit(1)) >= 150).alias("ok"))


_SIG = [("view", "medida", {"slot": "1"}, None, 0.01, ["cpu"], {}), ("click", "medida", {}, "slot", 0.0, ["disco"], {"slot": "[23]"}),
        ("signup", "acumulada", {}, "slot", 0.0, ["disco", "cpu"], {}), ("ghost", "medida", {"no": "1"}, None, 0.0, ["memoria"], {}), ("purchase", "medida", {"color": "red"}, None, 0.0, [], {})]


def _signals(t):
    return signals.catalogue(t.spark, _SIG)


def _level(t):
    return t.hours.withColumn("dims", F.create_map(F.lit("slot"), F.get_json_object("dims_key", "$.slot")))


WATCHED = """SELECT asset_id, metric, CASE metric WHEN 'view' THEN 'view[slot=1]' ELSE metric || '[por slot]' END AS signal, CASE WHEN metric <> 'view' THEN slot END AS grp, bucket,
  sum(value_avg * value_count) / sum(value_count) AS value FROM hours WHERE (metric = 'view' AND slot = '1') OR (metric = 'click' AND slot IN ('0', '1')) OR metric = 'signup' GROUP BY ALL"""


@query("p13_watched_points", f"SELECT asset_id, signal, grp, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, rnd(value, 4) AS value FROM ({WATCHED})", "hours")
def _(t):
    return signals.watched(_level(t), _signals(t)).select("asset_id", "signal", F.col("group_value").alias("grp"), text("bucket"), r("value"))


@query("p14_excluded_series", r"""SELECT dev, regexp_full_match(dev, '[a-z]+\d+|.*\dp\d+') AS skipped, count(*) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'sda' WHEN 1 THEN 'sda' || p_size WHEN 2 THEN 'nvme0n1'
  ELSE 'nvme0n1p' || p_size END AS dev FROM part) GROUP BY 1, 2""")
def _(t):
    s = F.col("p_size")
    dev = F.when(s % 4 == 0, "sda").when(s % 4 == 1, F.concat(F.lit("sda"), s.cast("string"))).when(s % 4 == 2, "nvme0n1").otherwise(F.concat(F.lit("nvme0n1p"), s.cast("string")))
    skip = signals.excluded(F.create_map(F.lit("device"), F.lit(signals.PARTITION)), F.create_map(F.lit("device"), F.col("dev")))
    return t.read("part").select(dev.alias("dev")).groupBy("dev", skip.alias("skipped")).agg(F.count(F.lit(1)).alias("n"))


_CYCLE = """, pts AS (SELECT asset_id, signal, grp, bucket, value, CASE WHEN metric = 'view' THEN 0.01 ELSE 0.0 END AS floor FROM w WHERE metric <> 'signup' UNION ALL SELECT asset_id, signal, grp, bucket, dv / dt, 0.0 FROM (SELECT *, value - lag(value) OVER p AS dv, epoch(bucket) - epoch(lag(bucket) OVER p) AS dt
    FROM w WHERE metric = 'signup' WINDOW p AS (PARTITION BY asset_id, signal, grp ORDER BY bucket)) WHERE dt > 0 AND dv >= 0),
  h AS (SELECT *, list(value) OVER b AS h, stddev_pop(value) OVER b AS sd, count(*) OVER (PARTITION BY asset_id, signal, grp) AS n FROM pts WINDOW b AS (PARTITION BY asset_id, signal, grp ORDER BY bucket ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
  m AS (SELECT *, CASE WHEN len(h) >= 20 THEN list_median(h) END AS med FROM h), d AS (SELECT *, CASE WHEN len(h) >= 20 THEN list_median(list_transform(h, lambda x: abs(x - med))) * 1.4826 END AS mad FROM m),
  z AS (SELECT *, CASE WHEN med IS NULL THEN NULL WHEN greatest(CASE WHEN mad > 0 THEN mad ELSE sd END, floor) > 0 THEN (value - med) / greatest(CASE WHEN mad > 0 THEN mad ELSE sd END, floor) ELSE 0 END AS z FROM d),
  e AS (SELECT *, sum(c) OVER (PARTITION BY asset_id, signal, grp ORDER BY bucket ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS run, lag(c, 2, 0) OVER (PARTITION BY asset_id, signal, grp ORDER BY bucket) AS prev FROM (SELECT *, CASE WHEN z >= 3.5 THEN 1 ELSE 0 END AS c FROM z))
  SELECT asset_id, signal, '{"slot":"' || coalesce(grp, '1') || '"}' AS dims, strftime(max(bucket), '%Y-%m-%d %H:%M:%S') AS start, arg_max(CASE WHEN z / 3.5 >= 100 THEN 'alta' WHEN z / 3.5 >= 10 THEN 'media' ELSE 'baja' END, bucket) AS severity, rnd(arg_max(z, bucket), 4) AS score
  FROM e WHERE run = 2 AND prev = 0 AND n >= 22 GROUP BY asset_id, signal, grp"""


@query("w05_detect_cycle", "WITH w AS (" + WATCHED + ")" + _CYCLE, "hours")
def _(t):
    d = detect.detect(_level(t), _signals(t), window=20, run=2, bucket_seconds=DAY)
    return d.select("asset_id", "signal", F.to_json("dims").alias("dims"), text("start"), "severity", r("score"))


@query("a44_signal_coverage", """WITH s(metric, signal, need, dim) AS (VALUES ('view', 'view[slot=1]', 63, 'slot'), ('click', 'click[por slot]', 63, 'slot'), ('signup', 'signup[por slot]', 64, 'slot'), ('ghost', 'ghost[no=1]', 63, 'no'),
  ('purchase', 'purchase[color=red]', 63, 'color')) SELECT a.asset_id, s.signal, CASE WHEN m.metric IS NULL THEN 'falta la metrica' WHEN s.dim <> 'slot' THEN 'dimension no valida' WHEN coalesce(w.n, 0) = 0 THEN 'sin datos'
  WHEN w.n < need THEN 'historial corto' ELSE 'ok' END AS status, coalesce(w.n, 0) AS points FROM (SELECT DISTINCT asset_id FROM hours) a CROSS JOIN s LEFT JOIN (SELECT DISTINCT asset_id, metric FROM hours) m USING (asset_id, metric)
  LEFT JOIN (SELECT asset_id, signal, count(*) AS n FROM (""" + WATCHED + """) GROUP BY 1, 2) w ON w.asset_id = a.asset_id AND w.signal = s.signal""", "hours")
def _(t):
    lvl, sig = _level(t), _signals(t)
    seen = lvl.select("asset_id", "metric", F.explode(F.map_keys("dims")).alias("d")).distinct().groupBy("asset_id", "metric").agg(F.collect_list("d").alias("dim_names"))
    n = signals.watched(lvl, sig).groupBy("asset_id", "signal").agg(F.count(F.lit(1)).alias("n"))
    return detect.coverage(lvl.select("asset_id").distinct(), sig, seen, n)


@query("x03_unwatched_metrics", "SELECT DISTINCT asset_id, metric FROM hours WHERE metric NOT IN ('view', 'click', 'signup', 'ghost', 'purchase')", "hours")
def _(t):
    return detect.unwatched(t.hours, _signals(t)).select("asset_id", "metric")


_SWEEP = """WITH s(setting, least, rel, fl) AS (VALUES """ + ", ".join(f"('{n}', {h}, {r_}, {1.0 if a else 0.0})" for n, h, r_, a in detect.SETTINGS) + """),
  h AS (SELECT asset_id, metric, bucket, value, list(value) OVER w AS h, stddev_pop(value) OVER w AS sd FROM hourly WINDOW w AS (PARTITION BY asset_id, metric ORDER BY bucket ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
  m AS (SELECT *, list_median(h) AS med FROM h WHERE len(h) >= 0 OR h IS NULL), d AS (SELECT *, list_median(list_transform(h, lambda x: abs(x - med))) * 1.4826 AS mad FROM m),
  x AS (SELECT *, greatest(CASE WHEN mad > 0 THEN mad ELSE coalesce(sd, 0) END, rel * abs(med), fl) AS scale, coalesce(len(h), 0) >= greatest(2, least) AS ok FROM d, s),
  z AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN scale > 0 THEN (value - med) / scale ELSE 0 END AS z FROM x),
  e AS (SELECT * FROM (SELECT *, sum(c) OVER (PARTITION BY setting, asset_id, metric ORDER BY bucket ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS run, lag(c, 2, 0) OVER (PARTITION BY setting, asset_id, metric ORDER BY bucket) AS prev FROM (SELECT *, CASE WHEN z >= 3.5 THEN 1 ELSE 0 END AS c FROM z)) WHERE run = 2 AND prev = 0),
  i AS (SELECT 'asset-' || (CAST(substring(asset_id, 2) AS BIGINT) % 10) AS a, date_trunc('day', "start") AS st, min(uid) AS uid, min("start") + INTERVAL 6 HOUR AS en FROM injections WHERE "end" IS NOT NULL GROUP BY 1, 2),
  o AS (SELECT setting, asset_id, metric, bucket, z, min(i.uid) AS uid FROM e LEFT JOIN i ON i.a = e.asset_id AND e.bucket >= i.st AND e.bucket <= i.en + INTERVAL 5 MINUTE GROUP BY 1, 2, 3, 4, 5)
  SELECT setting, count(*) AS events, count(uid) AS inside, count(*) - count(uid) AS noise, count(DISTINCT uid) AS found, count_if(z / 3.5 >= 100 AND uid IS NOT NULL) AS high_inside FROM o GROUP BY 1"""


# every fault with its own start and end
_SWEEP_ALL = _SWEEP.replace("""date_trunc('day', "start") AS st, min(uid) AS uid, min("start") + INTERVAL 6 HOUR AS en FROM injections WHERE "end" IS NOT NULL GROUP BY 1, 2)""",
                            """"start" AS st, uid, coalesce("end", "start") AS en FROM injections)""")


@query("w28_settings_sweep_all_faults", _SWEEP_ALL, "hourly injections")
def _(t):
    inj = t.injections.withColumn("asset_id", F.concat(F.lit("asset-"), (F.substring("asset_id", 2, 20).cast("bigint") % 10).cast("string")))
    return detect.sweep(t.hourly.withColumn("floor", F.lit(1.0)), KEYS, inj, bucket_seconds=DAY, run=2)


@query("p19_fresh_events", "SELECT anomaly_id FROM anomalies WHERE \"start\" >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 MINUTE", "anomalies")
def _(t):
    return detect.fresh(t.anomalies, F.to_timestamp(F.lit("2024-01-30 00:00:00"))).select("anomaly_id")


@query("j17_without_degraded", "SELECT count(*) AS n, count(DISTINCT asset_id) AS assets FROM anomalies WHERE asset_id NOT IN (SELECT 'u' || user_id FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30')", "anomalies")
def _(t):
    last = t.events.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("asset_id")).agg(F.max("ts").alias("m"))
    return detect.not_degraded(t.anomalies, last.where(F.col("m") < F.to_timestamp(F.lit("2024-01-30 00:00:00")))).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("asset_id").alias("assets"))


@query("j15_not_registered", """SELECT f.event_id FROM (SELECT event_id, 'u' || user_id AS asset_id, 'm' || (event_id % 5) AS metric, ts AS "start" FROM events WHERE event_type IN ('error', 'view')) f
  WHERE NOT EXISTS (SELECT 1 FROM anomalies k WHERE k.asset_id = f.asset_id AND k.metric = f.metric AND ((k."end" IS NULL AND k.state NOT IN ('cerrada', 'falso_positivo')) OR k."start" = f."start"))""", "anomalies")
def _(t):
    f = t.events.where("event_type in ('error', 'view')").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("asset_id"),
                                                                  F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("metric"), F.col("ts").alias("start"))
    return detect.not_registered(f, t.anomalies, KEYS).select("event_id")


_CLOSE = """WITH p AS (SELECT *, lag(bucket) OVER (PARTITION BY asset_id, metric ORDER BY bucket) AS pt, lag(value) OVER (PARTITION BY asset_id, metric ORDER BY bucket) AS pv FROM hourly),
  o AS (SELECT asset_id, metric, asset_id || metric AS anomaly_id, TIMESTAMP '2024-01-10' AS s, 20.0 AS med, 15.0 AS scale FROM hourly GROUP BY 1, 2),
  tl AS (SELECT o.anomaly_id, p.bucket, (value - med) / greatest(scale, 0.05 * abs(med)) < 3.5 AS good, (pt IS NULL OR pt <= s OR NOT (pv - med) / greatest(scale, 0.05 * abs(med)) < 3.5 OR epoch(bucket) - epoch(pt) > 50400) AS seam,
    row_number() OVER (PARTITION BY anomaly_id ORDER BY p.bucket DESC) AS rk FROM p JOIN o USING (asset_id, metric) WHERE p.bucket > o.s),
  l AS (SELECT anomaly_id, min(bucket) AS f, max(bucket) AS z FROM tl WHERE rk <= 5 GROUP BY 1 HAVING count(*) = 5 AND bool_and(good) AND epoch(max(bucket)) - epoch(min(bucket)) <= 126000)
  SELECT anomaly_id, strftime(max(bucket), '%Y-%m-%d %H:%M:%S') AS "end" FROM tl JOIN l USING (anomaly_id) WHERE seam AND bucket <= f GROUP BY 1"""


@query("w12_closings", _CLOSE, "hourly")
def _(t):
    o = t.hourly.select(*KEYS).distinct().select(*KEYS, F.concat("asset_id", "metric").alias("anomaly_id"), F.to_timestamp(F.lit("2024-01-10 00:00:00")).alias("start"),
                                                 F.lit(20.0).alias("med"), F.lit(15.0).alias("scale"))
    return incidents.closings(o, t.hourly, KEYS, step=25200, calm=5, bucket_seconds=DAY).select("anomaly_id", text("end"))


@query("u06_closed_and_marked", """SELECT state, count(*) AS n, count("end") AS ended, count(marked) AS marked FROM (SELECT CASE WHEN a.state IN ('cerrada', 'falso_positivo') THEN a.state WHEN d.v > 300 THEN 'falso_positivo'
  WHEN a."end" IS NULL AND e.anomaly_id IS NOT NULL THEN 'cerrada' WHEN d.v IS NOT NULL THEN 'confirmada' ELSE a.state END AS state,
  CASE WHEN a."end" IS NULL AND a.state NOT IN ('cerrada', 'falso_positivo') AND e.anomaly_id IS NOT NULL AND NOT coalesce(d.v > 300, false) THEN a.ts ELSE a."end" END AS "end", CASE WHEN a.state NOT IN ('cerrada', 'falso_positivo') THEN d.v END AS marked
  FROM (SELECT *, "start" AS ts FROM anomalies) a LEFT JOIN (SELECT (event_id - 1)::VARCHAR AS anomaly_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) d USING (anomaly_id)
  LEFT JOIN (SELECT (event_id + 1)::VARCHAR AS anomaly_id FROM events WHERE event_type = 'view') e USING (anomaly_id)) GROUP BY 1""", "anomalies")
def _(t):
    a = t.anomalies.withColumn("marked_by", F.lit(None).cast("string")).withColumn("marked_at", F.lit(None).cast("timestamp"))
    marks = t.events.where("event_type = 'click'").select((F.col("event_id") - 1).cast("string").alias("anomaly_id"),
                                                          F.when(F.col("value") > 300, "falso_positivo").otherwise("confirmada").alias("mark"), F.lit("op").alias("user"), F.col("ts").alias("at"))
    shut = t.events.where("event_type = 'view'").select((F.col("event_id") + 1).cast("string").alias("anomaly_id"), F.col("ts").alias("end"))
    out = incidents.apply_closings(incidents.apply_marks(a, marks), shut)
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count("end").alias("ended"), F.count("marked_by").alias("marked"))


@query("p16_incident_list", """SELECT anomaly_id, severity, EXISTS (SELECT 1 FROM diagnoses d WHERE d.anomaly_id = a.anomaly_id) AS has_diagnosis FROM anomalies a
  WHERE "start" <= TIMESTAMP '2024-01-20' AND ("end" IS NULL OR "end" >= TIMESTAMP '2024-01-10')
  ORDER BY CASE severity WHEN 'alta' THEN 0 WHEN 'media' THEN 1 WHEN 'baja' THEN 2 ELSE 3 END, "start" DESC, anomaly_id DESC LIMIT 500""", "anomalies diagnoses")
def _(t):
    ts = lambda s: F.to_timestamp(F.lit(s))
    return incidents.incident_list(t.anomalies, t.diagnoses, start=ts("2024-01-10 00:00:00"), end=ts("2024-01-20 00:00:00")).select("anomaly_id", "severity", "has_diagnosis")


@query("k01_open_incidents_first", """SELECT anomaly_id, severity, state FROM anomalies ORDER BY CASE WHEN "end" IS NOT NULL OR state IN ('cerrada', 'falso_positivo') THEN 1 ELSE 0 END,
  CASE severity WHEN 'alta' THEN 0 WHEN 'media' THEN 1 WHEN 'baja' THEN 2 ELSE 3 END, "start" DESC, anomaly_id DESC LIMIT 500""", "anomalies")
def _(t):
    return incidents.incident_list(t.anomalies, t.diagnoses, open_first=True).select("anomaly_id", "severity", "state")


@query("p17_awaiting_diagnosis", """SELECT anomaly_id FROM anomalies a WHERE state = 'detectada' AND severity IN ('baja', 'media') AND detected_at >= TIMESTAMP '2024-01-20'
  AND NOT EXISTS (SELECT 1 FROM diagnoses d WHERE d.anomaly_id = a.anomaly_id)""", "anomalies diagnoses")
def _(t):
    return incidents.awaiting_diagnosis(t.anomalies, t.diagnoses, F.to_timestamp(F.lit("2024-01-30 00:00:00")), ("baja", "media"), 14400).select("anomaly_id")


@query("j11_latest_diagnosis", """SELECT a.anomaly_id, d.diagnosis_id, d.model FROM anomalies a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY anomaly_id ORDER BY generated DESC, diagnosis_id DESC) AS rn FROM diagnoses) d
  ON d.anomaly_id = a.anomaly_id AND rn = 1""", "anomalies diagnoses")
def _(t):
    return incidents.with_latest_diagnosis(t.anomalies, t.diagnoses).select("anomaly_id", "diagnosis_id", "model")


@query("a55_diagnosis_delay", "SELECT anomaly_id, rnd((epoch_us(min(generated)) - epoch_us(any_value(detected_at))) / 1000000, 3) AS seconds FROM anomalies JOIN diagnoses USING (anomaly_id) GROUP BY 1", "anomalies diagnoses")
def _(t):
    return incidents.diagnosis_delay(t.anomalies, t.diagnoses).select("anomaly_id", r("seconds", 3))


@query("f17_public_intervals", """SELECT anomaly_id, strftime("start" - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS a, strftime(greatest(coalesce("end", TIMESTAMP '2024-01-15'), "start"), '%Y-%m-%d %H:%M:%S') AS z FROM anomalies""", "anomalies")
def _(t):
    return incidents.public_interval(t.anomalies, F.to_timestamp(F.lit("2024-01-15 00:00:00")), F.lit(90)).select("anomaly_id", text("interval_from", "a"), text("interval_to", "z"))
