"""Anomalies against injected faults, and the fault ledger."""

from pyspark.sql import functions as F

from ..operators import evaluate as E
from .base import query, r, text

DAYS = 30.0
_J = "judged"


def _rows(t):
    return E.per_injection(t.injections, t.judged, *t.window)


_PER = """SELECT i.uid, i.type, i.asset_id, a.anomaly_id IS NOT NULL AS detected, a.n AS anomalies, a.ids AS anomaly_ids, rnd((epoch_us(a.first) - epoch_us(i."start")) / 60000000, 3) AS delay_min
  FROM injections i LEFT JOIN (SELECT uid, min(anomaly_id) AS anomaly_id, count(*) AS n, min("start") AS first, string_agg(anomaly_id, ',' ORDER BY anomaly_id) AS ids FROM judged WHERE verdict = 'correcta' GROUP BY 1) a USING (uid)
  WHERE i.state = 'completada' AND i.type <> 'latencia'"""


@query("j03_attributed", """SELECT anomaly_id, arg_max(i.uid, (i."start", i.uid)) AS uid FROM anomalies a JOIN injections i ON a.asset_id = i.asset_id AND a."start" >= i."start"
  AND a."start" <= coalesce(i."end", i."start") + INTERVAL 5 MINUTE GROUP BY 1""", "anomalies injections")
def _(t):
    return E.attribute(t.anomalies, t.injections).select("anomaly_id", "uid")


@query("p20_evaluated_window", """SELECT state = 'completada' AND "start" >= TIMESTAMP '2024-01-05' AND "start" < TIMESTAMP '2024-01-20' AS valid, state = 'completada' AND "start" >= TIMESTAMP '2024-01-05' AND "start" < TIMESTAMP '2024-01-20' AND type <> 'latencia' AS counted,
  count(*) AS n FROM injections GROUP BY 1, 2""", "injections")
def _(t):
    ts = lambda s: F.to_timestamp(F.lit(s))
    return E.evaluated(t.injections, ts("2024-01-05 00:00:00"), ts("2024-01-20 00:00:00")).groupBy("valid", "counted").agg(F.count(F.lit(1)).alias("n"))


@query("a52_verdicts", "SELECT anomaly_id, verdict, uid, inj_type, reason FROM judged", _J)
def _(t):
    return t.judged.select("anomaly_id", "verdict", "uid", "inj_type", "reason")


@query("a52_per_injection", _PER.replace("a.n AS anomalies", "coalesce(a.n, 0) AS anomalies"), _J)
def _(t):
    return _rows(t).select("uid", "type", "asset_id", "detected", "anomalies", "anomaly_ids", r("delay_min", 3))


@query("a52_missed", "SELECT uid, type FROM injections i WHERE state = 'completada' AND type <> 'latencia' AND NOT EXISTS (SELECT 1 FROM judged j WHERE j.uid = i.uid)", _J)
def _(t):
    return _rows(t).where("not detected").select("uid", "type")


@query("a27_totals", f"""WITH per AS ({_PER}), c AS (SELECT count(*) AS injections, count_if(detected) AS detected, avg(delay_min) AS dm, quantile_cont(delay_min, 0.5) AS dq, max(delay_min) AS dx FROM per),
  v AS (SELECT count_if(verdict = 'correcta') AS correct, count_if(verdict = 'falso_positivo') AS false_positives FROM judged)
  SELECT injections, detected, correct, false_positives, rnd(correct / (correct + false_positives), 4) AS precision, rnd(detected / injections, 4) AS recall,
  rnd(2 * (correct / (correct + false_positives)) * (detected / injections) / (correct / (correct + false_positives) + detected / injections), 4) AS f1, rnd(dm, 2) AS delay_mean, rnd(dq, 2) AS delay_median, rnd(dx, 2) AS delay_max FROM c, v""", _J)
def _(t):
    d = E.totals(_rows(t), t.judged)
    return d.select("injections", "detected", "correct", "false_positives", r("precision"), r("recall"), r("f1"), r("delay_mean", 2), r("delay_median", 2), r("delay_max", 2))


@query("a27_by_type", f"SELECT type, count(*) AS injections, count_if(detected) AS detected, CAST(sum(coalesce(anomalies, 0)) AS BIGINT) AS correct, rnd(avg(delay_min), 2) AS delay_mean, rnd(count_if(detected) / count(*), 4) AS recall FROM ({_PER}) GROUP BY 1", _J)
def _(t):
    return E.by_type(_rows(t)).select("type", "injections", "detected", "correct", r("delay_mean", 2), r("recall"))


@query("a28_false_positives", "SELECT asset_id, count(*) AS total, rnd(count(*) / 30.0, 4) AS per_day FROM judged WHERE verdict = 'falso_positivo' GROUP BY 1", _J)
def _(t):
    return E.false_positives(t.judged, ["asset_id"], DAYS).select("asset_id", "total", r("per_day"))


@query("a28_false_positives_by_metric", "SELECT metric, count(*) AS total, rnd(count(*) / 30.0, 4) AS per_day FROM judged WHERE verdict = 'falso_positivo' GROUP BY 1", _J)
def _(t):
    return E.false_positives(t.judged, ["metric"], DAYS).select("metric", "total", r("per_day"))


@query("a29_operator_marks", """SELECT count_if(m) AS marked, count_if(m AND NOT h) AS "right", count_if(m AND h) AS wrong, count_if(NOT m AND NOT h) AS unmarked FROM (SELECT state = 'falso_positivo' AS m, verdict = 'correcta' AS h
  FROM judged WHERE verdict <> 'ignorada')""", _J)
def _(t):
    return E.operator_marks(t.judged)


@query("a30_fingerprints", "SELECT asset_id, substring(sha256(string_agg(uid, chr(10) ORDER BY uid)), 1, 12) AS fingerprint, count(*) AS ids FROM injections GROUP BY 1", "injections")
def _(t):
    return E.fingerprint(t.injections, "uid", ["asset_id"])


@query("p18_overlapping_injections", """SELECT uid FROM injections WHERE "start" < TIMESTAMP '2024-01-20' AND coalesce("end", TIMESTAMP '9999-12-31') >= TIMESTAMP '2024-01-18'""", "injections")
def _(t):
    ts = lambda s: F.to_timestamp(F.lit(s))
    return E.overlapping(t.injections, ts("2024-01-18 00:00:00"), ts("2024-01-20 00:00:00")).select("uid")


@query("a41_injections_from_labels", """SELECT uid, kind, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end", max(value) AS peak, rnd((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000, 3) AS minutes,
  count(DISTINCT date_trunc('hour', ts)) AS hours FROM (SELECT ts, value, event_type AS kind, user_id || '-' || strftime(ts, '%d') AS uid FROM events WHERE event_type = 'purchase') GROUP BY 1, 2""")
def _(t):
    e = t.events.withColumn("uid", F.when(F.col("event_type") == "purchase", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "dd")))).withColumnRenamed("event_type", "kind")
    return E.from_labels(e, "uid", "kind", "ts", "value").select("uid", "kind", text("start"), text("end"), "peak", r("minutes", 3), "hours")


def _truth(t):
    """view = start line, click = end line of the user's fault of that day."""
    e = t.events.where("event_type in ('view', 'click')")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    start = F.col("event_type") == "view"
    kind = F.element_at(F.array(*[F.lit(x) for x in ("cpu", "memoria", "disco", "otro")]), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "dd")).alias("uid"), F.when(start, "inicio").otherwise("fin").alias("event"), F.col("event_id").alias("seq"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("asset_id"), kind.alias("type"), F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("node"),
        F.when(start, at).alias("start_text"), F.when(~start, at).alias("end_text"), F.when(~start, F.when(F.col("value") < 400, "completada").otherwise("rara")).alias("end_state"),
        F.lit("alta").alias("intensity"), F.create_map(F.lit("k"), F.col("k").cast("string")).alias("params"), F.when(F.col("value") > 100, "limite").alias("reason"), F.lit(None).cast("string").alias("closing"))


_PAIRED = """SELECT i.uid, CASE i.u % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'memoria' WHEN 2 THEN 'disco' ELSE 'otro' END AS type, CASE WHEN i.u % 3 <> 0 THEN 'u' || i.u END AS asset_id, 'host-' || i.u AS node, date_trunc('second', i.ts) AS "start",
  date_trunc('second', f.ts) AS "end", CASE WHEN f.uid IS NULL THEN 'en_curso' WHEN f.value < 400 THEN 'completada' ELSE 'rara' END AS state, i.k, f.value > 100 AS has_reason FROM
  (SELECT user_id || '-' || strftime(ts, '%d') AS uid, arg_max(user_id, event_id) AS u, arg_max(ts, event_id) AS ts, arg_max(json_extract_string(props, '$.k'), event_id) AS k FROM events WHERE event_type = 'view' GROUP BY 1) i
  LEFT JOIN (SELECT user_id || '-' || strftime(ts, '%d') AS uid, arg_max(ts, event_id) AS ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1) f USING (uid)"""


@query("j19_paired_events", f"""SELECT uid, type, asset_id, strftime("start", '%Y-%m-%d %H:%M:%S') AS start, strftime("end", '%Y-%m-%d %H:%M:%S') AS "end", state, CASE WHEN has_reason THEN '{{"k":"' || k || '","motivo":"limite"}}' ELSE '{{"k":"' || k || '"}}' END AS params
  FROM ({_PAIRED}) WHERE type <> 'otro' AND state <> 'rara'""")
def _(t):
    rows, _ = E.pair_events(_truth(t))
    return rows.select("uid", "type", "asset_id", text("start"), text("end"), "state", F.to_json("params").alias("params"))


@query("j19_rejected_events", f"SELECT uid, type FROM ({_PAIRED}) WHERE type = 'otro' OR state = 'rara'")
def _(t):
    return E.pair_events(_truth(t))[1]


@query("u04_merged_injections", f"""SELECT count(*) AS rows, count_if(state = 'en_curso') AS kept, count("end") AS ended, count(DISTINCT state) AS states, count_if(state = 'en_curso') AS running FROM (
  SELECT * FROM ({_PAIRED}) WHERE type <> 'otro' AND state <> 'rara')""")
def _(t):
    rows, _ = E.pair_events(_truth(t))
    first = rows.withColumn("state", F.lit("en_curso")).withColumn("end", F.lit(None).cast("timestamp"))
    m = E.merge_injections(first, rows)
    again = E.merge_injections(m.drop("changed"), first)
    return again.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("changed")).alias("kept"), F.count("end").alias("ended"),
                     F.count_distinct("state").alias("states"), F.count_if(F.col("state") == "en_curso").alias("running"))


@query("j18_filled_assets", f"""SELECT coalesce(p.asset_id, k.asset_id) AS asset_id, count(*) AS n FROM ({_PAIRED}) p LEFT JOIN (SELECT key, asset_id FROM keys WHERE kind = 'host.name') k ON k.key = p.node
  WHERE type <> 'otro' AND state <> 'rara' GROUP BY 1""", "keys")
def _(t):
    rows, _ = E.pair_events(_truth(t))
    return E.fill_assets(rows, t.keys.where("kind = 'host.name'")).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))


@query("s12_fault_kinds", """SELECT CASE WHEN event_type = 'view' THEN CASE WHEN k % 2 = 0 THEN 'disco_abrupto' ELSE 'disco_gradual' END ELSE event_type END AS kind, count(*) AS n
  FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def _(t):
    from ..sources.files import fault_kind
    p = F.when(F.col("k") % 2 == 0, '{"modo":"abrupto"}').when(F.col("k") % 3 == 0, "broken{").otherwise("{}")
    return t.events.groupBy(fault_kind(F.when(F.col("event_type") == "view", "disco").otherwise(F.col("event_type")), p).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
