"""Evidence for incidents, citations, redaction."""

from pyspark.sql import functions as F

from ..functions.redaction import redact
from ..operators import evidence as E
from ..operators import signals
from .base import query, r, text

AS_OF = "TIMESTAMP '2024-01-25 00:00:00'"


def _now():
    return F.to_timestamp(F.lit("2024-01-25 00:00:00"))


def _incidents(t):
    """Anomalies put on the ten machines of the points."""
    a = t.anomalies
    asset = F.concat(F.lit("asset-"), (F.substring("asset_id", 2, 20).cast("bigint") % 10).cast("string"))
    m = F.element_at(F.array(*[F.lit(x) for x in ("view", "click", "signup", "error", "purchase")]), (F.substring("metric", 2, 1).cast("int") + 1))
    return E.windows(a.withColumn("asset_id", asset).withColumn("metric", m), _now())


_INC = f"""SELECT anomaly_id, 'asset-' || (CAST(substring(asset_id, 2) AS BIGINT) % 10) AS asset_id, CASE metric WHEN 'm0' THEN 'view' WHEN 'm1' THEN 'click' WHEN 'm2' THEN 'signup' WHEN 'm3' THEN 'error' ELSE 'purchase' END AS metric, "start",
  "start" - INTERVAL 60 MINUTE AS metrics_from, "start" - INTERVAL 10 MINUTE AS logs_from, CASE WHEN least(eff + INTERVAL 10 MINUTE, {AS_OF}) <= "start" THEN "start" + INTERVAL 1 MINUTE ELSE least(eff + INTERVAL 10 MINUTE, {AS_OF}) END AS until,
  greatest(eff, "start" + INTERVAL 1 MINUTE) AS during_to FROM (SELECT *, least(coalesce("end", {AS_OF}), {AS_OF}, "start" + INTERVAL 3 HOUR) AS eff FROM anomalies)"""


@query("f16_evidence_windows", f"SELECT anomaly_id, strftime(metrics_from, '%Y-%m-%d %H:%M:%S') AS metrics_from, strftime(logs_from, '%Y-%m-%d %H:%M:%S') AS logs_from, strftime(until, '%Y-%m-%d %H:%M:%S') AS until, strftime(during_to, '%Y-%m-%d %H:%M:%S') AS during_to FROM ({_INC})", "anomalies")
def _(t):
    return _incidents(t).select("anomaly_id", text("metrics_from"), text("logs_from"), text("until"), text("during_to"))


_SUM = f"""SELECT i.anomaly_id, quantile_cont(value, 0.5) FILTER (WHERE ts < "start") AS bm, quantile_cont(value, 0.5) FILTER (WHERE ts >= "start" AND ts <= during_to) AS dm, max(value) FILTER (WHERE ts >= "start" AND ts <= during_to) AS dx,
  count(*) FILTER (WHERE ts < "start") AS pb, count(*) FILTER (WHERE ts >= "start" AND ts <= during_to) AS pd FROM ({_INC}) i JOIN points p ON p.asset_id = i.asset_id AND p.metric = i.metric AND p.ts >= metrics_from AND p.ts < until GROUP BY 1"""


@query("a38_evidence_summaries", f"""SELECT anomaly_id, rnd(bm, 4) AS before_median, rnd(dm, 4) AS during_median, dx AS during_max, pb AS points_before, pd AS points_during, rnd(dx - bm, 4) AS change_abs, rnd((dx - bm) / nullif(abs(bm), 0), 4) AS change_rel FROM ({_SUM})""", "anomalies points")
def _(t):
    s = E.incident_summaries(_incidents(t), t.points, "ts")
    return s.select("anomaly_id", r("before_median"), r("during_median"), "during_max", "points_before", "points_during", r("change_abs"), r("change_rel"))


@query("w16_top_related", f"""SELECT metric, anomaly_id, rank FROM (SELECT i.metric, s.anomaly_id, row_number() OVER (PARTITION BY i.metric ORDER BY abs(coalesce((dx - bm) / nullif(abs(bm), 0), 0)) DESC, abs(coalesce(dx - bm, 0)) DESC, s.anomaly_id) AS rank FROM ({_SUM}) s JOIN ({_INC}) i USING (anomaly_id)) WHERE rank <= 3""", "anomalies points")
def _(t):
    inc = _incidents(t)
    s = E.incident_summaries(inc, t.points, "ts").join(inc.select("anomaly_id", "metric"), "anomaly_id")
    return E.top_related(s, ["metric"], "anomaly_id").select("metric", "anomaly_id", F.col("rank").cast("bigint").alias("rank"))


def _spans(t):
    """Every event also as a span of its machine, so that logs and spans share a clock."""
    e = t.logs
    return e.select("asset_id", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 5 seconds")).alias("end_ts"), F.lit(5000000000).alias("duration_ns"), F.lpad(F.col("event_id").cast("string"), 32, "0").alias("trace_id"),
                    F.lit("01").alias("span_id"), F.lit("").alias("parent_id"), F.col("severity").alias("name"), F.when(F.col("severity_num") >= 17, "error").otherwise("ok").alias("status"), "service_name")


def _logs(t):
    return t.logs.withColumn("trace_id", F.lpad(F.col("event_id").cast("string"), 32, "0")).withColumn("span_id", F.lit("01"))


@query("f22_evidence_records", f"""SELECT i.anomaly_id, count(l.ts) AS logs, count(l.ts) FILTER (WHERE severity_num >= 17) AS error_logs, count(l.ts) FILTER (WHERE severity_num >= 17) AS error_traces, count(l.ts) FILTER (WHERE severity_num >= 17) AS pairs, count(l.ts) AS spans,
  any_value(s.dx) AS during_max, any_value(s.anomaly_id) IS NULL AS no_series FROM ({_INC}) i LEFT JOIN logs l ON l.asset_id = i.asset_id AND l.ts >= i.logs_from AND l.ts < i.until LEFT JOIN ({_SUM}) s ON s.anomaly_id = i.anomaly_id GROUP BY 1""", "anomalies points logs")
def _(t):
    d = E.evidence(_incidents(t), t.points, _logs(t), _spans(t), _now(), "ts")
    size = lambda c, name: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("bigint").alias(name)
    return d.select("anomaly_id", "logs", size("error_logs", "error_logs"), size("error_traces", "error_traces"), size("correlation", "pairs"), "spans",
                    F.col("affected.during_max").alias("during_max"), F.array_contains("missing", "serie afectada").alias("no_series"))


@query("f21_compact_packs", f"""WITH n AS (SELECT i.anomaly_id, count(*) AS n, strftime(min(p.ts), '%Y-%m-%d %H:%M:%S') AS a, strftime(max(p.ts), '%Y-%m-%d %H:%M:%S') AS z FROM ({_INC}) i JOIN points p ON p.asset_id = i.asset_id AND p.metric = i.metric AND p.ts >= metrics_from AND p.ts < until GROUP BY 1),
  e AS (SELECT i.anomaly_id, count(*) AS n FROM ({_INC}) i JOIN logs l ON l.asset_id = i.asset_id AND l.ts >= i.logs_from AND l.ts < i.until WHERE severity_num >= 17 GROUP BY 1)
  SELECT i.anomaly_id, i.severity, i.score, CASE WHEN n.n IS NULL THEN 0 ELSE least(n.n, 60) END AS points, CASE WHEN n.n < 60 THEN n.a END AS first, CASE WHEN n.n < 60 THEN n.z END AS last, least(coalesce(e.n, 0), 15) AS logs, least(coalesce(e.n, 0), 10) AS traces, least(coalesce(e.n, 0), 15) AS pairs,
  s.anomaly_id IS NULL AS no_series FROM anomalies i LEFT JOIN n USING (anomaly_id) LEFT JOIN e USING (anomaly_id) LEFT JOIN ({_SUM}) s USING (anomaly_id)""", "anomalies points logs")
def _(t):
    inc = _incidents(t)
    rec = E.evidence(inc, t.points, _logs(t), _spans(t), _now(), "ts", first=E.PACKED)
    pack = E.compact(rec, E.pack_points(inc, t.points, "ts")).select("anomaly_id", F.from_json("pack", """severidad string, puntuacion double, puntos array<struct<t:timestamp>>, registros_error array<string>,
        trazas_error array<string>, correlacion array<string>, no_recuperado array<string>""").alias("p"))
    n = lambda c, name: F.size(f"p.{c}").cast("bigint").alias(name)
    edge = lambda c, name: F.when(F.size("p.puntos") < 60, F.date_format(c("p.puntos.t"), "yyyy-MM-dd HH:mm:ss")).alias(name)
    return pack.select("anomaly_id", F.col("p.severidad").alias("severity"), F.col("p.puntuacion").alias("score"), n("puntos", "points"), edge(F.array_min, "first"), edge(F.array_max, "last"), n("registros_error", "logs"),
                       n("trazas_error", "traces"), n("correlacion", "pairs"), F.array_contains("p.no_recuperado", "serie afectada").alias("no_series"))


# events as the platform's metrics: four CPU signals and a disk counter with direction and device
_EV = {"view": ("system_cpu_utilization", "state=user"), "click": ("system_cpu_utilization", "state=system"), "signup": ("system_cpu_load_average_1m", ""), "error": ("system_processes_count", "status=running")}


def _level(t):
    m, s = F.col("metric"), F.col("slot").cast("int")
    name, dims = F.lit("system_disk_io"), F.create_map(F.lit("direction"), F.when(s % 2 == 0, "write").otherwise("read"), F.lit("device"), F.when(s < 2, "sda").otherwise("sdb"))
    for ev, (metric, d) in _EV.items():
        own = F.create_map(*map(F.lit, d.split("="))) if d else F.create_map().cast("map<string,string>")
        name, dims = F.when(m == ev, metric).otherwise(name), F.when(m == ev, own).otherwise(dims)
    return t.points.select("asset_id", name.alias("metric"), "ts", dims.alias("dims"), F.col("value").alias("value_avg"), F.lit(1.0).alias("value_count"))


def _platform_incidents(t):
    inc, m = _incidents(t), F.col("metric")
    name, dims = F.lit("system_disk_io"), F.create_map(F.lit("direction"), F.lit("write"), F.lit("device"), F.lit("sda"))
    for ev, (metric, d) in _EV.items():
        own = F.create_map(*map(F.lit, d.split("="))) if d else F.create_map().cast("map<string,string>")
        name, dims = F.when(m == ev, metric).otherwise(name), F.when(m == ev, own).otherwise(dims)
    return inc.withColumn("_n", name).withColumn("dims", dims).drop("metric").withColumnRenamed("_n", "metric")


def _asks():
    """What the checker's text asks of each incident: (its event, role, event, direction, device, metric, signal, fixed dimensions, device shown)."""
    key = {e: m + (f"[{d}]" if d else "") for e, (m, d) in _EV.items()}
    rows = [(e, "afectada", e, "", "", *_EV[e][:1], key[e], _EV[e][1], "") for e in _EV]
    rows += [(a, "relacionada", b, "", "", _EV[b][0], key[b], _EV[b][1], "") for a in _EV for b in _EV if a != b]
    io = "system_disk_io[direction={}, por device]"
    rows += [("purchase", "afectada", "purchase", "write", "sda", "system_disk_io", io.format("write"), "device=sda,direction=write", ""),
             ("purchase", "relacionada", "purchase", "read", "", "system_disk_io", io.format("read"), "direction=read", ",device=")]
    return ", ".join(str(r) for r in rows)


_SERIES = f"""WITH ask(im, role, ev, dirn, dev, pm, signal, fixed, shown) AS (VALUES {_asks()}),
  e AS (SELECT asset_id, metric AS ev, ts, value, CASE WHEN metric <> 'purchase' THEN '' WHEN slot IN ('0', '2') THEN 'write' ELSE 'read' END AS dirn, CASE WHEN metric <> 'purchase' THEN '' WHEN slot IN ('0', '1') THEN 'sda' ELSE 'sdb' END AS dev FROM points),
  s AS (SELECT i.anomaly_id, role, pm, signal, ask.ev, fixed || CASE WHEN shown = '' THEN '' ELSE shown || e.dev END AS dims, i."start", during_to, ts, avg(value) AS v FROM ({_INC}) i JOIN ask ON i.metric = im
    JOIN e ON e.asset_id = i.asset_id AND e.ev = ask.ev AND e.dirn = ask.dirn AND (ask.dev = '' OR ask.dev = e.dev) AND ts >= metrics_from AND ts < until GROUP BY ALL),
  q AS (SELECT *, (v - lag(v) OVER w) / (epoch_us(ts) - epoch_us(lag(ts) OVER w)) * 1000000 AS x FROM s WINDOW w AS (PARTITION BY anomaly_id, role, signal, dims ORDER BY ts)),
  f AS (SELECT * EXCLUDE (v, x), CASE WHEN ev = 'purchase' THEN x ELSE v END AS v FROM q WHERE ev <> 'purchase' OR x >= 0),
  g AS (SELECT anomaly_id, role, pm AS metric, signal, CASE WHEN ev = 'purchase' THEN 'por segundo' END AS unit, dims, quantile_cont(v, 0.5) FILTER (WHERE ts < "start") AS bm, quantile_cont(v, 0.5) FILTER (WHERE ts >= "start" AND ts <= during_to) AS dm,
    max(v) FILTER (WHERE ts >= "start" AND ts <= during_to) AS dx, count(*) FILTER (WHERE ts < "start") AS points_before, count(*) FILTER (WHERE ts >= "start" AND ts <= during_to) AS points_during FROM f GROUP BY ALL),
  h AS (SELECT *, row_number() OVER (PARTITION BY anomaly_id, role, signal ORDER BY abs(coalesce((dx - bm) / nullif(abs(bm), 0), 0)) DESC, abs(coalesce(dx - bm, 0)) DESC, dims) AS rank FROM g)
  SELECT anomaly_id, role, metric, signal, unit, dims, rnd(bm, 4) AS before_median, rnd(dm, 4) AS during_median, rnd(dx, 4) AS during_max, points_before, points_during, rank FROM h WHERE rank <= 3"""


@query("f22_incident_series", _SERIES, "anomalies points")
def _(t):
    s = E.incident_series(_platform_incidents(t), _level(t), signals.catalogue(t.spark), _now(), "ts")
    return s.select("anomaly_id", "role", "metric", "signal", "unit", "dims", r("before_median"), r("during_median"), r("during_max"), "points_before", "points_during", F.col("rank").cast("bigint").alias("rank"))


@query("f21_packs_with_series", f"""SELECT anomaly_id, CAST(count(*) AS BIGINT) AS series, string_agg(metric || '|' || dims || '|' || role || '|' || coalesce(unit, ''), ';' ORDER BY role <> 'afectada', signal, rank) AS named FROM ({_SERIES}) GROUP BY 1""", "anomalies points")
def _(t):
    """The packs of the incidents that have series, read back from their text."""
    inc = _platform_incidents(t)
    rec = E.with_series(E.evidence(inc, t.points.limit(0), _logs(t), _spans(t), _now(), "ts", first=E.PACKED), E.incident_series(inc, _level(t), signals.catalogue(t.spark), _now(), "ts"))
    pack = E.compact(rec, E.pack_points(inc, t.points.limit(0), "ts")).select(
        "anomaly_id", F.from_json("pack", "series array<struct<metrica:string,dimensiones:string,papel:string,unidad:string>>").alias("p")).where(F.size("p.series") > 0)
    named = F.array_join(F.transform("p.series", lambda x: F.concat_ws("|", x["metrica"], x["dimensiones"], x["papel"], F.coalesce(x["unidad"], F.lit("")))), ";")
    return pack.select("anomaly_id", F.size("p.series").cast("bigint").alias("series"), named.alias("named"))


@query("j16_related_signals", """WITH a AS (SELECT event_id AS ask_id, CASE WHEN k % 4 = 0 THEN 'u' WHEN k % 4 = 1 THEN 'w' WHEN k % 4 = 2 THEN 'm' ELSE 'n' END AS c FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
  r(c, rel_signal) AS (VALUES ('u', 'system_cpu_utilization[state=system]'), ('u', 'system_cpu_load_average_1m'), ('u', 'system_processes_count[status=running]'), ('w', 'system_filesystem_usage[state=used, por mountpoint]'), ('w', 'system_disk_io[direction=write, por device]'),
  ('w', 'system_disk_io[direction=read, por device]'), ('m', 'system_paging_usage[state=used, por device]'), ('m', 'system_paging_operations[direction=page_in, por type]')) SELECT ask_id, rel_signal FROM a JOIN r USING (c)""")
def _(t):
    k = F.col("k") % 4
    metric = F.when(k < 2, "system_cpu_utilization").when(k == 2, "system_memory_utilization").otherwise("system_network_io")
    dims = F.when(k == 3, F.create_map(F.lit("direction"), F.lit("receive"))).otherwise(F.create_map(F.lit("state"), F.when(k == 0, "user").when(k == 1, "wait").otherwise("used")))
    asked = t.events.select(F.col("event_id").alias("ask_id"), metric.alias("metric"), dims.alias("dims"))
    return signals.related(signals.catalogue(t.spark), asked).select("ask_id", "rel_signal")


@query("f20_checked_citations", f"""SELECT anomaly_id, count_if(ok) AS valid, count_if(NOT ok) AS discarded FROM (SELECT anomaly_id, c, CASE c WHEN 0 THEN true WHEN 1 THEN extract('hour' FROM "start") < 12 ELSE false END AS ok FROM ({_INC}), (VALUES (0), (1), (2)) v(c)) GROUP BY 1""", "anomalies")
def _(t):
    inc = _incidents(t)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    c = lambda m, a, z: F.struct(m.alias("metrica"), iso(a).alias("desde"), iso(z).alias("hasta"), F.lit("x").alias("observacion"))
    late = F.when(F.hour("start") < 12, F.col("start")).otherwise(F.col("start") - F.expr("interval 3 hours"))
    cites = F.to_json(F.array(c(F.col("metric"), F.col("metrics_from"), F.col("start")), c(F.col("metric"), late, F.col("start")), c(F.lit("ghost"), F.col("start"), F.col("start"))))
    ans = inc.select("anomaly_id", F.lit("h").alias("hypothesis"), cites.alias("citations"))
    return E.checked_citations(ans, inc, inc.select("anomaly_id", "metric")).select("anomaly_id", "valid", "discarded")


def _known(t):
    """native ids, host names and display names of all assets."""
    keys = t.keys.select(F.col("key").alias("value"), F.when(F.col("kind") == "nativo", "ID").otherwise("ANFITRION").alias("kind"))
    return keys.unionByName(t.keys.select(F.col("asset_id").alias("value"), F.lit("ACTIVO").alias("kind")).distinct())


def _tail(n):
    x = n.cast("string")
    return F.concat(F.lit(" Customer#"), F.lpad(x, 9, "0"), F.lit(" Host-"), x, F.lit(", 10.0."), (n % 9).cast("string"), F.lit(".7 300.1.1.1"))


def _whole(rows, incident, seq, n, known):
    """The texts as they are, with the tail, under their incident; ``markers`` is that of the whole incident."""
    out, marks = redact(rows.withColumn("text", F.concat("text", _tail(n))), incident, seq, "text", known)
    count = marks.groupBy(incident).agg(F.count("*").cast("int").alias("markers"))
    return out.join(count, incident, "left").withColumn("digest", F.md5("text")).withColumn("markers", F.coalesce("markers", F.lit(0)))


# no SQL: identifiers of any shape stand anywhere in these texts, and a value keeps its number over all turns of a conversation; tests hold them against a plain reading
@query("f19_redacted_whole_conversations")
def _(t):
    c = t.read("conversations").select("conv_id", "turn", "text")
    return _whole(c, "conv_id", "turn", F.col("conv_id") * 10 + F.col("turn"), _known(t)).select("conv_id", "turn", "digest", "markers")


@query("f19_redacted_whole_documents")
def _(t):
    d = t.read("documents").select("doc_id", F.lit(0).cast("bigint").alias("part"), "text")
    return _whole(d, "doc_id", "part", F.col("doc_id"), _known(t)).select("doc_id", "digest", "markers")
