"""Logs, spans and traces."""

from pyspark.sql import functions as F

from ..functions.times import as_lit
from ..operators import logs as L
from .base import query, r, text
from .metrics import T0, T1

_W = "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-28'"


@query("p12_log_search", f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, severity, body FROM logs WHERE asset_id = 'asset-4' AND {_W} AND severity_num >= 13
  AND contains(lower(body), 'user 1') AND service_name = 'svc-0'""", "logs")
def _(t):
    return L.search(L.window(t.logs, "asset-4", as_lit(T0), as_lit(T1), "ts"), 13, "USER 1", "svc-0").select("event_id", text("ts"), "severity", "body")


@query("k02_newest_logs", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, body FROM logs WHERE asset_id = 'asset-4' ORDER BY logs.ts DESC, event_id LIMIT 200", "logs")
def _(t):
    return L.newest(t.logs.where("asset_id = 'asset-4'"), "ts", 200, "event_id").select("event_id", text("ts"), "body")


@query("k02_newest_traces", "SELECT trace_id, strftime(max(end_ts), '%Y-%m-%d %H:%M:%S') AS end_ts, count(*) AS spans FROM spans GROUP BY 1 ORDER BY max(spans.end_ts) DESC, trace_id LIMIT 100", "spans")
def _(t):
    return L.newest(L.trace_summary(t.spans), "end_ts", 100, "trace_id").select("trace_id", text("end_ts"), "spans")


_TRACES = """SELECT trace_id, strftime(min(start_ts), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(max(end_ts), '%Y-%m-%d %H:%M:%S') AS end_ts,
  (epoch_us(max(end_ts)) - epoch_us(min(start_ts))) * 1000 AS duration_ns, count(*) AS spans, count_if(status = 'error') AS errors,
  arg_min(name, start_ts) FILTER (WHERE parent_id = '') AS root, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT unnest(list_distinct(list(service_name))) AS s)) AS services FROM spans GROUP BY 1"""


def _trace_cols(df):
    return df.select("trace_id", text("start_ts"), text("end_ts"), "duration_ns", "spans", "errors", "root", F.array_join("services", ",").alias("services"))


@query("a12_trace_summary", _TRACES.replace("(SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT unnest(list_distinct(list(service_name))) AS s))", "string_agg(DISTINCT service_name, ',' ORDER BY service_name)"), "spans")
def _(t):
    return _trace_cols(L.trace_summary(t.spans))


@query("a12_error_traces", "SELECT trace_id, count(*) AS spans, count_if(status = 'error') AS errors FROM spans GROUP BY 1 HAVING count_if(status = 'error') > 0", "spans")
def _(t):
    return L.trace_summary(t.spans, only_errors=True).select("trace_id", "spans", "errors")


@query("a13_window_counts", """SELECT asset_id, CAST(sum(l) AS BIGINT) AS logs, CAST(sum(le) AS BIGINT) AS error_logs, CAST(sum(s) AS BIGINT) AS spans, CAST(sum(se) AS BIGINT) AS error_spans FROM (
  SELECT asset_id, 1 AS l, CASE WHEN severity_num >= 17 THEN 1 ELSE 0 END AS le, 0 AS s, 0 AS se FROM olog UNION ALL SELECT asset_id, 0, 0, 1, CASE WHEN status = 'error' THEN 1 ELSE 0 END FROM spans) GROUP BY 1""", "olog spans")
def _(t):
    return L.window_counts(t.olog, t.spans, ["asset_id"])


@query("j02_logs_with_spans", """SELECT o_orderkey, strftime(l.ts, '%Y-%m-%d %H:%M:%S') AS ts, l.severity, s.name AS operation, s.duration_ns, s.status AS span_status
  FROM olog l LEFT JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id""", "olog spans")
def _(t):
    return L.correlated(t.olog, t.spans).select("o_orderkey", text("ts"), "severity", "operation", "duration_ns", "span_status")


@query("p23_error_pairs", """SELECT o_orderkey, l.severity, s.status AS span_status FROM olog l LEFT JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id
  WHERE s.status = 'error' OR upper(l.severity) SIMILAR TO '(ERROR|FATAL).*'""", "olog spans")
def _(t):
    return L.error_rows(L.correlated(t.olog, t.spans)).select("o_orderkey", "severity", "span_status")


@query("k03_spans_of_a_trace", "SELECT span_id, parent_id, name, status FROM spans WHERE trace_id = lpad('1234', 32, '0')", "spans")
def _(t):
    return L.spans_in_order(t.spans, "1234".zfill(32)).select("span_id", "parent_id", "name", "status")


@query("p21_trace_ids", "SELECT regexp_matches(trace_id, '^[0-9a-f]{32}$') AS ok, count(*) AS n FROM spans GROUP BY 1", "spans")
def _(t):
    return t.spans.groupBy(F.col("trace_id").rlike("^[0-9a-f]{32}$").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("f14_span_tree", """WITH k AS (SELECT c.trace_id, c.span_id, CASE WHEN p.span_id IS NULL THEN '' ELSE c.parent_id END AS parent FROM spans c LEFT JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id),
  t AS (SELECT trace_id, span_id, 0 AS level FROM k WHERE parent = '' UNION ALL SELECT k.trace_id, k.span_id, t.level + 1 FROM t JOIN k ON k.trace_id = t.trace_id AND k.parent = t.span_id) /* RECURSIVE */
  SELECT trace_id, span_id, level FROM t""", "spans")
def _(t):
    return L.span_tree(t.spans, ordered=False)


@query("f14_span_order", """WITH e AS (SELECT DISTINCT trace_id, span_id, parent_id, start_ts FROM spans), k AS (SELECT c.trace_id, c.span_id, c.start_ts, CASE WHEN p.span_id IS NULL THEN '' ELSE c.parent_id END AS parent FROM e c LEFT JOIN e p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id),
  t AS (SELECT trace_id, span_id, 0 AS level, [epoch_us(start_ts)::VARCHAR || '/' || span_id] AS way FROM k WHERE parent = '' UNION ALL SELECT k.trace_id, k.span_id, t.level + 1, list_append(way, epoch_us(k.start_ts)::VARCHAR || '/' || k.span_id) FROM t JOIN k ON k.trace_id = t.trace_id AND k.parent = t.span_id) /* RECURSIVE */
  SELECT trace_id, span_id, level, row_number() OVER (PARTITION BY trace_id ORDER BY way) - 1 AS path FROM t""", "spans")
def _(t):
    """Every span comes twice, as from a sender that repeats its batches."""
    return L.span_tree(t.spans.unionByName(t.spans))


@query("f15_gantt", """SELECT trace_id, span_id, rnd((epoch_ms(start_ts) - a) / greatest(1, z - a) * 100, 4) AS offset_pct, rnd(greatest(0.5, duration_ns / 1e6 / greatest(1, z - a) * 100), 4) AS width_pct
  FROM (SELECT *, min(epoch_ms(start_ts)) OVER (PARTITION BY trace_id) AS a, max(epoch_ms(end_ts)) OVER (PARTITION BY trace_id) AS z FROM spans)""", "spans")
def _(t):
    return L.gantt(t.spans).select("trace_id", "span_id", r("offset_pct"), r("width_pct"))


@query("s20_span_metrics", """SELECT strftime(date_trunc('day', start_ts), '%Y-%m-%d %H:%M:%S') AS bucket, service_name, name, kind, status, count(*) AS calls, CAST(sum(duration_ns) AS BIGINT) AS duration_ns_sum,
  count_if(duration_ns <= 10000000000) AS le_10000, count_if(duration_ns <= 40000000000) AS le_40000 FROM spans GROUP BY ALL""", "spans")
def _(t):
    return L.span_metrics(t.spans, 86400, (10000, 40000)).withColumn("bucket", text("bucket"))


@query("s18_truth_tee", """SELECT role, count(*) AS n, count_if(t) AS truth FROM (SELECT role, starts_with(body, '{') AND contains(body, '"uid"') AND contains(body, '"evento"') AS t FROM (
  SELECT role, CASE WHEN turn % 2 = 0 THEN '{"uid":"c' || conv_id || '","evento":"inicio"}' ELSE text END AS body FROM conversations)) GROUP BY 1""")
def _(t):
    from ..sources.otlp import is_truth
    c = t.read("conversations")
    body = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"uid":"c'), F.col("conv_id").cast("string"), F.lit('","evento":"inicio"}'))).otherwise(F.col("text"))
    attrs = F.create_map().cast("map<string,string>")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_truth(attrs, body)).alias("truth"))
