"""Sources: the driver tables written as OTLP/JSON, invoices, listings and snapshots, and read back through the parsers."""

from pyspark.sql import functions as F

from ..functions.names import dims_text
from ..operators import catalog, costs
from ..sources import files, otlp, sinks
from .base import query, r, text


def _attr(k, v):
    return F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))


def _batch(t, kind, scope, item, rec):
    """One OTLP batch per event, as JSON text parsed with the fixed schema."""
    res = F.struct(F.array(_attr("host.name", F.concat(F.lit("host-"), F.col("user_id").cast("string"))), _attr("service.name", F.when(F.col("user_id") % 2 == 0, "api").otherwise(""))).alias("attributes"))
    j = F.to_json(F.struct(F.array(F.struct(res.alias("resource"), F.array(F.struct(F.array(rec).alias(item))).alias(scope))).alias(kind)))
    return t.events.select(j.alias("value"))


def _arrival():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


def _metrics_lines(t):
    ns = (F.unix_micros("ts") * 1000).cast("string")
    k, v = F.col("k"), F.col("value")
    dp = lambda **f: F.array(F.struct(F.array(_attr("Slot.Id", (k % 4).cast("string"))).alias("attributes"), ns.alias("timeUnixNano"), *[x.alias(n) for n, x in f.items()]))
    flags = F.when(k % 10 == 0, 1).otherwise(0)
    e = F.col("event_type")
    gauge = F.when(e.isin("view", "click"), F.struct(dp(asDouble=v, flags=flags).alias("dataPoints")))
    total = F.when(e == "signup", F.struct(dp(asInt=F.floor(v).cast("string"), flags=flags).alias("dataPoints")))
    hist = F.when(e == "error", F.struct(dp(count=F.floor(v).cast("string"), sum=F.when(k % 3 != 0, v), flags=flags).alias("dataPoints")))
    m = F.struct(F.concat(F.lit("App."), F.col("event_type")).alias("name"), gauge.alias("gauge"), total.alias("sum"), hist.alias("histogram"))
    return _batch(t, "resourceMetrics", "scopeMetrics", "metrics", m)


def _metrics(t):
    return otlp.metric_rows(otlp.parsed(_metrics_lines(t), "metrics"), _arrival())


_ROWS = """SELECT event_type, user_id, ts, k, CASE event_type WHEN 'signup' THEN floor(value) WHEN 'error' THEN floor(value) ELSE value END AS value, value AS v0, CASE WHEN event_type = 'purchase' OR k % 10 = 0 THEN 'no_value' ELSE 'valid' END AS route
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


@query("s01_metric_rows", f"""SELECT metric, route, slot, count(*) AS n, count_if(f) AS points, rnd(sum(value), 2) AS total FROM (SELECT 'app_' || event_type || CASE WHEN event_type = 'error' AND route = 'valid' THEN '_count' ELSE '' END AS metric, route, CASE WHEN event_type = 'purchase' THEN NULL ELSE k % 4 END AS slot, true AS f, CASE WHEN route = 'valid' THEN value END AS value FROM ({_ROWS})
  UNION ALL SELECT 'app_error_sum', route, k % 4, false, v0 FROM ({_ROWS}) WHERE event_type = 'error' AND route = 'valid' AND k % 3 <> 0) GROUP BY 1, 2, 3""")
def _(t):
    return _metrics(t).groupBy("metric", "route", F.col("dims")["slot_id"].cast("bigint").alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("first").alias("points"), r(F.sum("value"), 2, "total"))


@query("s01_resolved_points", f"""SELECT coalesce(k.asset_id, 'sin_resolver') AS asset_id, CASE WHEN user_id % 2 = 0 THEN 'api' ELSE 'host' END AS service_name, count(*) AS n, count(DISTINCT user_id) AS hosts FROM (SELECT user_id FROM ({_ROWS}) WHERE route = 'valid' UNION ALL SELECT user_id FROM ({_ROWS}) WHERE route = 'valid' AND event_type = 'error' AND k % 3 <> 0) LEFT JOIN keys k ON k.key = 'host-' || user_id GROUP BY 1, 2""", "keys")
def _(t):
    p = otlp.points(_metrics(t), t.keys)
    return p.groupBy("asset_id", "service_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("host_name").alias("hosts"))


@query("s02_log_rows", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, upper(event_type) AS severity, CAST(user_id % 25 AS SMALLINT) AS severity_num, CASE WHEN event_id % 3 = 0 THEN '["' || event_type || '", ' || user_id || ']' WHEN event_id % 3 = 1 THEN '{"a": "' || event_type || '"}' ELSE event_type END AS body,
  lpad(event_id::VARCHAR, 32, '0') AS trace_id FROM events""")
def _(t):
    i, e = F.col("event_id"), F.col("event_type")
    ns = (F.unix_micros("ts") * 1000).cast("string")
    arr = F.when(i % 3 == 0, F.struct(F.array(F.struct(e.alias("stringValue"), F.lit(None).cast("string").alias("intValue")), F.struct(
        F.lit(None).cast("string").alias("stringValue"), F.col("user_id").cast("string").alias("intValue"))).alias("values")))
    kv = F.when(i % 3 == 1, F.struct(F.array(F.struct(F.lit("a").alias("key"), F.struct(e.alias("stringValue")).alias("value"))).alias("values")))
    body = F.struct(F.when(i % 3 == 2, e).alias("stringValue"), arr.alias("arrayValue"), kv.alias("kvlistValue"))
    rec = F.struct(F.when(i % 2 == 0, ns).alias("timeUnixNano"), ns.alias("observedTimeUnixNano"), F.upper(e).alias("severityText"), (F.col("user_id") % 25).cast("int").alias("severityNumber"),
                   body.alias("body"), F.lpad(i.cast("string"), 32, "0").alias("traceId"))
    raw = _batch(t, "resourceLogs", "scopeLogs", "logRecords", rec)
    rows = otlp.log_rows(otlp.parsed(raw, "logs"), _arrival())
    return rows.select(F.col("trace_id").cast("bigint").alias("event_id"), text("ts"), "severity", "severity_num", "body", "trace_id")


@query("s03_span_rows", """SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN user_id % 6 IN (0) THEN 'sin_definir' WHEN user_id % 6 = 1 THEN 'interno' WHEN user_id % 6 = 2 THEN 'servidor' WHEN user_id % 6 = 3 THEN 'cliente' WHEN user_id % 6 = 4 THEN 'productor' ELSE 'consumidor' END AS kind,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'ok' ELSE 'sin_definir' END AS status, CASE WHEN event_id % 4 = 0 THEN 0 ELSE greatest(0, CAST(floor(value) AS BIGINT) - 20) * 1000000 END AS duration_ns FROM events""")
def _(t):
    i, e = F.col("event_id"), F.col("event_type")
    a = F.unix_micros("ts") * 1000
    z = F.when(i % 4 != 0, (a + (F.floor("value").cast("bigint") - 20) * 1000000).cast("string"))
    rec = F.struct(F.lpad(i.cast("string"), 32, "0").alias("traceId"), F.lit("AB").alias("spanId"), e.alias("name"), (F.col("user_id") % 6).cast("int").alias("kind"), a.cast("string").alias("startTimeUnixNano"), z.alias("endTimeUnixNano"),
                   F.struct(F.when(e == "error", 2).when(e == "view", 1).otherwise(0).alias("code")).alias("status"))
    raw = _batch(t, "resourceSpans", "scopeSpans", "spans", rec)
    rows = otlp.span_rows(otlp.parsed(raw, "spans"), _arrival())
    return rows.select(F.col("trace_id").cast("bigint").alias("event_id"), "kind", "status", "duration_ns")


@query("s05_last_write", "SELECT metric, count(*) AS n, rnd(sum(value), 2) AS total FROM points GROUP BY 1", "points")
def _(t):
    p = t.points.drop("dims_key", "slot", "event_id").withColumn("date", F.to_date("ts")).withColumn("received_at", F.col("ts"))
    again = p.withColumn("value", F.col("value") - 1).withColumn("received_at", F.col("ts") - F.expr("interval 1 second"))
    return sinks.last_write(p.unionByName(again)).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2, "total"))


# ---------------------------------------------------------------- invoices
def _invoices(t):
    """A file per thousand orders: a header, a line per order, an odd line in some files."""
    o = t.read("orders").join(t.read("customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    f = F.floor(F.col("o_orderkey") / 1000)
    amount = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "$").otherwise(""), F.format_string("%.2f", "o_totalprice"))
    line = F.concat(F.lit("Droplets,group,host-"), F.col("o_custkey").cast("string"), F.lit(","), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss '+0000'"), F.lit(","),
                    F.when(f % 5 == 4, F.when(F.col("o_orderkey") % 1000 == 7, "abc").otherwise(amount)).otherwise(amount))
    g = o.groupBy(f.alias("f")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    csv = F.concat(F.lit("Product,Group_Description,Description,Start,"), F.when(F.col("f") % 2 == 0, "USD").otherwise("Amount"), F.lit("\n"), "body", F.lit("\n\n"))
    content = F.encode(csv, "UTF-8")
    return g.select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("file"), content.alias("content"), F.sha2(content, 256).alias("digest"), F.octet_length(content).alias("bytes"))


_INVOICE = "SELECT *, 'f' || (o_orderkey // 1000) AS file FROM orders WHERE NOT (o_orderkey // 1000 % 5 = 4 AND EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = orders.o_orderkey // 1000 * 1000 + 7))"


@query("s13_invoice_charges", f"SELECT file, count(*) AS lines, CAST(round_even(sum(CAST(o_totalprice AS DECIMAL(14, 4))), 2) AS DOUBLE) AS total, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM ({_INVOICE}) GROUP BY 1")
def _(t):
    c, _ = files.invoice_charges(_invoices(t))
    return c.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.bround(F.sum("amount"), 2).cast("double").alias("total"), F.date_format(F.min("start"), "yyyy-MM-dd").alias("first"))


@query("s13_refused_files", "SELECT 'f' || f AS file, 'line 9: not a number' AS reason FROM (SELECT o_orderkey // 1000 AS f FROM orders WHERE o_orderkey % 1000 = 7) WHERE f % 5 = 4")
def _(t):
    return files.invoice_charges(_invoices(t))[1].select("file", "reason")


@query("s14_new_files", "SELECT DISTINCT 'f' || (o_orderkey // 1000) AS file FROM orders WHERE o_orderkey // 1000 % 3 <> 0")
def _(t):
    f = _invoices(t)
    done = f.where("cast(substring(file, 2) as bigint) % 3 = 0")
    return files.new_files(f.unionByName(f), done.select("digest")).select("file")


@query("s13_attributed_charges", f"SELECT CASE WHEN k.asset_id IS NULL THEN 'none' ELSE 'one' END AS hit, count(*) AS n FROM ({_INVOICE}) o LEFT JOIN (SELECT key, asset_id FROM keys WHERE kind = 'host.name') k ON k.key = 'host-' || o_custkey GROUP BY 1", "keys")
def _(t):
    c, _ = files.invoice_charges(_invoices(t))
    c = c.withColumn("line_id", F.concat_ws("/", "file", F.col("line").cast("string")))
    a = costs.attribute(c, t.keys, "line_id", ["description", "group_text"])
    return a.groupBy(F.when(F.col("asset_id").isNull(), "none").otherwise("one").alias("hit")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- listings
def _pages(t, item, key):
    """Listing pages of 200 customers."""
    c = t.read("customer")
    g = c.groupBy(F.floor(F.col("c_custkey") / 200).alias("page")).agg(F.collect_list(item).alias(key))
    return g.select(F.to_json(F.struct(key)).alias("value"))


@query("s15_provider_listings", """SELECT provider, count(*) AS n, count(DISTINCT native_id) AS ids, min(name) AS first FROM (SELECT 'digitalocean' AS provider, 'droplet/' || c_custkey AS native_id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'proxmox', 'qemu/' || c_custkey, c_name FROM customer WHERE c_nationkey <> 3
  UNION ALL SELECT 'aws', 'instancia/i-' || c_custkey, CASE WHEN c_nationkey < 10 THEN c_name ELSE 'i-' || c_custkey END FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT 'azure', 'vm/' || c_custkey, c_name FROM customer WHERE c_mktsegment = 'HOUSEHOLD') GROUP BY 1""")
def _(t):
    s, seg, nat = F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.col("c_nationkey")
    d = files.droplets(_pages(t, F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(seg).alias("tags")), "droplets"), tag="BUILDING")
    p = files.proxmox_vms(_pages(t, F.struct(F.concat(F.lit("qemu/"), s).alias("id"), F.col("c_name").alias("name"), F.when(nat == 3, 1).otherwise(0).alias("template")), "data"))
    tags = F.array(F.struct(F.lit("Name").alias("Key"), F.when(nat < 10, F.col("c_name")).otherwise("").alias("Value")))
    inst = F.struct(F.array(F.struct(F.concat(F.lit("i-"), s).alias("InstanceId"), F.struct(F.when(seg == "MACHINERY", "terminated").otherwise("running").alias("Name")).alias("State"), tags.alias("Tags"))).alias("Instances"))
    a = files.ec2_instances(_pages(t, inst, "Reservations"))
    z = files.azure_vms(_pages(t, F.struct(F.col("c_name").alias("name"), F.create_map(F.lit("seg"), seg).alias("tags"), F.struct(s.alias("vmId")).alias("properties")), "value"), tag=("seg", "HOUSEHOLD"))
    u = d.unionByName(p).unionByName(a).unionByName(z)
    return u.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("native_id").alias("ids"), F.min("name").alias("first"))


@query("s16_snapshots", "SELECT node, env, strftime(taken_at, '%Y-%m-%d %H:%M:%S') AS taken_at, interval_s, k.asset_id FROM nodes LEFT JOIN (SELECT 'Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') AS key, c_name AS asset_id FROM customer) k ON k.key = node WHERE s_suppkey % 10 NOT IN (1, 2, 3)", "nodes")
def _(t):
    return _snapshots(t)[0].select("node", "env", text("taken_at"), "interval_s", "asset_id")


@query("s16_rejected_snapshots", "SELECT count(*) AS rejected FROM supplier WHERE s_suppkey % 10 IN (1, 2, 3)")
def _(t):
    return _snapshots(t)[1].agg(F.count(F.lit(1)).alias("rejected"))


def _snapshots(t):
    bad = F.col("seq") % 10
    j = F.to_json(F.struct(
        F.col("node").alias("nodo"), F.col("env").alias("entorno"), F.when(bad == 1, "yesterday").otherwise(F.date_format("taken_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("tomada_en"), F.col("agent_version").alias("version_agente"),
        F.when(bad == 2, 0).otherwise(F.col("interval_s")).alias("intervalo_muestreo_s"),
        F.transform("ports", lambda p: F.struct(F.when(bad == 3, 70000).otherwise(p["puerto"]).alias("puerto"), p["protocolo"].alias("protocolo"), p["direccion"].alias("direccion"), p["proceso"].alias("proceso"))).alias("puertos"),
        F.col("containers").alias("contenedores")))
    keys = t.read("customer").select(F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("key"), F.col("c_name").alias("asset_id"))
    return files.snapshots(t.snapshots.select(j.alias("line"), "seq"), "line", keys, F.col("seq"))


@query("s17_truth_events", """SELECT 'c' || conv_id AS uid, CASE WHEN turn % 2 = 0 THEN 'inicio' ELSE 'fin' END AS event, count(*) AS n, count(CASE WHEN conv_id % 2 = 0 THEN 1 END) AS resolved FROM conversations GROUP BY 1, 2""")
def _(t):
    c = t.read("conversations")
    even = F.col("turn") % 2 == 0
    body = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("uid"), F.when(even, "inicio").otherwise("fin").alias("evento"), F.col("text").alias("motivo")))
    logs = c.select(F.explode(F.array(body, F.col("text"), F.lit('{"uid":"x","evento":"otro"}'))).alias("body"), F.when(F.col("conv_id") % 2 == 0, "a1").otherwise("sin_resolver").alias("asset_id"), "turn")
    return otlp.truth_events(logs, F.col("turn")).groupBy("uid", "event").agg(F.count(F.lit(1)).alias("n"), F.count("asset_id").alias("resolved"))


@query("s08_reject_lines", "SELECT count(*) AS broken FROM documents")
def _(t):
    """Document texts are no OTLP batches: every one of them is a reject."""
    d = otlp.parsed(t.read("documents"), "metrics", "text")
    return d.agg(F.count("_corrupt_record").alias("broken"))
