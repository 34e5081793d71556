"""Catalogue, ledgers, sources, orphans."""

from pyspark.sql import functions as F

from ..operators import catalog, health
from ..schema import TERMINAL_STATES
from .base import query, r, text

AS_OF = "2024-01-30 12:00:00"


def _now():
    return F.to_timestamp(F.lit(AS_OF))


def _resources(t):
    """One resource per user: host.id only for some, host.name for all but a few."""
    u = F.col("user_id")
    s = u.cast("string")
    return t.events.select("event_id", F.map_filter(F.map_from_arrays(
        F.array(F.lit("host.id"), F.lit("host.name"), F.lit("service.name")),
        F.array(F.when(u % 4 == 0, F.concat(F.lit("machine:vm/"), s)), F.when(u % 11 != 0, F.concat(F.lit("host-"), s)), F.when(u % 2 == 0, F.concat(F.lit("svc-"), s)))),
        lambda k, v: v.isNotNull()).alias("attrs"))


@query("j01_identity", """SELECT event_id, coalesce(k.asset_id, h.asset_id, 'sin_resolver') AS asset_id, CASE WHEN user_id % 11 <> 0 THEN 'host-' || user_id ELSE 'desconocido' END AS host_name,
  CASE WHEN user_id % 2 = 0 THEN 'svc-' || user_id ELSE 'host' END AS service_name, coalesce(k.asset_id, h.asset_id) IS NULL AS orphan,
  CASE WHEN k.asset_id IS NOT NULL THEN 'host.id' WHEN h.asset_id IS NOT NULL THEN 'host.name' WHEN user_id % 4 = 0 THEN 'host.id' WHEN user_id % 11 <> 0 THEN 'host.name' END AS key_name
  FROM events LEFT JOIN keys k ON user_id % 4 = 0 AND k.key = 'machine:vm/' || user_id AND k.key LIKE 'machine%' LEFT JOIN keys h ON user_id % 11 <> 0 AND h.key = 'host-' || user_id""", "keys")
def _(t):
    return catalog.resolve(_resources(t), t.keys).select("event_id", "asset_id", "host_name", "service_name", "orphan", "key_name")


@query("j06_assets_with_keys", "SELECT a.asset_id, coalesce(string_agg(k.key, ',' ORDER BY k.key), '') AS keys FROM assets a LEFT JOIN keys k USING (asset_id) GROUP BY 1", "assets keys")
def _(t):
    return catalog.with_keys(t.assets, t.keys).select("asset_id", F.array_join("keys", ",").alias("keys"))


def _orphans(t):
    a = t.arrivals
    return health.orphan_deltas(a.select(F.regexp_replace("host_name", "node-", "host-").alias("key"), F.lit("host.name").alias("key_type"), "provider", "signal", "received_at", F.col("received").alias("n")))


_ORPH = """SELECT 'host-' || substring(host_name, 6) AS key, arg_max(provider, received_at) FILTER (WHERE provider IS NOT NULL) AS provider, CAST(sum(CASE WHEN signal = 'metricas' THEN received ELSE 0 END) AS BIGINT) AS metrics,
  CAST(sum(CASE WHEN signal = 'registros' THEN received ELSE 0 END) AS BIGINT) AS logs, CAST(sum(CASE WHEN signal = 'trazas' THEN received ELSE 0 END) AS BIGINT) AS traces, min(received_at) AS first_seen, max(received_at) AS last_seen FROM arrivals GROUP BY 1"""


@query("a15_orphan_ledger", f"SELECT key, provider, metrics, logs, traces, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM ({_ORPH})", "arrivals")
def _(t):
    return _orphans(t).select("key", "provider", "metrics", "logs", "traces", text("first_seen"), text("last_seen"))


@query("u03_merged_orphans", f"SELECT key, 2 * metrics AS metrics, 2 * logs AS logs, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, true AS pending FROM ({_ORPH})", "arrivals")
def _(t):
    d = _orphans(t)
    state = d.withColumn("associated_to", F.lit("x"))
    return health.merge_orphans(state, d).select("key", "metrics", "logs", text("last_seen"), F.col("associated_to").isNull().alias("pending"))


@query("j07_resolvable_orphans", f"SELECT o.key, k.asset_id AS resolves_to FROM ({_ORPH}) o LEFT JOIN keys k USING (key)", "arrivals keys")
def _(t):
    return catalog.resolvable(_orphans(t), t.keys).select("key", "resolves_to")


@query("j07_pending_orphans", f"SELECT o.key, k.asset_id AS resolves_to FROM ({_ORPH}) o JOIN keys k USING (key)", "arrivals keys")
def _(t):
    return catalog.resolvable(_orphans(t), t.keys, pending_only=True).select("key", "resolves_to")


_SRC = """SELECT asset_id, host_name, signal, arg_max(provider, received_at) FILTER (WHERE provider IS NOT NULL) AS provider, min(received_at) AS first_seen, max(received_at) FILTER (WHERE received > 0) AS last_seen,
  CAST(sum(received) AS BIGINT) AS received, CAST(sum(errors) AS BIGINT) AS errors FROM arrivals GROUP BY 1, 2, 3"""


@query("a14_source_ledger", f"SELECT asset_id, host_name, signal, provider, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, received, errors FROM ({_SRC})", "arrivals")
def _(t):
    return health.source_deltas(t.arrivals).select("asset_id", "host_name", "signal", "provider", text("first_seen"), text("last_seen"), "received", "errors")


@query("u02_merged_sources", f"SELECT asset_id, host_name, signal, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, received, errors FROM ({_SRC})", "arrivals")
def _(t):
    half = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    a = health.source_deltas(t.arrivals.where(F.col("received_at") < half))
    b = health.source_deltas(t.arrivals.where(F.col("received_at") >= half))
    return health.merge_sources(a, b).select("asset_id", "host_name", "signal", text("last_seen"), "received", "errors")


_VOL = """SELECT asset_id, host_name, signal, CAST(sum(CASE WHEN received_at >= TIMESTAMP '2024-01-30 11:55:00' AND errors = 0 THEN received ELSE 0 END) AS BIGINT) AS received_5min, CAST(sum(errors) AS BIGINT) AS errors_1h
  FROM arrivals WHERE received_at >= TIMESTAMP '2024-01-30 11:00:00' GROUP BY 1, 2, 3"""


def _volume(t):
    i = t.arrivals.select("asset_id", "host_name", "signal", F.col("received_at").alias("ts"), F.when(F.col("errors") > 0, "errores").otherwise("recibidas").alias("kind"),
                          F.when(F.col("errors") > 0, F.col("errors")).otherwise(F.col("received")).alias("value"))
    return health.volume(i, _now())


@query("a09_source_volume", _VOL, "arrivals")
def _(t):
    return _volume(t)


@query("j08_sources", f"""SELECT s.asset_id, s.host_name, count(*) AS signals, strftime(coalesce(max(last_seen) FILTER (WHERE s.signal = 'metricas'), max(last_seen)), '%Y-%m-%d %H:%M:%S') AS last_seen,
  CASE WHEN coalesce(max(last_seen) FILTER (WHERE s.signal = 'metricas'), max(last_seen)) IS NULL THEN 'sin_datos' WHEN TIMESTAMP '{AS_OF}' - coalesce(max(last_seen) FILTER (WHERE s.signal = 'metricas'), max(last_seen)) > INTERVAL 5 MINUTE THEN 'degradado' ELSE 'ok' END AS state,
  CAST(sum(coalesce(v.errors_1h, 0)) AS BIGINT) AS errors_1h FROM ({_SRC}) s LEFT JOIN ({_VOL}) v ON s.asset_id = v.asset_id AND s.host_name = v.host_name AND s.signal = v.signal GROUP BY 1, 2""", "arrivals")
def _(t):
    return health.sources(health.source_deltas(t.arrivals), _volume(t), _now()).select("asset_id", "host_name", F.size("signals").alias("signals"), text("last_seen"), "state", "errors_1h")


@query("j10_sources_with_silent_assets", f"""SELECT asset_id, host_name, state FROM (SELECT asset_id, host_name, CASE WHEN TIMESTAMP '{AS_OF}' - coalesce(max(last_seen) FILTER (WHERE signal = 'metricas'), max(last_seen)) > INTERVAL 5 MINUTE THEN 'degradado' ELSE 'ok' END AS state
  FROM ({_SRC}) GROUP BY 1, 2) UNION ALL SELECT DISTINCT 'u' || (c_custkey % 70), NULL, 'sin_datos' FROM customer WHERE 'u' || (c_custkey % 70) NOT IN (SELECT asset_id FROM arrivals)""", "arrivals")
def _(t):
    src = health.sources(health.source_deltas(t.arrivals), _volume(t), _now())
    a = t.read("customer").select(F.concat(F.lit("u"), (F.col("c_custkey") % 70).cast("string")).alias("asset_id"), F.lit("activo").alias("state")).distinct()
    return health.source_list(src, a).select("asset_id", "host_name", "state")


@query("a16_last_reception", f"SELECT asset_id, strftime(coalesce(max(last_seen) FILTER (WHERE signal = 'metricas'), max(last_seen)), '%Y-%m-%d %H:%M:%S') AS last_seen FROM ({_SRC}) GROUP BY 1", "arrivals")
def _(t):
    return health.last_reception(health.source_deltas(t.arrivals)).select("asset_id", text("last_seen"))


@query("a17_source_states", f"SELECT state, count(*) AS n, rnd(sum(m), 0) AS minutes FROM (SELECT CASE WHEN last_seen IS NULL THEN 'sin_datos' WHEN TIMESTAMP '{AS_OF}' - last_seen > INTERVAL 5 MINUTE THEN 'degradado' ELSE 'ok' END AS state, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_seen)) / 60000000 AS m FROM ({_SRC})) GROUP BY 1", "arrivals")
def _(t):
    s = health.source_deltas(t.arrivals).withColumn("state", health.state_of(F.col("last_seen"), _now()))
    m = (F.unix_micros(_now()) - F.unix_micros("last_seen")) / 60000000
    return s.groupBy("state").agg(F.count(F.lit(1)).alias("n"), r(F.sum(m), 0, "minutes"))


@query("a18_open_incidents", "SELECT asset_id, count(*) AS open_incidents FROM anomalies WHERE \"end\" IS NULL AND state NOT IN ('cerrada', 'falso_positivo') GROUP BY 1", "anomalies")
def _(t):
    return health.open_incidents(t.anomalies, TERMINAL_STATES)


@query("j09_inventory", f"""SELECT a.asset_id, CASE WHEN a.state = 'retirado' THEN 'retirado' WHEN l.last_seen IS NULL THEN 'sin_datos' WHEN TIMESTAMP '{AS_OF}' - l.last_seen > INTERVAL 36 HOUR THEN 'degradado' WHEN coalesce(o.n, 0) > 0 THEN 'atencion' ELSE 'ok' END AS health,
  coalesce(o.n, 0) AS open_incidents, rnd(c.busy, 4) AS cpu_busy FROM (SELECT 'u' || c_custkey AS asset_id, CASE WHEN c_acctbal < 500 THEN 'retirado' ELSE 'activo' END AS state FROM customer) a
  LEFT JOIN (SELECT 'u' || user_id AS asset_id, max(ts) AS last_seen FROM events GROUP BY 1) l USING (asset_id) LEFT JOIN (SELECT asset_id, count(*) AS n FROM anomalies WHERE "end" IS NULL AND state NOT IN ('cerrada', 'falso_positivo') GROUP BY 1) o USING (asset_id)
  LEFT JOIN (SELECT 'u' || user_id AS asset_id, avg(value) / 500 AS busy FROM events GROUP BY 1) c USING (asset_id)""", "anomalies")
def _(t):
    uid = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("asset_id")
    # the rule is five minutes; the ledger is moved on by the rest of the 36 hours, as these tables are sparse
    ledger = t.events.select(uid, F.lit("metricas").alias("signal"), (F.col("ts") + F.expr("interval 36 hours") - F.expr("interval 5 minutes")).alias("last_seen"))
    a = t.read("customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("asset_id"), F.when(F.col("c_acctbal") < 500, "retirado").otherwise("activo").alias("state"))
    cpu = t.events.groupBy(uid).agg((F.avg("value") / 500).alias("cpu_busy"))
    inc = health.open_incidents(t.anomalies, TERMINAL_STATES)
    return health.inventory(a, ledger, inc, cpu, _now()).select("asset_id", "health", "open_incidents", r("cpu_busy"))


@query("a19_header_counts", "SELECT state, provider, count(*) AS n, CAST(GROUPING(provider) AS BIGINT) AS all_rows FROM assets GROUP BY GROUPING SETS ((state), (provider, state))", "assets")
def _(t):
    return health.header_counts(t.assets, "state", "provider").select("state", "provider", "n", F.col("all_rows").cast("bigint").alias("all_rows"))


@query("p22_visible_assets", "SELECT asset_id, name FROM assets WHERE provider = 'machinery' AND state = 'activo' AND (contains(lower(name), 'host-1') OR contains(lower(asset_id), 'host-1'))", "assets")
def _(t):
    return health.visible(t.assets, text="HOST-1", search_in=("asset_id", "name"), provider="machinery", state="activo", env=None).select("asset_id", "name")


@query("f23_known_identifiers", """SELECT value, arg_min(kind, p) AS kind FROM (SELECT asset_id AS value, 1 AS p, 'ACTIVO' AS kind FROM assets UNION ALL SELECT name, 2, 'ANFITRION' FROM assets
  UNION ALL SELECT key, 3, CASE WHEN contains(key, ':') THEN 'ID' ELSE 'ANFITRION' END FROM keys) GROUP BY 1""", "assets keys")
def _(t):
    return catalog.known_identifiers(t.assets, t.keys)


@query("s19_providers_of_ids", "SELECT CASE n_nationkey % 5 WHEN 0 THEN 'digitalocean' WHEN 1 THEN 'aws' WHEN 2 THEN 'azure' WHEN 3 THEN 'proxmox' ELSE 'desconocido' END AS provider, count(*) AS n FROM nation GROUP BY 1")
def _(t):
    p = F.element_at(F.array(*[F.lit(x) for x in ("do", "aws", "azure", "onprem", "x")]), F.col("n_nationkey") % 5 + 1)
    return t.read("nation").groupBy(catalog.provider_of(F.concat(F.lit("activo-"), p, F.lit("-"), "n_name")).alias("provider")).agg(F.count(F.lit(1)).alias("n"))


def _state(t):
    """Known assets: customers with a balance; keys: their native key, and the host name of the richer ones."""
    c = t.read("customer").where("c_acctbal >= 0")
    s = F.col("c_custkey").cast("string")
    a = c.select(F.concat(F.lit("activo-do-c-"), s).alias("asset_id"), F.concat(F.lit("c "), s).alias("name"), F.lit("digitalocean").alias("provider"), F.lit("nyc").alias("region"), F.lit("lab").alias("env"),
                 F.lit("descubrimiento").alias("origin"), F.when(F.col("c_acctbal") > 9000, "retirado").otherwise("activo").alias("state"), (F.col("c_custkey") % 3).cast("int").alias("absences"),
                 F.lit(None).cast("timestamp").alias("seen_at"), F.lit(None).cast("timestamp").alias("retired_at"))
    k = c.select(F.concat(F.lit("digitalocean:droplet/"), s).alias("key"), F.concat(F.lit("activo-do-c-"), s).alias("asset_id"), F.lit("nativo").alias("kind"), F.lit("digitalocean").alias("provider"))
    h = c.where("c_acctbal >= 3000").select(F.concat(F.lit("c "), s).alias("key"), F.concat(F.lit("activo-do-c-"), s).alias("asset_id"), F.lit("host.name").alias("kind"), F.lit("digitalocean").alias("provider"))
    return a, k.unionByName(h)


def _listing(t):
    c = t.read("customer").where("c_mktsegment <> 'BUILDING'")
    s = F.col("c_custkey").cast("string")
    return c.select(F.col("c_custkey").alias("ord"), F.concat(F.lit("droplet/"), s).alias("native_id"), F.concat(F.lit("c "), s).alias("name"), F.lit("sfo").alias("region"), F.lit(None).cast("string").alias("env"))


@query("u01_reconciled_assets", """SELECT 'activo-do-c-' || c_custkey AS asset_id, CASE WHEN hit OR known THEN 'c ' || c_custkey END AS name, CASE WHEN hit THEN 'sfo' ELSE 'nyc' END AS region, CASE WHEN known THEN 'lab' END AS env,
  CASE WHEN hit THEN 'activo' WHEN st = 'activo' AND ab + 1 >= 3 THEN 'retirado' ELSE st END AS state, CASE WHEN hit THEN 0 WHEN st = 'activo' THEN ab + 1 ELSE ab END AS absences FROM (SELECT c_custkey, c_mktsegment <> 'BUILDING' AS hit, c_acctbal >= 0 AS known,
  CASE WHEN c_acctbal > 9000 THEN 'retirado' ELSE 'activo' END AS st, CAST(c_custkey % 3 AS INTEGER) AS ab FROM customer) WHERE hit OR known""")
def _(t):
    a, k = _state(t)
    out = catalog.reconcile(a, k, _listing(t), "digitalocean", _now())
    return out["assets"].select("asset_id", "name", "region", "env", "state", "absences")


@query("a45_pass_counts", """SELECT count_if(hit) AS seen, count_if(hit AND NOT known) AS new, count_if(NOT hit AND known AND st = 'activo' AND ab + 1 >= 3) AS retired, count_if(hit AND known AND st = 'retirado') AS reactivated, 0 AS conflicts
  FROM (SELECT c_mktsegment <> 'BUILDING' AS hit, c_acctbal >= 0 AS known, CASE WHEN c_acctbal > 9000 THEN 'retirado' ELSE 'activo' END AS st, c_custkey % 3 AS ab FROM customer)""")
def _(t):
    a, k = _state(t)
    return catalog.reconcile(a, k, _listing(t), "digitalocean", _now())["result"]


@query("u07_manual_admission", """SELECT count(*) AS conflicts FROM customer WHERE c_acctbal >= 3000 AND c_acctbal < 6000""")
def _(t):
    a, k = _state(t)
    c = t.read("customer")
    s = F.col("c_custkey").cast("string")
    wanted = c.select(F.concat(F.lit("c "), s).alias("key"), F.when(F.col("c_acctbal") < 6000, F.concat(F.lit("other-"), s)).otherwise(F.concat(F.lit("activo-do-c-"), s)).alias("asset_id"),
                      F.lit("digitalocean").alias("provider"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("env"))
    return catalog.admit(a, k, wanted)["conflicts"].agg(F.count(F.lit(1)).alias("conflicts"))


@query("w18_latest_rows", "SELECT provider, run_id FROM (SELECT o_orderpriority AS provider, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(t):
    return catalog.latest_runs(t.read("orders").select(F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started"))).select("provider", "run_id")


@query("k07_recent_runs", "SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def _(t):
    return t.read("orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select(F.col("o_orderkey").alias("run_id"))


@query("u05_reassigned", """SELECT asset_id, reassigned, count(*) AS n FROM (SELECT CASE WHEN k.asset_id IS NOT NULL AND e.event_type <> 'view' THEN k.asset_id WHEN e.event_type <> 'view' THEN 'sin_resolver' ELSE 'done' END AS asset_id,
  k.asset_id IS NOT NULL AND e.event_type <> 'view' AS reassigned FROM events e LEFT JOIN (SELECT key, asset_id FROM keys WHERE kind = 'host.name') k ON k.key = 'host-' || e.user_id) GROUP BY 1, 2""", "keys")
def _(t):
    rows = t.events.select(F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host_name"), F.when(F.col("event_type") == "view", "done").otherwise("sin_resolver").alias("asset_id"),
                           "ts", "event_id", "value", F.lit(False).alias("reassigned"))
    pending = t.keys.where("kind = 'host.name'").select(F.col("key").alias("host_name"), F.col("asset_id").alias("new_asset"))
    once = catalog.reassign(rows, pending, ["ts", "event_id"])
    return catalog.reassign(once, pending, ["ts", "event_id"]).groupBy("asset_id", "reassigned").agg(F.count(F.lit(1)).alias("n"))


@query("j23_series_with_source_health", f"""SELECT count(*) AS buckets, any_value(l.state) = 'degradado' AS source_degraded, strftime(any_value(l.last_seen), '%Y-%m-%d %H:%M:%S') AS source_last_seen FROM (SELECT DISTINCT metric, date_trunc('hour', ts) AS b FROM points WHERE asset_id = 'asset-3'),
  (SELECT max(ts) AS last_seen, CASE WHEN TIMESTAMP '{AS_OF}' - max(ts) > INTERVAL 5 MINUTE THEN 'degradado' ELSE 'ok' END AS state FROM points WHERE asset_id = 'asset-3') l""", "points")
def _(t):
    from ..operators import series
    mine = t.points.where("asset_id = 'asset-3'").select("metric", F.date_trunc("hour", "ts").alias("b")).distinct().agg(F.count(F.lit(1)).alias("buckets"))
    led = health.last_reception(t.points.select("asset_id", F.lit("metricas").alias("signal"), F.col("ts").alias("last_seen")))
    out = series.with_health(mine, led.withColumn("state", health.state_of(F.col("last_seen"), _now())), "asset-3")
    return out.select("buckets", "source_degraded", text("source_last_seen"))
