"""The query registry and the views that give the driver tables their telemetry roles.

Every view is written twice: as a DataFrame and as SQL for the checker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import bucket, iso_text
from ..operators import rollup
from ..session import pin_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR, DAY = 3600, 86400


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(t)``; ``views`` names the SQL views the checker's text needs."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = tie_safe(with_views(views.split(), sql))
        return fn
    return deco


def tie_safe(sql: str) -> str:
    """``rnd(x, n)`` to ``round((x) + 1e-9, n)``: exact ties (means of two-decimal values) round the same way in both engines."""
    while (at := sql.find("rnd(")) >= 0:
        depth, comma, i = 1, None, at + 4
        while depth:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = i
            i += 1
        sql = f"{sql[:at]}round(({sql[at + 4:comma]}) + 1e-9,{sql[comma + 1:i]}{sql[i:]}"
    return sql


def with_views(names: list[str], sql: str) -> str:
    order: list[str] = []

    def add(n):
        for d in NEEDS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    if not order:
        return sql
    head = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
    body = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    sql = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{head}{body},\n{sql[len(start):]}"
    return f"{head}{body}\n{sql}"


VIEWS = {
    # events as metric points
    "points": """SELECT event_id, event_type AS metric, ts, value, 'asset-' || (user_id % 10) AS asset_id, 'node-' || (user_id % 10) AS host_name,
        'svc-' || (user_id % 2) AS service_name, 'slot' AS dim, (CAST(json_extract_string(props, '$.k') AS BIGINT) % 4)::VARCHAR AS slot FROM events""",
    "hours": """SELECT metric, asset_id, host_name, service_name, slot, date_trunc('hour', ts) AS bucket, avg(value) AS value_avg, min(value) AS value_min,
        max(value) AS value_max, count(value)::DOUBLE AS value_count FROM points GROUP BY ALL""",
    "hourly": "SELECT asset_id, metric, date_trunc('hour', ts) AS bucket, avg(value) AS value FROM points GROUP BY ALL",
    "counter": """SELECT asset_id, metric, bucket, sum(s) OVER (PARTITION BY asset_id, metric ORDER BY bucket) AS value
        FROM (SELECT asset_id, metric, date_trunc('hour', ts) AS bucket, sum(value) AS s FROM points GROUP BY ALL)""",
    # events as logs
    "logs": """SELECT event_id, ts, 'asset-' || (user_id % 10) AS asset_id, 'svc-' || (user_id % 2) AS service_name,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS severity,
        CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 13 ELSE 9 END AS severity_num,
        event_type || ' of user ' || user_id || ' ' || props AS body FROM events""",
    # lineitem and orders as spans, one per (order, line)
    "spans": """SELECT lpad(l_orderkey::VARCHAR, 32, '0') AS trace_id, lpad(l_linenumber::VARCHAR, 16, '0') AS span_id,
        CASE WHEN l_linenumber = 1 THEN '' ELSE lpad((l_linenumber // 2)::VARCHAR, 16, '0') END AS parent_id, 'op-' || l_linenumber AS name,
        o_orderdate + to_seconds(CAST(l_linenumber * 10 AS BIGINT)) AS start_ts,
        o_orderdate + to_seconds(CAST(l_linenumber * 10 + sum(l_quantity) AS BIGINT)) AS end_ts,
        CAST(sum(l_quantity) AS BIGINT) * 1000000000 AS duration_ns, CASE WHEN max(l_returnflag) = 'R' THEN 'error' ELSE 'ok' END AS status,
        'svc-' || min(l_linestatus) AS service_name, 'servidor' AS kind, 'asset-' || (o_custkey % 10) AS asset_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber, o_orderdate, o_custkey""",
    "olog": """SELECT o_orderkey, o_orderdate + INTERVAL 11 SECOND AS ts, 'asset-' || (o_custkey % 10) AS asset_id, lpad(o_orderkey::VARCHAR, 32, '0') AS trace_id,
        lpad('1', 16, '0') AS span_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'ERROR' ELSE 'INFO' END AS severity,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 17 ELSE 9 END AS severity_num, o_orderpriority AS body FROM orders""",
    # events as faults and anomalies, per user
    "injections": """SELECT 'p' || event_id AS uid, CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'memoria'
        WHEN 2 THEN 'caida' ELSE 'latencia' END AS type, 'u' || user_id AS asset_id, ts AS "start",
        CASE WHEN value >= 4 THEN ts + INTERVAL 20 HOUR END AS "end", CASE WHEN value >= 10 THEN 'completada' ELSE 'fallida' END AS state
        FROM events WHERE event_type = 'purchase'""",
    "anomalies": """SELECT event_id::VARCHAR AS anomaly_id, 'u' || user_id AS asset_id, 'm' || (event_id % 5) AS metric, ts AS "start",
        CASE WHEN value >= 20 THEN ts + INTERVAL 1 HOUR END AS "end",
        CASE WHEN value > 120 THEN 'falso_positivo' WHEN value >= 20 THEN 'cerrada' WHEN value > 10 THEN 'diagnosticada' ELSE 'detectada' END AS state,
        CASE WHEN value > 100 THEN 'alta' WHEN value > 30 THEN 'media' ELSE 'baja' END AS severity, value AS score,
        CASE WHEN value > 2 THEN 'mad-v2 W=60' ELSE 'mad-v1' END AS model_version, ts + to_seconds(CAST(floor(value) AS BIGINT)) AS detected_at
        FROM events WHERE event_type = 'error'""",
    "diagnoses": """SELECT event_id AS diagnosis_id, (event_id - 1)::VARCHAR AS anomaly_id, ts AS generated, 'model-' || (user_id % 3) AS model,
        CAST(floor(value) AS BIGINT) AS tokens_in, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_out FROM events WHERE event_type IN ('view', 'click')""",
    "judged": """SELECT a.*, h.uid, h.type AS inj_type, h.inj_start, CASE WHEN h.uid IS NOT NULL THEN 'correcta' WHEN r.reason IS NOT NULL THEN 'ignorada' ELSE 'falso_positivo' END AS verdict,
        CASE WHEN h.uid IS NULL THEN r.reason END AS reason FROM anomalies a
        LEFT JOIN (SELECT anomaly_id, arg_max(i.uid, (i."start", i.uid)) AS uid, arg_max(i.type, (i."start", i.uid)) AS type, max(i."start") AS inj_start FROM anomalies a
          JOIN injections i ON a.asset_id = i.asset_id AND a."start" >= i."start" AND a."start" <= coalesce(i."end", i."start") + INTERVAL 5 MINUTE
          WHERE i.state = 'completada' AND i.type <> 'latencia' GROUP BY 1) h USING (anomaly_id)
        LEFT JOIN (SELECT anomaly_id, arg_max(CASE WHEN i.state = 'completada' THEN i.type || ', fuera del alcance' ELSE 'inyeccion ' || i.state END, (i."start", i.uid)) AS reason
          FROM anomalies a JOIN injections i ON a.asset_id = i.asset_id AND a."start" >= i."start" AND a."start" <= coalesce(i."end", i."start") + INTERVAL 5 MINUTE
          WHERE NOT (i.state = 'completada' AND i.type <> 'latencia') GROUP BY 1) r USING (anomaly_id)""",
    # customers as assets, orders as charges
    "assets": """SELECT c_name AS asset_id, 'host-' || c_custkey AS name, lower(c_mktsegment) AS provider, n_name AS env,
        CASE WHEN c_acctbal < 500 THEN 'retirado' ELSE 'activo' END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0""",
    "keys": """SELECT 'host-' || c_custkey AS key, c_name AS asset_id, 'host.name' AS kind, lower(c_mktsegment) AS provider FROM customer WHERE c_acctbal >= 0
        UNION ALL SELECT lower(c_mktsegment) || ':vm/' || c_custkey, c_name, 'nativo', lower(c_mktsegment) FROM customer WHERE c_acctbal >= 2000""",
    "charges": """SELECT o_orderkey, CASE WHEN c_acctbal >= 0 THEN c_name END AS asset_id, CASE WHEN o_orderpriority <= '2' THEN 'aws' ELSE 'digitalocean' END AS provider,
        CAST(o_totalprice AS DECIMAL(14, 4)) AS amount, CAST(o_orderdate AS DATE) AS "start", CAST(o_orderdate AS DATE) + 30 AS "end",
        'factura ' || o_orderstatus AS source FROM orders JOIN customer ON o_custkey = c_custkey""",
    # source arrivals
    "arrivals": """SELECT 'u' || (user_id % 50) AS asset_id, 'node-' || user_id AS host_name, CASE event_type WHEN 'view' THEN 'metricas' WHEN 'click' THEN 'registros' ELSE 'trazas' END AS signal,
        CASE WHEN user_id % 7 <> 0 THEN 'prov-' || (user_id % 3) END AS provider, ts AS received_at, CAST(floor(value) AS BIGINT) AS received,
        CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors FROM events""",
    # suppliers as nodes with containers and ports
    "nodes": """SELECT s_name AS node, CASE WHEN s_nationkey < 8 THEN 'plataforma' ELSE 'lab' END AS env, CASE WHEN s_acctbal > 0 THEN 'activo-' || s_suppkey END AS asset_id,
        TIMESTAMP '2024-01-01' + to_days(s_nationkey) AS taken_at, s_suppkey AS seq, CASE WHEN s_nationkey = 3 THEN '' ELSE 'v' || (s_nationkey // 10) END AS agent_version,
        CASE WHEN s_nationkey = 5 THEN 30 ELSE 10 END AS interval_s, s_suppkey FROM supplier""",
    "parts_on": "SELECT DISTINCT l_suppkey, p_type, p_size, p_brand, p_name, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey",
    "ports": """SELECT DISTINCT node, env, coalesce(asset_id, node) AS asset, taken_at, CASE p_size % 6 WHEN 0 THEN 22 WHEN 1 THEN 5432 WHEN 2 THEN 443 WHEN 3 THEN 8080 WHEN 4 THEN 9000 ELSE 4317 END AS puerto,
        CASE WHEN l_linestatus = 'O' AND p_size < 25 THEN '0.0.0.0' ELSE '127.0.0.1' END AS direccion FROM nodes JOIN parts_on ON s_suppkey = l_suppkey""",
    "containers": """SELECT DISTINCT node, env, coalesce(asset_id, node) AS asset, taken_at, p_name AS nombre, lower(p_type) AS imagen, CASE WHEN p_size < 3 THEN '' ELSE (p_size % 3)::VARCHAR END AS version,
        CASE WHEN p_brand = 'Brand#1' THEN 'root:root' WHEN p_brand = 'Brand#2' THEN '0' ELSE 'app' END AS usuario FROM nodes JOIN parts_on ON s_suppkey = l_suppkey""",
}
NEEDS = {"hours": ("points",), "hourly": ("points",), "counter": ("points",), "judged": ("anomalies", "injections"),
         "ports": ("nodes", "parts_on"), "containers": ("nodes", "parts_on")}


class Tables:
    """The driver tables and their views, read lazily, only the columns a query uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        pin_utc(spark)
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
            "k", F.get_json_object("props", "$.k").cast("bigint"))

    @cached_property
    def points(self) -> DataFrame:
        u = F.col("user_id")
        tag = lambda p, n: F.concat(F.lit(p), (u % n).cast("string"))
        slot = (F.col("k") % 4).cast("string")
        return self.events.select(
            F.col("event_id"), F.col("event_type").alias("metric"), "ts", (F.unix_micros("ts") * 1000).alias("time_ns"), "value",
            tag("asset-", 10).alias("asset_id"), tag("node-", 10).alias("host_name"), tag("svc-", 2).alias("service_name"),
            F.lit("aws").alias("cloud_provider"), F.lit("r1").alias("cloud_region"), F.lit("lab").alias("deployment_environment"),
            F.create_map(F.lit("slot"), slot).alias("dims"), F.concat(F.lit('{"slot":"'), slot, F.lit('"}')).alias("dims_key"), slot.alias("slot"))

    @cached_property
    def hours(self) -> DataFrame:
        """The fine summary of every full series (one hour on these tables)."""
        return rollup.summarise(self.points, HOUR)

    @cached_property
    def hourly(self) -> DataFrame:
        return self.points.groupBy("asset_id", "metric", bucket(F.col("ts"), HOUR).alias("bucket")).agg(F.avg("value").alias("value"))

    @cached_property
    def counter(self) -> DataFrame:
        from ..operators.ordered import running_sum
        s = self.points.groupBy("asset_id", "metric", bucket(F.col("ts"), HOUR).alias("bucket")).agg(F.sum("value").alias("s"))
        return running_sum(s, ["asset_id", "metric"], "bucket", DAY, "s", "value").drop("s")

    @cached_property
    def logs(self) -> DataFrame:
        e, u = F.col("event_type"), F.col("user_id")
        return self.events.select(
            "event_id", "ts", F.concat(F.lit("asset-"), (u % 10).cast("string")).alias("asset_id"), F.concat(F.lit("svc-"), (u % 2).cast("string")).alias("service_name"),
            F.when(e == "error", "ERROR").when(e == "signup", "WARN").otherwise("INFO").alias("severity"),
            F.when(e == "error", 17).when(e == "signup", 13).otherwise(9).alias("severity_num"),
            F.concat(e, F.lit(" of user "), u.cast("string"), F.lit(" "), "props").alias("body"))

    @cached_property
    def spans(self) -> DataFrame:
        li = self.read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.sum("l_quantity").cast("bigint").alias("q"), F.bool_or(F.col("l_returnflag") == "R").alias("bad"), F.bool_or(F.col("l_linestatus") == "F").alias("f"))
        o = self.read("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("od"))
        j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        n = F.col("l_linenumber")
        at = lambda s: F.timestamp_seconds(F.unix_seconds("od") + s)
        pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
        return j.select(
            pad(F.col("l_orderkey"), 32).alias("trace_id"), pad(n, 16).alias("span_id"),
            F.when(n == 1, "").otherwise(pad(F.floor(n / 2), 16)).alias("parent_id"), F.concat(F.lit("op-"), n.cast("string")).alias("name"),
            at(n * 10).alias("start_ts"), at(n * 10 + F.col("q")).alias("end_ts"), (F.col("q") * 1000000000).alias("duration_ns"),
            F.when(F.col("bad"), "error").otherwise("ok").alias("status"), F.when(F.col("f"), "svc-F").otherwise("svc-O").alias("service_name"),
            F.lit("servidor").alias("kind"), F.concat(F.lit("asset-"), (F.col("o_custkey") % 10).cast("string")).alias("asset_id"))

    @cached_property
    def olog(self) -> DataFrame:
        o = self.read("orders")
        urgent = F.col("o_orderpriority") == "1-URGENT"
        return o.select(
            "o_orderkey", F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 11).alias("ts"),
            F.concat(F.lit("asset-"), (F.col("o_custkey") % 10).cast("string")).alias("asset_id"), F.lpad(F.col("o_orderkey").cast("string"), 32, "0").alias("trace_id"),
            F.lpad(F.lit("1"), 16, "0").alias("span_id"), F.when(urgent, "ERROR").otherwise("INFO").alias("severity"),
            F.when(urgent, 17).otherwise(9).alias("severity_num"), F.col("o_orderpriority").alias("body"), F.lit("svc").alias("service_name"))

    @cached_property
    def injections(self) -> DataFrame:
        v = F.col("value")
        kind = F.element_at(F.array(*[F.lit(x) for x in ("cpu", "memoria", "caida", "latencia")]), (F.col("k") % 4 + 1).cast("int"))
        return self.events.where("event_type = 'purchase'").select(
            F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("uid"), kind.alias("type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("asset_id"),
            F.col("ts").alias("start"), F.when(v >= 4, F.col("ts") + F.expr("interval 20 hours")).alias("end"), F.when(v >= 10, "completada").otherwise("fallida").alias("state"))

    @cached_property
    def anomalies(self) -> DataFrame:
        v, ts = F.col("value"), F.col("ts")
        return self.events.where("event_type = 'error'").select(
            F.col("event_id").cast("string").alias("anomaly_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("asset_id"),
            F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("metric"), ts.alias("start"), F.when(v >= 20, ts + F.expr("interval 1 hour")).alias("end"),
            F.when(v > 120, "falso_positivo").when(v >= 20, "cerrada").when(v > 10, "diagnosticada").otherwise("detectada").alias("state"),
            F.when(v > 100, "alta").when(v > 30, "media").otherwise("baja").alias("severity"), v.alias("score"),
            F.when(v > 2, "mad-v2 W=60").otherwise("mad-v1").alias("model_version"),
            F.timestamp_micros(F.unix_micros("ts") + F.floor(v).cast("bigint") * 1000000).alias("detected_at"))

    @cached_property
    def diagnoses(self) -> DataFrame:
        return self.events.where("event_type in ('view', 'click')").select(
            F.col("event_id").alias("diagnosis_id"), (F.col("event_id") - 1).cast("string").alias("anomaly_id"), F.col("ts").alias("generated"),
            F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"), F.floor("value").cast("bigint").alias("tokens_in"), F.col("k").alias("tokens_out"))

    @cached_property
    def judged(self) -> DataFrame:
        from ..operators.evaluate import judged
        return judged(self.anomalies, self.injections, *self.window)

    @cached_property
    def window(self):
        return F.timestamp_seconds(F.lit(0)), F.to_timestamp(F.lit("2100-01-01 00:00:00"))

    @cached_property
    def assets(self) -> DataFrame:
        c = self.read("customer").where("c_acctbal >= 0")
        n = self.read("nation")
        return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
            F.col("c_name").alias("asset_id"), F.concat(F.lit("host-"), F.col("c_custkey").cast("string")).alias("name"), F.lower("c_mktsegment").alias("provider"),
            F.col("n_name").alias("env"), F.when(F.col("c_acctbal") < 500, "retirado").otherwise("activo").alias("state"))

    @cached_property
    def keys(self) -> DataFrame:
        c = self.read("customer")
        seg = F.lower("c_mktsegment")
        a = c.where("c_acctbal >= 0").select(F.concat(F.lit("host-"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("asset_id"),
                                             F.lit("host.name").alias("kind"), seg.alias("provider"))
        b = c.where("c_acctbal >= 2000").select(F.concat(seg, F.lit(":vm/"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("asset_id"),
                                                F.lit("nativo").alias("kind"), seg.alias("provider"))
        return a.unionByName(b)

    @cached_property
    def charges(self) -> DataFrame:
        o, c = self.read("orders"), self.read("customer")
        day = F.col("o_orderdate").cast("date")
        return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            "o_orderkey", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("asset_id"), F.when(F.col("o_orderpriority") <= "2", "aws").otherwise("digitalocean").alias("provider"),
            F.col("o_totalprice").cast("decimal(14,4)").alias("amount"), day.alias("start"), F.date_add(day, 30).alias("end"), F.concat(F.lit("factura "), "o_orderstatus").alias("source"))

    @cached_property
    def arrivals(self) -> DataFrame:
        e, u = F.col("event_type"), F.col("user_id")
        return self.events.select(
            F.concat(F.lit("u"), (u % 50).cast("string")).alias("asset_id"), F.concat(F.lit("node-"), u.cast("string")).alias("host_name"),
            F.when(e == "view", "metricas").when(e == "click", "registros").otherwise("trazas").alias("signal"),
            F.when(u % 7 != 0, F.concat(F.lit("prov-"), (u % 3).cast("string"))).alias("provider"), F.col("ts").alias("received_at"),
            F.floor("value").cast("bigint").alias("received"), F.when(e == "error", 1).otherwise(0).alias("errors"))

    @cached_property
    def snapshots(self) -> DataFrame:
        """One snapshot per supplier. The arrays hold distinct (few) ports and containers of the node."""
        s = self.read("supplier")
        nk = F.col("s_nationkey")
        nodes = s.select(
            F.col("s_name").alias("node"), F.when(nk < 8, "plataforma").otherwise("lab").alias("env"),
            F.when(F.col("s_acctbal") > 0, F.concat(F.lit("activo-"), F.col("s_suppkey").cast("string"))).alias("asset_id"),
            F.timestamp_seconds(F.lit(1704067200) + nk * 86400).alias("taken_at"), F.col("s_suppkey").alias("seq"),
            F.when(nk == 3, "").otherwise(F.concat(F.lit("v"), F.floor(nk / 10).cast("string"))).alias("agent_version"),
            F.when(nk == 5, 30).otherwise(10).alias("interval_s"), "s_suppkey")
        p, li = self.read("part"), self.read("lineitem").select("l_suppkey", "l_partkey", "l_linestatus").distinct()
        on = li.join(p, li["l_partkey"] == p["p_partkey"])
        size = F.col("p_size")
        port = F.element_at(F.array(*[F.lit(x) for x in (22, 5432, 443, 8080, 9000, 4317)]), (size % 6 + 1).cast("int"))
        addr = F.when((F.col("l_linestatus") == "O") & (size < 25), "0.0.0.0").otherwise("127.0.0.1")
        ports = on.select("l_suppkey", port.alias("puerto"), F.lit("tcp").alias("protocolo"), addr.alias("direccion"), F.lit("").alias("proceso")).distinct().groupBy(
            "l_suppkey").agg(F.collect_list(F.struct("puerto", "protocolo", "direccion", "proceso")).alias("ports"))
        user = F.when(F.col("p_brand") == "Brand#1", "root:root").when(F.col("p_brand") == "Brand#2", "0").otherwise("app")
        conts = on.select("l_suppkey", F.col("p_name").alias("nombre"), F.lower("p_type").alias("imagen"),
                          F.when(size < 3, "").otherwise((size % 3).cast("string")).alias("version"), user.alias("usuario")).distinct().groupBy("l_suppkey").agg(
            F.collect_list(F.struct("nombre", "imagen", "version", "usuario")).alias("containers"))
        return nodes.join(ports, nodes["s_suppkey"] == ports["l_suppkey"], "left").drop("l_suppkey").join(
            conts, nodes["s_suppkey"] == conts["l_suppkey"], "left").drop("l_suppkey", "s_suppkey")


def text(c: str, name: str | None = None):
    return iso_text(F.col(c)).alias(name or c)


def r(c, places: int = 4, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col + 1e-9, places).alias(name or c)
