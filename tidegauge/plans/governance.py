"""Costs, tokens and configuration findings."""

from pyspark.sql import functions as F

from ..operators import config_rules as C
from ..operators import costs
from .base import query, r, text
from .metrics import _USE, use_hours

A, Z = "DATE '1996-03-01'", "DATE '1997-06-30'"


def _period(t):
    d = lambda s: F.to_date(F.lit(s))
    return costs.in_period(t.charges, d("1996-03-01"), d("1997-06-30"))


@query("a20_cost_report", f"""SELECT asset_id, provider, CAST(round_even(sum(amount), 2) AS DOUBLE) AS cost, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM charges
  WHERE asset_id IS NOT NULL AND "start" BETWEEN {A} AND {Z} GROUP BY 1, 2""", "charges")
def _(t):
    return costs.report(_period(t)).select("asset_id", "provider", F.col("cost").cast("double").alias("cost"), "sources")


@query("a20_unassigned", f'SELECT CAST(round_even(sum(amount), 2) AS DOUBLE) AS unassigned FROM charges WHERE asset_id IS NULL AND "start" BETWEEN {A} AND {Z}', "charges")
def _(t):
    return costs.unassigned(_period(t)).select(F.col("unassigned").cast("double").alias("unassigned"))


@query("a21_import_summary", """WITH m AS (SELECT provider, strftime("start", '%Y-%m') AS m, count(*) AS n, min(o_orderkey) AS f FROM charges GROUP BY 1, 2)
  SELECT c.provider AS file, count(*) AS lines, count(c.asset_id) AS assigned, count(*) - count(c.asset_id) AS unassigned, CAST(round_even(sum(amount), 2) AS DOUBLE) AS total,
  'factura exportada ' || (SELECT arg_max(m.m, (m.n, -m.f)) FROM m WHERE m.provider = c.provider) AS source FROM charges c GROUP BY 1""", "charges")
def _(t):
    c = t.charges.withColumnRenamed("provider", "file").withColumn("line", F.col("o_orderkey"))
    return costs.import_summary(c, "file").withColumn("total", F.col("total").cast("double"))


@query("a22_default_period", """SELECT strftime(least(min("start"), min("end")), '%Y-%m-%d') AS period_start, strftime(greatest(max("start"), max("end")), '%Y-%m-%d') AS period_end FROM charges""", "charges")
def _(t):
    d = costs.default_period(t.charges, F.to_date(F.lit("2024-02-10")))
    return d.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in d.columns])


_TREND = """WITH c AS (SELECT c.*, strftime(c."start", '%Y-%m') AS month, CASE WHEN c.asset_id IS NULL THEN 'sin asignar' ELSE coalesce(a.env, 'desconocido') END AS env FROM charges c LEFT JOIN (SELECT asset_id, env FROM assets) a USING (asset_id)),
  g AS (SELECT k.{by}, m.month, coalesce((SELECT sum(amount) FROM c WHERE c.{by} = k.{by} AND c.month = m.month), 0) AS amount FROM (SELECT DISTINCT {by} FROM c WHERE {by} IS NOT NULL) k CROSS JOIN (SELECT DISTINCT month FROM c) m)
  SELECT {by}, month, CAST(round_even(amount, 2) AS DOUBLE) AS amount, rnd((CAST(round_even(amount, 2) AS DOUBLE) - CAST(round_even(p, 2) AS DOUBLE)) / nullif(CAST(round_even(p, 2) AS DOUBLE), 0), 4) AS change FROM (SELECT *, lag(amount) OVER (PARTITION BY {by} ORDER BY month) AS p FROM g)"""


@query("a23_trend_by_environment", _TREND.replace("{by}", "env"), "charges assets")
def _(t):
    return costs.trend(t.charges, t.assets, "env").select("env", "month", F.col("amount").cast("double").alias("amount"), r("change"))


@query("a23_trend_by_asset", """WITH c AS (SELECT asset_id, strftime("start", '%Y-%m') AS month, sum(amount) AS s FROM charges WHERE asset_id IS NOT NULL GROUP BY 1, 2)
  SELECT asset_id, month, CAST(round_even(coalesce(s, 0), 2) AS DOUBLE) AS amount FROM (SELECT DISTINCT asset_id FROM c) CROSS JOIN (SELECT DISTINCT strftime("start", '%Y-%m') AS month FROM charges) LEFT JOIN c USING (asset_id, month)""", "charges")
def _(t):
    return costs.trend(t.charges, t.assets, "asset_id").select("asset_id", "month", F.col("amount").cast("double").alias("amount"))


def _asset_cost(t):
    """Charges of ten made-up machines, so that they meet the hourly use."""
    o = t.read("orders")
    return o.select(F.concat(F.lit("asset-"), (F.col("o_custkey") % 12).cast("string")).alias("asset_id"), F.lit("aws").alias("provider"),
                    F.when(F.col("o_custkey") % 12 == 3, 0).otherwise(F.col("o_totalprice")).cast("decimal(14,4)").alias("amount"))


_UNDER = f"""WITH c AS (SELECT 'asset-' || (o_custkey % 12) AS asset_id, CAST(round_even(sum(CAST(CASE WHEN o_custkey % 12 = 3 THEN 0 ELSE o_totalprice END AS DECIMAL(14, 4))), 2) AS DOUBLE) AS cost FROM orders GROUP BY 1),
  u AS (SELECT asset_id, count(*) FILTER (WHERE kind = 'cpu') AS nc, count(*) FILTER (WHERE kind = 'memoria') AS nm, round_even(avg(busy) FILTER (WHERE kind = 'cpu'), 4) AS cm, max(busy) FILTER (WHERE kind = 'cpu') AS cp, round_even(avg(busy) FILTER (WHERE kind = 'memoria'), 4) AS mm
    FROM (SELECT asset_id, kind, CASE WHEN kind = 'cpu' THEN CASE WHEN asset_id < 'asset-5' THEN busy / 20 ELSE busy END ELSE busy END AS busy FROM ({_USE})) GROUP BY 1)
  SELECT asset_id, coalesce(cost, 0) AS cost, CASE WHEN coalesce(nm, 0) > 0 THEN least(coalesce(nc, 0), nm) ELSE coalesce(nc, 0) END AS hours, cm AS cpu_mean, mm AS memory_mean,
  CASE WHEN coalesce(cost, 0) <= 0 OR CASE WHEN coalesce(nm, 0) > 0 THEN least(coalesce(nc, 0), nm) ELSE coalesce(nc, 0) END < 24 OR mm IS NULL THEN NULL ELSE cm < 0.1 AND cp < 0.4 AND mm < 0.4 END AS under_used FROM c FULL JOIN u USING (asset_id)"""


@query("a24_under_used", _UNDER, "hours")
def _(t):
    u = use_hours(t)
    u = u.withColumn("busy", F.when((F.col("kind") == "cpu") & (F.col("asset_id") < "asset-5"), F.col("busy") / 20).otherwise(F.col("busy")))
    return costs.under_used(_asset_cost(t), u).select("asset_id", F.col("cost").cast("double").alias("cost"), F.col("hours").cast("bigint").alias("hours"), "cpu_mean", "memory_mean", "under_used")


@query("j12_cost_beside_use", f"""SELECT asset_id, cost > 0 AS paid, hours > 0 AS used FROM ({_UNDER})""", "hours")
def _(t):
    """Machines with charges, with use, or with one of the two."""
    u = costs.under_used(_asset_cost(t), use_hours(t).withColumn("busy", F.col("busy") / 20))
    return u.select("asset_id", (F.col("cost") > 0).alias("paid"), (F.col("hours") > 0).alias("used"))


@query("a25_totals", """SELECT provider, env, CAST(GROUPING(provider, env) AS BIGINT) AS level, CAST(round_even(sum(amount), 2) AS DOUBLE) AS amount, count(*) AS charges FROM (SELECT c.provider, amount, CASE WHEN c.asset_id IS NULL THEN 'sin asignar' ELSE coalesce(a.env, 'desconocido') END AS env
  FROM charges c LEFT JOIN assets a USING (asset_id)) GROUP BY GROUPING SETS ((provider), (env), ())""", "charges assets")
def _(t):
    return costs.totals(t.charges, t.assets).withColumn("amount", F.col("amount").cast("double"))


@query("a26_tokens", """SELECT strftime(generated, '%Y-%m-%d') AS day, model, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM diagnoses GROUP BY GROUPING SETS ((day, model), (model))""", "diagnoses")
def _(t):
    return costs.tokens(t.diagnoses.withColumnRenamed("generated", "ts"))


_J13 = r"""WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(body), '[a-z0-9][a-z0-9._-]*')) AS word FROM t),
  n AS (SELECT DISTINCT lower(key) AS word, asset_id FROM keys WHERE lower(key) NOT IN (SELECT lower(asset_id) FROM keys) UNION SELECT DISTINCT lower(asset_id), asset_id FROM keys),
  h AS (SELECT conv_id, turn, count(DISTINCT asset_id) AS k, string_agg(DISTINCT asset_id, ', ' ORDER BY asset_id) AS ids FROM w JOIN n USING (word) GROUP BY 1, 2)
  SELECT conv_id, turn, CASE WHEN k = 1 THEN ids END AS asset_id, CASE WHEN k = 1 THEN '' WHEN k > 1 THEN 'coincide con varios activos: ' || ids ELSE 'ningun recurso del catalogo aparece en la linea' END AS reason FROM t LEFT JOIN h USING (conv_id, turn)"""


@query("j13_line_attribution", _J13.replace("WITH w AS", "WITH t AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' (host-' || conv_id || ')' WHEN turn % 3 = 1 THEN ' host-' || conv_id || ', Customer#' || lpad((conv_id + 1)::VARCHAR, 9, '0') ELSE '' END AS body FROM conversations), w AS"), "keys")
def _(t):
    c = t.read("conversations")
    i, k = F.col("conv_id"), F.col("turn") % 3
    tail = F.when(k == 0, F.concat(F.lit(" (host-"), i.cast("string"), F.lit(")"))).when(
        k == 1, F.concat(F.lit(" host-"), i.cast("string"), F.lit(", Customer#"), F.lpad((i + 1).cast("string"), 9, "0"))).otherwise("")
    c = c.select("conv_id", "turn", F.concat("text", tail).alias("body"), F.concat_ws("/", i.cast("string"), F.col("turn").cast("string")).alias("line_id"))
    return costs.attribute(c, t.keys, "line_id", ["body"]).select("conv_id", "turn", "asset_id", "reason")


@query("j22_costs_by_environment", """SELECT CASE WHEN c.asset_id IS NULL THEN 'sin asignar' ELSE coalesce(a.env, 'desconocido') END AS env, CAST(round_even(sum(amount), 2) AS DOUBLE) AS amount FROM charges c LEFT JOIN assets a USING (asset_id) GROUP BY 1""", "charges assets")
def _(t):
    return costs.totals(t.charges, t.assets).where("env is not null").select("env", F.col("amount").cast("double").alias("amount"))


@query("k06_costliest", f"""SELECT asset_id, provider, CAST(round_even(sum(amount), 2) AS DOUBLE) AS cost FROM charges WHERE asset_id IS NOT NULL AND "start" BETWEEN {A} AND {Z} GROUP BY 1, 2""", "charges")
def _(t):
    return costs.report(_period(t)).select("asset_id", "provider", F.col("cost").cast("double").alias("cost"))


@query("k08_most_common", "SELECT p_type AS common FROM part GROUP BY 1 ORDER BY count(*) DESC, min(p_partkey) LIMIT 1")
def _(t):
    return C.most_common(t.read("part"), "p_type", "p_partkey").select("common")


_OUT = "rule, severity, assets, envs, detail, strftime(detected, '%Y-%m-%d %H:%M:%S') AS detected"


def _cols(df):
    return df.select("rule", "severity", "assets", "envs", "detail", text("detected"))


@query("a47_exposed_ports", f"""SELECT {_OUT} FROM (SELECT 'puerto-expuesto-no-esperado' AS rule, CASE WHEN puerto IN (5432, 8080) THEN 'alta' ELSE 'media' END AS severity, asset AS assets, env AS envs,
  'El puerto ' || puerto || '/tcp escucha en ' || direccion || ' en ' || node || ' y no esta entre los esperados del entorno ' || env || '.' || CASE WHEN puerto IN (5432, 8080) THEN ' Es uno de los que nunca deben quedar expuestos.' ELSE '' END AS detail,
  taken_at AS detected FROM ports WHERE direccion NOT LIKE '127.%' AND puerto <> 22 AND NOT (env = 'plataforma' AND puerto IN (443, 4317)))""", "ports")
def _(t):
    return _cols(C.exposed_ports(t.snapshots, C.expected_ports(t.spark)))


@query("a48_agent_versions", f"""WITH m AS (SELECT agent_version AS common FROM nodes WHERE agent_version <> '' GROUP BY 1 ORDER BY count(*) DESC, min(seq) LIMIT 1)
  SELECT 'version-agente-distinta' AS rule, 'media' AS severity, string_agg(coalesce(asset_id, node), ', ' ORDER BY coalesce(asset_id, node)) AS assets, string_agg(DISTINCT env, ', ' ORDER BY env) AS envs,
  string_agg(node, ', ' ORDER BY node) || ' corre el agente ' || CASE agent_version WHEN '' THEN 'desconocida' ELSE agent_version END || ' y el resto ' || any_value(common) || '. La comparacion entre entornos solo vale si todos miden con la misma version.' AS detail,
  strftime(max(taken_at), '%Y-%m-%d %H:%M:%S') AS detected FROM nodes, m WHERE agent_version <> common GROUP BY agent_version""", "nodes")
def _(t):
    return _cols(C.agent_versions(t.snapshots))


@query("a49_sampling_intervals", f"""SELECT 'intervalo-muestreo-distinto' AS rule, 'media' AS severity, string_agg(coalesce(asset_id, node), ', ' ORDER BY coalesce(asset_id, node)) AS assets, string_agg(DISTINCT env, ', ' ORDER BY env) AS envs,
  'Muestrean distinto del comun (10 s): ' || string_agg(node || ' cada ' || interval_s || ' s', '; ' ORDER BY seq) || '.' AS detail, strftime(max(taken_at), '%Y-%m-%d %H:%M:%S') AS detected FROM nodes WHERE interval_s <> 10""", "nodes")
def _(t):
    return _cols(C.sampling_intervals(t.snapshots))


@query("a50_root_containers", f"""SELECT {_OUT} FROM (SELECT 'contenedor-como-root' AS rule, 'alta' AS severity, asset AS assets, env AS envs, 'El contenedor ' || nombre || ' (' || imagen || ':' || CASE version WHEN '' THEN '?' ELSE version END || ') corre como root en ' || node || '.' AS detail,
  taken_at AS detected FROM containers WHERE usuario IN ('root:root', '0') AND nombre NOT IN ('agente', 'inyector'))""", "containers")
def _(t):
    return _cols(C.root_containers(t.snapshots))


@query("a51_image_versions", f"""SELECT 'imagen-version-distinta' AS rule, 'baja' AS severity, a.assets, a.envs, a.imagen || ' corre en ' || v.n || ' versiones: ' || v.s || '.' AS detail, strftime(a.detected, '%Y-%m-%d %H:%M:%S') AS detected FROM
  (SELECT imagen, string_agg(DISTINCT asset, ', ' ORDER BY asset) AS assets, string_agg(DISTINCT env, ', ' ORDER BY env) AS envs, max(taken_at) AS detected FROM containers GROUP BY 1) a
  JOIN (SELECT imagen, count(*) AS n, string_agg(CASE version WHEN '' THEN '?' ELSE version END || ' en ' || ns, '; ' ORDER BY version) AS s FROM (SELECT imagen, version, string_agg(DISTINCT node, ', ' ORDER BY node) AS ns FROM containers GROUP BY 1, 2) GROUP BY 1) v ON v.imagen = a.imagen WHERE v.n >= 2""", "containers")
def _(t):
    return _cols(C.image_versions(t.snapshots))


@query("k05_all_findings", """SELECT rule, severity, count(*) AS n FROM (SELECT 'puerto-expuesto-no-esperado' AS rule, CASE WHEN puerto IN (5432, 8080) THEN 'alta' ELSE 'media' END AS severity FROM ports WHERE direccion NOT LIKE '127.%' AND puerto <> 22 AND NOT (env = 'plataforma' AND puerto IN (443, 4317))
  UNION ALL SELECT 'contenedor-como-root', 'alta' FROM containers WHERE usuario IN ('root:root', '0') UNION ALL SELECT 'imagen-version-distinta', 'baja' FROM (SELECT imagen FROM containers GROUP BY 1 HAVING count(DISTINCT version) >= 2)
  UNION ALL SELECT 'intervalo-muestreo-distinto', 'media' WHERE EXISTS (SELECT 1 FROM nodes WHERE interval_s <> 10) UNION ALL SELECT 'version-agente-distinta', 'media' FROM (SELECT agent_version FROM nodes WHERE agent_version <> (SELECT agent_version FROM nodes WHERE agent_version <> '' GROUP BY 1 ORDER BY count(*) DESC, min(seq) LIMIT 1) GROUP BY 1)) GROUP BY 1, 2""", "ports containers nodes")
def _(t):
    return C.findings(t.snapshots).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("j21_findings_with_assets", "SELECT s_name AS node, coalesce(k.asset_id, s_name) AS asset_id FROM supplier LEFT JOIN (SELECT 'Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') AS key, c_name AS asset_id FROM customer WHERE c_acctbal > 5000) k ON k.key = s_name")
def _(t):
    k = t.read("customer").where("c_acctbal > 5000").select(F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("key"), F.col("c_name").alias("asset_id"))
    f = t.read("supplier").select(F.col("s_name").alias("node"), F.lit(None).cast("string").alias("asset_id"))
    return C.with_assets(f, k).select("node", "asset_id")
