"""Name rules, value rules, parsing and formatting."""

from pyspark.sql import functions as F

from ..functions import names, times, values
from ..schema import RESERVED_WORDS, TAGS
from .base import query, r, text

_WORDS = ", ".join(f"'{w}'" for w in RESERVED_WORDS)
_TAGS = ", ".join(f"'{w}'" for w in (*TAGS, "time", "value"))


def canon_sql(x: str) -> str:
    a = f"regexp_replace(regexp_replace(lower(trim({x}, ' \t\n\r\f\v')), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g')"
    a = f"trim({a}, '_')"
    c = f"substring(CASE WHEN regexp_matches({a}, '^[a-z]') THEN {a} ELSE 'm_' || {a} END, 1, 63)"
    return f"CASE WHEN {a} = '' THEN 'sin_nombre' WHEN {c} IN ({_WORDS}) THEN {c} || '_x' ELSE {c} END"


_NAMES = """SELECT DISTINCT s FROM (SELECT url AS s FROM pages UNION ALL SELECT p_name FROM part UNION ALL SELECT o_orderpriority FROM orders
  UNION ALL SELECT event_type FROM events UNION ALL SELECT html FROM pages UNION ALL SELECT text FROM documents)"""


def _names(t):
    one = lambda n, c: t.read(n).select(F.col(c).alias("s") if isinstance(c, str) else c.alias("s"))
    u = one("pages", "url")
    for n, c in (("part", "p_name"), ("orders", "o_orderpriority"), ("events", "event_type"), ("pages", "html"), ("documents", "text")):
        u = u.unionByName(one(n, c))
    return u.distinct()


@query("p01_canonical_names", f"SELECT md5(s) AS id, {canon_sql('s')} AS name FROM ({_NAMES})")
def _(t):
    return _names(t).select(F.md5("s").alias("id"), names.canonical_name("s").alias("name"))


@query("p02_canonical_dimensions", f"""SELECT name, count(*) AS n FROM (SELECT CASE WHEN c IN ({_TAGS}) THEN c || '_dim' ELSE c END AS name
  FROM (SELECT {canon_sql('s')} AS c FROM ({_NAMES} UNION ALL SELECT 'value' UNION ALL SELECT 'Host.Name'))) GROUP BY 1""")
def _(t):
    extra = t.read("region").select(F.explode(F.array(F.lit("value"), F.lit("Host.Name"))).alias("s")).distinct()
    return _names(t).unionByName(extra).groupBy(names.canonical_dimension("s").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("p03_identifiers", f"SELECT regexp_matches(s, '^[a-z][a-z0-9_]{{0,62}}$') AS ok, count(*) AS n FROM ({_NAMES}) GROUP BY 1")
def _(t):
    return _names(t).groupBy(names.is_identifier("s").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("p04_point_routes", """SELECT route, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT CASE WHEN k % 10 = 0 OR value < 1 THEN 'no_value'
  WHEN k % 10 = 1 THEN 'error' ELSE 'valid' END AS route, value AS v FROM (SELECT value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)) GROUP BY 1""")
def _(t):
    e = t.events
    v = F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value"))
    flag, ns = (F.col("k") % 10 == 0).cast("int"), F.when(F.col("k") % 10 == 1, F.lit(-1)).otherwise(F.unix_micros("ts") * 1000)
    route = F.when((flag.bitwiseAND(1) == 1) | ~values.finite(v), "no_value").when(ns < 0, "error").otherwise("valid")
    return e.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2, "total"))


@query("p05_tag_defaults", """SELECT coalesce(nullif(CASE WHEN user_id % 3 = 0 THEN '' ELSE 'svc' || (user_id % 3) END, ''), 'host') AS service_name,
  coalesce(CASE WHEN user_id % 2 = 0 THEN 'r' || (user_id % 4) END, 'desconocido') AS cloud_region, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    u = F.col("user_id")
    svc = F.when(u % 3 == 0, "").otherwise(F.concat(F.lit("svc"), (u % 3).cast("string")))
    reg = F.when(u % 2 == 0, F.concat(F.lit("r"), (u % 4).cast("string")))
    return t.events.groupBy(names.fill_tag(svc, "host").alias("service_name"), names.fill_tag(reg).alias("cloud_region")).agg(F.count(F.lit(1)).alias("n"))


@query("p06_dimension_values", r"""SELECT doc_id, md5(CASE WHEN v = '' THEN 'desconocido' ELSE v END) AS value FROM (SELECT doc_id,
  trim(regexp_replace(substring(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), 1, 1024), '\\+$', '')) AS v FROM documents)""")
def _(t):
    return t.read("documents").select("doc_id", F.md5(names.clean_value(F.col("text"))).alias("value"))


@query("p07_time_fallback", "SELECT count(*) AS n, count_if(k % 5 = 0) AS from_arrival, sum(CASE WHEN k % 5 = 0 THEN epoch_us(ts + INTERVAL 1 MINUTE) ELSE epoch_us(ts) END % 1000003)::BIGINT AS h FROM (SELECT ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def _(t):
    ns = F.when(F.col("k") % 5 == 0, F.lit(0)).otherwise(F.unix_micros("ts") * 1000)
    got = times.time_or_arrival(ns, F.col("ts") + F.expr("interval 1 minute"))
    e = t.events.withColumn("ns", ns).withColumn("got", got).withColumn("x", F.expr("got div 1000 % 1000003"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ns") == 0).alias("from_arrival"), F.sum("x").cast("bigint").alias("h"))


@query("f01_slugs", r"""SELECT url, CASE WHEN s = '' THEN 'sin-nombre' ELSE s END AS slug FROM (SELECT url, substring(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40) AS s FROM pages)""")
def _(t):
    return t.read("pages").select("url", names.slug("url").alias("slug"))


@query("f02_instants", "SELECT date_trunc('day', ts)::VARCHAR AS d, count(*) AS n FROM events GROUP BY 1")
def _(t):
    i = F.col("event_id") % 4
    z = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    s = F.when(i == 0, F.concat(z, F.lit("Z"))).when(i == 1, F.concat(F.replace(z, F.lit("T"), F.lit(" ")), F.lit("+00"))).when(
        i == 2, F.concat(z, F.lit("+00:00"))).otherwise(z)
    return t.events.groupBy(F.date_format(F.date_trunc("day", times.parse_instant(s)), "yyyy-MM-dd HH:mm:ss").alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("f02_invoice_dates", "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS d, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    i, ts = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp")
    f = lambda p: F.date_format(ts, p)
    s = F.when(i == 0, f("yyyy-MM-dd HH:mm:ss '+0000'")).when(i == 1, f("yyyy-MM-dd HH:mm:ss")).when(i == 2, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(f("yyyy-MM-dd"))
    return t.read("orders").groupBy(F.date_format(times.parse_invoice_date(s), "yyyy-MM-dd").alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("f03_durations", "SELECT p_size, p_size * CASE WHEN p_size % 2 = 0 THEN 86400 ELSE 3600 END AS secs, CASE WHEN p_size % 3 = 0 THEN greatest(1, p_size // 1000) ELSE p_size * 60 END AS every, count(*) AS n FROM part GROUP BY 1")
def _(t):
    s = F.col("p_size")
    a = F.concat(s.cast("string"), F.when(s % 2 == 0, "d").otherwise("h"))
    b = F.concat(s.cast("string"), F.when(s % 3 == 0, "ms").otherwise("m"))
    return t.read("part").groupBy("p_size", times.duration_seconds(a).alias("secs"), times.interval_seconds(b).alias("every")).agg(F.count(F.lit(1)).alias("n"))


@query("f04_epoch_alignment", """SELECT event_id, strftime(to_timestamp(epoch_us(ts) // 1000000 // 300 * 300) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS lo,
  strftime(to_timestamp(-((-epoch_us(ts)) // 300000000) * 300) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS hi_unused FROM events""".replace("-((-epoch_us(ts)) // 300000000)", "CAST(ceil(epoch_us(ts) / 300000000.0) AS BIGINT)"))
def _(t):
    return t.events.select("event_id", times.iso_text(times.bucket(F.col("ts"), 300)).alias("lo"), times.iso_text(times.bucket_ceil(F.col("ts"), 300)).alias("hi_unused"))


@query("f05_nano_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') || lpad((event_id % 1000)::VARCHAR, 3, '0') AS t FROM events")
def _(t):
    return t.events.select("event_id", times.nano_text(F.unix_micros("ts") * 1000 + F.col("event_id") % 1000).alias("t"))


@query("f06_significant_digits", "SELECT event_id, CASE WHEN value = 0 THEN 0 ELSE round(round(value * pow(10, 3 - floor(log10(abs(value))))) / pow(10, 3 - floor(log10(abs(value)))), 6) END AS v FROM events")
def _(t):
    return t.events.select("event_id", F.round(values.significant(F.col("value")), 6).alias("v"))


@query("f07_money", "SELECT c_custkey, CAST(round_even(CAST(c_acctbal * 100 AS BIGINT) / 8.0, 2) AS DOUBLE) AS m FROM customer")
def _(t):
    whole = F.round(F.col("c_acctbal") * 100).cast("bigint").cast("decimal(18,0)")
    return t.read("customer").select("c_custkey", values.money((whole / F.lit(8).cast("decimal(2,0)")).cast("decimal(20,4)")).cast("double").alias("m"))


@query("f08_unit_texts", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN printf('%.2f', round(value, 2)) || ' %'
  WHEN 1 THEN CASE WHEN value * 1000 >= 1024 THEN regexp_replace(printf('%.2f', round(value * 1000 / 1024, 2)), '\\.?0+$', '') || ' KB/s' ELSE printf('%.0f', round(value * 1000)) || ' B/s' END
  WHEN 2 THEN regexp_replace(printf('%.2f', round(value, 2)), '\\.?0+$', '') || ' llamadas/s' ELSE regexp_replace(printf('%.2f', round(value, 2)), '\\.?0+$', '') END AS t FROM events""".replace("\\\\", "\\"))
def _(t):
    i = F.col("event_id") % 4
    m = F.when(i == 0, "x_utilization").when(i == 1, "system_disk_io").when(i == 2, "traces_span_metrics_calls").otherwise("other")
    v = F.when(i == 0, F.col("value") / 100).when(i == 1, F.col("value") * 1000).otherwise(F.col("value"))
    return t.events.select("event_id", values.value_text(m, v, F.lit(None).cast("string")).alias("t"))


@query("f09_level_names", "SELECT CASE WHEN n >= 21 THEN 'Fatal' WHEN n >= 17 THEN 'Error' WHEN n >= 13 THEN 'Aviso' WHEN n >= 9 THEN 'Info' WHEN n > 0 THEN 'Depuración' ELSE 'Sin nivel' END AS level, count(*) AS rows FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 AS n FROM events) GROUP BY 1")
def _(t):
    return t.events.groupBy(values.level_name(F.col("k") % 25).alias("level")).agg(F.count(F.lit(1)).alias("rows"))


@query("f10_images_and_addresses", """SELECT p_partkey, 'reg:5000/' || p_type AS base, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'latest' END AS version,
  CASE p_size % 3 WHEN 0 THEN '0.0.0.0' WHEN 1 THEN '::' ELSE '127.0.0.53' END AS address, p_size AS port FROM part""")
def _(t):
    s = F.col("p_size")
    image = F.concat(F.lit("reg:5000/"), "p_type", F.when(s % 2 == 0, F.concat(F.lit(":"), s.cast("string"))).otherwise(""))
    addr = F.concat(F.when(s % 3 == 0, "*").when(s % 3 == 1, "[::]").otherwise("127.0.0.53%lo"), F.lit(":"), s.cast("string"))
    i, a = values.image_parts(image), values.address_parts(addr)
    return t.read("part").select("p_partkey", i["base"].alias("base"), i["version"].alias("version"), a["address"].alias("address"), a["port"].alias("port"))


@query("f11_key_kinds", "SELECT CASE WHEN contains(key, ':') THEN 'nativo' ELSE 'host.name' END AS kind, count(*) AS n FROM keys GROUP BY 1", "keys")
def _(t):
    return t.keys.groupBy(names.key_kind(F.col("key")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("f12_signal_keys", """SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'cpu[host=' || s_name || ', state=' || s_nationkey || ', por device]' ELSE 'cpu[host=' || s_name || ', state=' || s_nationkey || ']' END AS k FROM supplier""")
def _(t):
    f = F.create_map(F.lit("state"), F.col("s_nationkey").cast("string"), F.lit("host"), F.col("s_name"))
    return t.read("supplier").select(names.signal_key(F.lit("cpu"), f, F.when(F.col("s_nationkey") % 2 == 0, "device")).alias("k"))


@query("f13_json_fields", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count_if(event_type = 'view') AS broken FROM events GROUP BY 1")
def _(t):
    bad = F.when(F.col("event_type") == "view", F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    k = values.json_field(F.col("props"), "$.k").cast("bigint")
    return t.events.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(values.json_field(bad, "$.k").isNull()).alias("broken"))


@query("f18_relative_times", """SELECT CASE WHEN s < 60 THEN 'hace ' || s || ' s' WHEN s < 3600 THEN 'hace ' || CAST(round(s / 60) AS BIGINT) || ' min'
  WHEN s < 86400 THEN 'hace ' || CAST(round(s / 3600) AS BIGINT) || ' h' ELSE 'hace ' || CAST(round(s / 86400) AS BIGINT) || ' d' END AS t, count(*) AS n
  FROM (SELECT CAST(round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 1000000) AS BIGINT) AS s FROM events) GROUP BY 1""")
def _(t):
    return t.events.groupBy(times.relative_text(F.col("ts"), F.to_timestamp(F.lit("2024-01-31 00:00:00"))).alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query("w23_hours_minutes", """SELECT event_id, CASE WHEN m >= 60 THEN (m // 60) || ' h ' || lpad((m % 60)::VARCHAR, 2, '0') || ' min' ELSE m || ' min' END AS t
  FROM (SELECT event_id, CAST(round_even(value * 100 / 60, 0) AS BIGINT) AS m FROM events)""")
def _(t):
    return t.events.select("event_id", times.hours_minutes(F.col("value") * 100).alias("t"))


@query("s04_dimension_maps", """SELECT dims, count(*) AS n FROM (SELECT '{"slot":"' || slot || '","value_x":"' || metric || '"}' AS dims FROM points) GROUP BY 1""", "points")
def _(t):
    m = F.map_from_arrays(F.array(F.lit("Slot"), F.lit("value"), F.lit("none")), F.array("slot", "metric", F.lit("")))
    return t.points.select(names.dims_text(names.clean_dimensions(m)).alias("dims")).groupBy("dims").agg(F.count(F.lit(1)).alias("n"))


@query("p10_refused_ranges", """SELECT event_id, CASE WHEN e <= ts THEN 'empty range' WHEN e - ts > INTERVAL 2 DAY THEN 'range longer than 2 days' WHEN lim NOT BETWEEN 1 AND 2000 THEN 'limit must be between 1 and 2000' END AS fault
  FROM (SELECT event_id, ts, ts + to_hours(CAST(floor(value) AS BIGINT) - 20) AS e, CAST(json_extract_string(props, '$.k') AS BIGINT) * 50 AS lim FROM events)""")
def _(t):
    end = F.timestamp_micros(F.unix_micros("ts") + (F.floor("value").cast("bigint") - 20) * 3_600_000_000)
    return t.events.select("event_id", times.range_fault(F.col("ts"), end, 2, F.col("k") * 50).alias("fault"))
