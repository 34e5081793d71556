"""Feature tables, rolling scores, runs, forecasts, clustering and classification."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import forecast, ml
from .base import DAY, HOUR, query, r, text

KEYS = ["asset_id", "metric"]


def _platform(t):
    """Events renamed to the platform's metrics, so that the seven features can be built from them."""
    m, s = F.col("metric"), F.col("slot")
    name = (F.when(m.isin("view", "click"), "system_cpu_utilization").when(m == "signup", "system_memory_utilization").when(m == "error", "system_filesystem_usage")
            .otherwise(F.when(s.isin("0", "1"), "system_network_io").otherwise("traces_span_metrics_calls")))
    state = (F.when(m == "view", "user").when(m == "click", "system").when(m == "signup", "used").when(m == "error", F.when(s == "0", "used").otherwise("free")))
    dims = F.map_filter(F.map_from_arrays(F.array(F.lit("slot"), F.lit("state"), F.lit("mountpoint"), F.lit("device")), F.array(
        s, state, F.when(m == "error", "/"), F.when(name == "system_network_io", F.when(s == "0", "lo").otherwise("eth0")))), lambda k, v: v.isNotNull())
    svc = F.when(s == "2", "pedidos").when(s == "3", "catalogo").otherwise(F.col("service_name"))
    return t.points.drop("dims_key").withColumn("dims", dims).withColumn("service_name", F.when(m == "purchase", svc).otherwise(F.col("service_name"))).withColumn("metric", name)


_F = """WITH b AS (SELECT asset_id, metric, slot, date_trunc('hour', ts) AS bucket, avg(value) AS v FROM points GROUP BY ALL),
  g AS (SELECT asset_id, metric, bucket, avg(v) AS v FROM b WHERE metric IN ('view', 'click', 'signup') GROUP BY ALL),
  d AS (SELECT asset_id, bucket, max(v) FILTER (WHERE st = 'used') / nullif(sum(v), 0) AS v FROM (SELECT asset_id, date_trunc('hour', ts) AS bucket, CASE slot WHEN '0' THEN 'used' ELSE 'free' END AS st, avg(value) AS v FROM points WHERE metric = 'error' GROUP BY ALL) GROUP BY ALL),
  q AS (SELECT asset_id, slot, bucket, (v - lag(v) OVER w) / (epoch(bucket) - epoch(lag(bucket) OVER w)) AS x FROM b WHERE metric = 'purchase' AND slot <> '0' WINDOW w AS (PARTITION BY asset_id, slot ORDER BY bucket)),
  rr AS (SELECT asset_id, slot, bucket, sum(CASE WHEN x >= 0 THEN x END) AS v FROM q GROUP BY ALL),
  l AS (SELECT asset_id, bucket, CASE metric WHEN 'view' THEN 'cpu_user' WHEN 'click' THEN 'cpu_system' ELSE 'memoria_used' END AS f, v FROM g UNION ALL SELECT asset_id, bucket, 'disco_used_frac', v FROM d
    UNION ALL SELECT asset_id, bucket, CASE slot WHEN '1' THEN 'red_bytes_s' WHEN '2' THEN 'tasa_llamadas_pedidos' ELSE 'tasa_llamadas_catalogo' END, v FROM rr)
  SELECT asset_id, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket""" + "".join(f", rnd(max(v) FILTER (WHERE f = '{f}'), 6) AS {f}" for f in X.FEATURES) + " FROM l GROUP BY asset_id, l.bucket"


@query("w09_feature_table", _F, "points")
def _(t):
    return X.feature_table(_platform(t), HOUR).select("asset_id", text("bucket"), *[r(f, 6) for f in X.FEATURES])


def _long(t):
    h = t.hourly.withColumnRenamed("metric", "feature")
    return h.withColumn("value", X.squeezed(F.col("value"), F.col("feature"), ["error"]))


_LONG = "SELECT asset_id, metric AS feature, bucket, CASE metric WHEN 'error' THEN ln(1 + greatest(value, 0)) ELSE value END AS value FROM hourly"
_FLOOR = f"SELECT feature, greatest(0.1 * stddev_samp(value), 1e-6) AS mad_floor FROM ({_LONG}) WHERE bucket < TIMESTAMP '2024-01-15' GROUP BY 1"
_Z = f"""SELECT asset_id, feature, bucket, value, CASE WHEN len(ds) = 60 THEN 0.6745 * (value - med) / greatest(list_median(ds), mad_floor) END AS z FROM (SELECT *, list(d) FILTER (WHERE d IS NOT NULL) OVER (PARTITION BY asset_id, feature ORDER BY bucket ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS ds
  FROM (SELECT *, abs(lag(value) OVER (PARTITION BY asset_id, feature ORDER BY bucket) - med) AS d FROM (SELECT *, CASE WHEN len(h) = 60 THEN list_median(h) END AS med FROM (SELECT *, list(value) OVER (PARTITION BY asset_id, feature ORDER BY bucket ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS h FROM ({_LONG})))))
  JOIN ({_FLOOR}) USING (feature)"""


def _floors(t):
    ts = lambda s: F.to_timestamp(F.lit(s))
    return X.mad_floors(_long(t), ts("2000-01-01 00:00:00"), ts("2024-01-15 00:00:00"))


def _scores(t):
    return X.rolling_scores(_long(t), _floors(t), bucket_seconds=DAY, chunk_rows=1024)


@query("w11_mad_floors", f"SELECT feature, rnd(mad_floor, 6) AS mad_floor FROM ({_FLOOR})", "hourly")
def _(t):
    return _floors(t).select("feature", r("mad_floor", 6))


@query("w10_signed_scores", f"SELECT asset_id, feature, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, rnd(z, 4) AS z FROM ({_Z})", "hourly")
def _(t):
    return _scores(t).select("asset_id", "feature", text("bucket"), r("z"))


def _marked(t):
    """Hours of an asset; the busy ones play the anomalous minutes, and a gap is over two hours."""
    h = t.points.groupBy("asset_id", F.date_trunc("hour", "ts").alias("bucket")).agg(F.avg("value").alias("v"))
    return h.withColumn("anomalous", F.col("v") > 45)


_RUNS = """WITH h AS (SELECT asset_id, date_trunc('hour', ts) AS bucket, avg(value) > 45 AS bad FROM points GROUP BY 1, 2), p AS (SELECT *, coalesce(epoch(bucket) - epoch(lag(bucket) OVER w) > 7200, true) AS gap, lag(bad) OVER w AS pb FROM h WINDOW w AS (PARTITION BY asset_id ORDER BY bucket)),
  g AS (SELECT *, sum(CASE WHEN gap OR pb <> bad THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY bucket) AS grp FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY asset_id, grp ORDER BY bucket) AS k, min(bucket) OVER (PARTITION BY asset_id, grp) AS f FROM g),
  tr AS (SELECT asset_id, bucket, bad, f FROM n WHERE (bad AND k = 3) OR (NOT bad AND k = 4)), fl AS (SELECT * FROM (SELECT *, lag(bad) OVER (PARTITION BY asset_id ORDER BY bucket) AS before FROM tr) WHERE (bad AND NOT coalesce(before, false)) OR (NOT bad AND before))
  SELECT asset_id, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS start, strftime(e, '%Y-%m-%d %H:%M:%S') AS "end" FROM (SELECT *, lead(f) OVER (PARTITION BY asset_id ORDER BY bucket) AS e FROM fl) WHERE bad"""


@query("w13_state_runs", _RUNS, "points")
def _(t):
    return X.state_runs(_marked(t), run=3, calm=4, max_gap=7200, bucket_seconds=DAY, chunk_rows=512).select("asset_id", text("start"), text("end"))


_BLOCKS = """SELECT asset_id, metric AS label, count(*) AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end" FROM (SELECT *, sum(CASE WHEN p IS NULL OR p <> metric OR epoch_us(ts) - epoch_us(pt) > 36000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY ts) AS b
  FROM (SELECT asset_id, ts, metric, lag(metric) OVER (PARTITION BY asset_id ORDER BY ts) AS p, lag(ts) OVER (PARTITION BY asset_id ORDER BY ts) AS pt FROM points)) WHERE metric <> 'view' GROUP BY asset_id, b, metric HAVING count(*) >= 3"""


def _blocks(t):
    return X.blocks(t.points, "asset_id", "ts", "metric", "view", 36000, 3, DAY)


@query("w19_event_blocks", _BLOCKS, "points")
def _(t):
    return _blocks(t).select("asset_id", F.col("metric").alias("label"), "rows", text("start"), text("end"))


@query("j20_left_out_rows", """SELECT i.uid AS event_id, count(*) AS rows FROM (SELECT 'u' || user_id AS asset_id, ts FROM events) e JOIN injections i ON i.asset_id = e.asset_id AND e.ts BETWEEN i."start" - INTERVAL 10 MINUTE AND i."end" + INTERVAL 10 MINUTE WHERE i."end" IS NOT NULL GROUP BY 1""", "injections")
def _(t):
    rows = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("asset_id"), "ts")
    ev = t.injections.where("end is not null").withColumnRenamed("uid", "event_id")
    return X.left_out(rows, ev, "asset_id", "ts").groupBy("event_id").agg(F.count(F.lit(1)).alias("rows"))


_BASE = """SELECT asset_id, metric, med, CASE WHEN quantile_cont(abs(value - med), 0.5) * 1.4826 > 0 THEN quantile_cont(abs(value - med), 0.5) * 1.4826 ELSE stddev_samp(value) END AS scale FROM points JOIN (SELECT asset_id, metric, quantile_cont(value, 0.5) AS med FROM points GROUP BY 1, 2) USING (asset_id, metric) GROUP BY 1, 2, 3"""


@query("a39_history_baseline", f"SELECT asset_id, metric, rnd(med, 4) AS med, rnd(scale, 4) AS scale FROM ({_BASE})", "points")
def _(t):
    return X.history_baseline(t.points, KEYS).select(*KEYS, r("med"), r("scale"))


@query("w25_row_states", f"""SELECT state, count(*) AS n FROM (SELECT asset_id, d, CASE max(c) WHEN 2 THEN 'critico' WHEN 1 THEN 'normal' ELSE 'bueno' END AS state FROM (SELECT asset_id, date_trunc('hour', ts) AS d, CASE WHEN (value - med) / scale >= 3.5 THEN 2 WHEN (value - med) / scale >= 1.5 THEN 1 ELSE 0 END AS c
  FROM points JOIN ({_BASE}) USING (asset_id, metric)) GROUP BY 1, 2) GROUP BY 1""", "points")
def _(t):
    p = t.points.withColumn("d", F.date_trunc("hour", "ts"))
    return X.row_states(p, X.history_baseline(t.points, KEYS), ["asset_id", "d"], KEYS).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("a40_confusion", """SELECT lang, count_if(q AND x) AS tp, count_if(q AND NOT x) AS fp, count_if(NOT q AND x) AS fn, count_if(NOT q AND NOT x) AS tn, rnd(count_if(q AND x) / nullif(count_if(q), 0), 4) AS precision, rnd(count_if(q AND x) / nullif(count_if(x), 0), 4) AS recall
  FROM (SELECT lang, quality = 1 AS q, toxic = 1 AS x FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def _(t):
    j = t.read("labels").join(t.read("documents").select("doc_id", "lang"), "doc_id")
    return X.confusion(j, F.col("quality") == 1, F.col("toxic") == 1, ["lang"]).select("lang", "tp", "fp", "fn", "tn", r("precision"), r("recall"))


@query("a40_state_shares", "SELECT lang, source AS state, count(*) AS n, rnd(count(*) / sum(count(*)) OVER (PARTITION BY lang), 4) AS share FROM documents GROUP BY 1, 2")
def _(t):
    return X.shares(t.read("documents").withColumnRenamed("source", "state"), "lang", "state").select("lang", "state", "n", r("share"))


@query("a42_correlations", """SELECT a, b, rnd(r, 4) AS r FROM (SELECT 'l_quantity' AS a, 'l_quantity' AS b, corr(l_quantity, l_quantity) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', corr(l_extendedprice, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem UNION ALL SELECT 'l_discount', 'l_discount', corr(l_discount, l_discount) FROM lineitem)""")
def _(t):
    return X.correlations(t.read("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", r("r"))


@query("a42_class_correlations", """SELECT 'l_quantity' AS feature, k AS label, rnd(corr(l_quantity, CASE WHEN l_returnflag = k THEN 1 ELSE 0 END), 4) AS r FROM lineitem, (VALUES ('A'), ('N'), ('R')) v(k) GROUP BY k""")
def _(t):
    return X.class_correlations(t.read("lineitem"), ["l_quantity"], "l_returnflag", ["A", "N", "R"]).select("feature", "label", r("r"))


@query("a43_cluster_profile", "SELECT label AS cluster, count(*) AS size, rnd(avg(embedding[1]::DOUBLE), 5) AS mean_e0, rnd(avg(embedding[2]::DOUBLE), 5) AS mean_e1, rnd(avg(embedding[1]::DOUBLE * 2), 5) AS z_s0 FROM embeddings GROUP BY 1")
def _(t):
    e = t.read("embeddings").select(F.col("label").alias("cluster"), F.col("embedding")[0].cast("double").alias("e0"), F.col("embedding")[1].cast("double").alias("e1")).withColumn("s0", F.col("e0") * 2)
    p = ml.profile(e, ["s0"], ["e0", "e1"])
    return p.select("cluster", "size", r("mean_e0", 5), r("mean_e1", 5), r("z_s0", 5))


# ---------------------------------------------------------------- forecasts
_DAILY = "SELECT asset_id, metric, date_trunc('day', ts) AS bucket, avg(value) AS value FROM points GROUP BY ALL"
_FIT = f"""SELECT asset_id, metric, count(*) AS n, regr_slope(value, x) AS slope, regr_intercept(value, x) AS b, regr_r2(value, x) AS r2, sqrt(greatest(0, regr_syy(value, x) - regr_slope(value, x) * regr_sxy(value, x)) / (count(*) - 2)) AS s, regr_sxx(value, x) AS sxx, avg(x) AS xm, max(bucket) AS z
  FROM (SELECT *, epoch(bucket - TIMESTAMP '2024-01-01') / 60 AS x FROM ({_DAILY})) GROUP BY 1, 2"""


def _daily(t):
    return t.points.groupBy(*KEYS, F.date_trunc("day", "ts").alias("bucket")).agg(F.avg("value").alias("value"))


@query("w21_trend_fits", f"SELECT asset_id, metric, n, rnd(slope * 1440, 5) AS slope_day, rnd(r2, 4) AS r2, rnd(s, 4) AS s FROM ({_FIT})", "points")
def _(t):
    return forecast.fit(_daily(t), KEYS, "bucket", "value").select(*KEYS, "n", r(F.col("slope") * 1440, 5, "slope_day"), r("r2"), r("s"))


_CROSS = """min(k) FILTER (WHERE b + slope * (xz + k * 1440) {s} >= 62) AS {n}"""


@query("w21_saturation", f"""SELECT asset_id, metric, strftime(z + to_days(CAST(m AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS estimate, strftime(z + to_days(CAST(e AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(z + to_days(CAST(l AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS latest FROM
  (SELECT asset_id, metric, z, {_CROSS.format(s='', n='m')}, {_CROSS.format(s='+ band', n='e')}, {_CROSS.format(s='- band', n='l')} FROM (SELECT *, 1.959964 * s * sqrt(1 + 1.0 / n + pow(xz + k * 1440 - xm, 2) / sxx) AS band FROM (SELECT *, epoch(z - TIMESTAMP '2024-01-01') / 60 AS xz FROM ({_FIT}) WHERE slope > 0 AND n >= 4), (SELECT unnest(range(1, 366)) AS k)) GROUP BY 1, 2, 3)""", "points")
def _(t):
    c = forecast.crossing(forecast.fit(_daily(t), KEYS, "bucket", "value"), 62.0, 365 * 1440)
    return c.select(*KEYS, text("estimate"), text("earliest"), text("latest"))


@query("w22_projection_backtest", """WITH h AS (SELECT asset_id || '/' || metric || '/' || strftime(bucket, '%d') AS uid, bucket AS ts, value FROM hourly), x AS (SELECT *, epoch(ts - min(ts) OVER (PARTITION BY uid)) / 60 AS x FROM h),
  f AS (SELECT *, count(*) OVER w AS n, regr_slope(value, x) OVER w AS slope, regr_intercept(value, x) OVER w AS b, nth_value(x, 2) OVER (PARTITION BY uid ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS st FROM x WINDOW w AS (PARTITION BY uid ORDER BY ts ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT *, greatest(1, ceil((120 - b - slope * x) / (slope * st) - 1e-9)) AS k FROM f WHERE n >= 4 AND slope > 0), w AS (SELECT uid, arg_min(ts, ts) AS warned, arg_min(ts + to_seconds(CAST(k * st * 60 AS BIGINT)), ts) AS est FROM k WHERE k <= floor(2880 / st + 1e-9) GROUP BY 1)
  SELECT uid, strftime(crossed, '%Y-%m-%d %H:%M:%S') AS crossed, strftime(warned, '%Y-%m-%d %H:%M:%S') AS warned, (epoch(crossed) - epoch(warned)) / 60 AS lead_min, crossed IS NULL AND warned IS NOT NULL AS false_warning FROM (SELECT uid, min(ts) FILTER (WHERE value >= 120) AS crossed FROM h GROUP BY 1) LEFT JOIN w USING (uid)""", "hourly")
def _(t):
    h = t.hourly.select(F.concat_ws("/", "asset_id", "metric", F.date_format("bucket", "dd")).alias("uid"), F.col("bucket").alias("ts"), "value")
    return forecast.backtest(h, "uid", "ts", "value", 120.0).select("uid", text("crossed"), text("warned"), "lead_min", "false_warning")


@query("w24_forecast_scores", """WITH h AS (SELECT asset_id || '/' || metric AS s, bucket, value, row_number() OVER (PARTITION BY asset_id, metric ORDER BY bucket DESC) AS r, lag(value) OVER w AS lg, lag(value, 24) OVER w AS sn FROM hourly WINDOW w AS (PARTITION BY asset_id, metric ORDER BY bucket)),
  m AS (SELECT s, arg_max(value, bucket) AS last, regr_slope(value, lg) AS phi, regr_intercept(value, lg) AS c, count(lg) AS m, regr_syy(value, lg) AS syy, regr_sxy(value, lg) AS sxy FROM h WHERE r > 12 GROUP BY 1),
  p AS (SELECT h.s, value, last, sn, 13 - r AS k, phi, c * (1 - pow(phi, 13 - r)) / (1 - phi) + pow(phi, 13 - r) * last AS ar, 1.959964 * sqrt(greatest(0, syy - phi * sxy) / (m - 2) * (1 - pow(phi * phi, 13 - r)) / (1 - phi * phi)) AS half FROM h JOIN m USING (s) WHERE r <= 12)
  SELECT s, 'ultimo valor' AS model, rnd(avg(abs(value - last)), 4) AS mae, rnd(sqrt(avg(pow(value - last, 2))), 4) AS rmse, NULL AS coverage, NULL AS width FROM p GROUP BY 1 UNION ALL SELECT s, 'hace 24 h', rnd(avg(abs(value - sn)), 4), rnd(sqrt(avg(pow(value - sn, 2))), 4), NULL, NULL FROM p GROUP BY 1
  UNION ALL SELECT s, 'AR(1)', rnd(avg(abs(value - ar)), 4), rnd(sqrt(avg(pow(value - ar, 2))), 4), rnd(avg(CASE WHEN abs(value - ar) <= half THEN 1.0 ELSE 0 END), 4), rnd(avg(2 * half), 4) FROM p GROUP BY 1""", "hourly")
def _(t):
    h = t.hourly.select(F.concat_ws("/", "asset_id", "metric").alias("s"), "bucket", "value")
    return forecast.holdout_scores(h, "s", "bucket", "value").select("s", "model", r("mae"), r("rmse"), r("coverage"), r("width"))


@query("a54_spread_without_faults", """SELECT h.asset_id, rnd(stddev_samp(value), 4) AS std_all, rnd(stddev_samp(CASE WHEN f.h IS NULL THEN value END), 4) AS std_clean, count(f.h) AS fault_hours FROM (SELECT asset_id, date_trunc('hour', ts) AS bucket, avg(value) AS value FROM points GROUP BY 1, 2) h
  LEFT JOIN (SELECT DISTINCT asset_id AS a, date_trunc('hour', ts) AS h FROM points WHERE metric = 'purchase' AND value > 60) f ON f.a = h.asset_id AND f.h = h.bucket GROUP BY 1""", "points")
def _(t):
    f = t.points.where("metric = 'purchase' and value > 60").select("asset_id", "ts")
    hours = t.points.groupBy("asset_id", F.date_trunc("hour", "ts").alias("bucket")).agg(F.avg("value").alias("value"))
    d = forecast.spread_without_faults(hours, "asset_id", "bucket", "value", f, "ts")
    return d.select("asset_id", r("std_all"), r("std_clean"), "fault_hours")


# ---------------------------------------------------------------- learning
def _vectors(t):
    return t.read("embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query("m01_kmeans_assignment")
def _(t):
    v = _vectors(t)
    return ml.assign(ml.train_kmeans(v, restarts=3, max_iter=20), v).select("vec_id", "cluster", r("distance"))


@query("m02_anomalous_rows")
def _(t):
    v = _vectors(t)
    return ml.anomalous(ml.train_kmeans(v, restarts=2, max_iter=20), v, v).select("vec_id", "cluster", "anomalous")


def _cells(t):
    e = t.read("embeddings")
    cols = [f"e{i}" for i in range(e.select(F.max(F.size("embedding"))).first()[0])]
    return e.select("vec_id", F.col("label").cast("double").alias("label"), F.timestamp_seconds(F.col("vec_id") * 3600).alias("ts"),
                    *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


@query("m05_time_split", "SELECT count_if(rn <= floor(n * 0.7)) AS train, count_if(rn > floor(n * 0.7)) AS test, max(event_id) FILTER (WHERE rn <= floor(n * 0.7)) AS last_train FROM (SELECT event_id, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM events)")
def _(t):
    a, b = ml.time_split(t.events.select("event_id", "ts"), "ts")
    x = a.agg(F.count(F.lit(1)).alias("train"), F.max_by("event_id", "ts").alias("last_train"))
    return x.join(b.agg(F.count(F.lit(1)).alias("test")), F.lit(True)).select("train", "test", "last_train")


@query("m09_time_folds", "SELECT fold, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM (SELECT ts, ntile(5) OVER (ORDER BY ts) - 1 AS fold FROM events) GROUP BY 1")
def _(t):
    return ml.time_folds(t.events.select("event_id", "ts"), "ts").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start")).select(
        F.col("fold").cast("bigint").alias("fold"), "n", text("start"))


@query("m05_tree_predictions")
def _(t):
    rows, cols = _cells(t)
    a, b = ml.time_split(rows, "ts")
    return ml.class_scores(ml.tree(cols).fit(a).transform(b)).select("class", "support", r("precision"), r("recall"), r("f1"))


@query("m06_svm_predictions")
def _(t):
    rows, cols = _cells(t)
    a, b = ml.time_split(rows, "ts")
    return ml.overall_scores(ml.class_scores(ml.linear_svm(cols).fit(a).transform(b))).select(r("macro_f1"), r("accuracy"))


_KNN = """WITH c AS (SELECT floor(count(*) * 0.7) AS cut FROM embeddings), e AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings),
  x AS (SELECT vec_id, label, rn, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM e), s AS (SELECT d, stddev_samp(v) AS sd FROM x, c WHERE rn <= cut GROUP BY d), z AS (SELECT vec_id, label, rn, d, v / sd AS v FROM x JOIN s USING (d)),
  p AS (SELECT q.vec_id, t.vec_id AS other, t.label, sum((q.v - t.v) * (q.v - t.v)) AS dist FROM z q JOIN z t USING (d), c WHERE q.rn > cut AND t.rn <= cut GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) AS k FROM p),
  v AS (SELECT vec_id, label, count(*) AS n FROM r WHERE k <= 5 GROUP BY 1, 2) SELECT vec_id, CAST(arg_max(label, (n, -label)) AS DOUBLE) AS prediction FROM v GROUP BY 1"""


@query("m06_nearest_neighbours", _KNN)
def _(t):
    rows, cols = _cells(t)
    a, b = ml.time_split(rows, "ts")
    return ml.knn(a, b, "vec_id", "vec_id", cols).select("vec_id", "prediction")


@query("m07_class_scores", """SELECT class, support, predicted, tp, rnd(tp / predicted, 4) AS precision, rnd(tp / support, 4) AS recall FROM (SELECT quality AS class, count(*) AS support, count_if(quality = toxic) AS tp FROM labels GROUP BY 1)
  JOIN (SELECT toxic AS class, count(*) AS predicted FROM labels GROUP BY 1) USING (class)""")
def _(t):
    return ml.class_scores(t.read("labels"), "quality", "toxic").select("class", "support", "predicted", "tp", r("precision"), r("recall"))


@query("m01_nearest_centres", "SELECT vec_id, true AS nearest FROM embeddings")
def _(t):
    """Each row's centre is nearer than any other, measured pair by pair."""
    v = _vectors(t)
    model = ml.train_kmeans(v, restarts=1, max_iter=10)
    rows = ml.assign(model, v).withColumn("x", vector_to_array("features"))
    centres = t.spark.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(model.clusterCenters())], "centre int, c array<double>")
    d = F.sqrt(F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda p, q: p + q))
    each = rows.join(F.broadcast(centres), F.lit(True)).groupBy("vec_id", "cluster", "distance").agg(F.min(d).alias("least"))
    return each.select("vec_id", (F.abs(F.col("distance") - F.col("least")) < 1e-9).alias("nearest"))


@query("m02_rows_inside", "SELECT count(*) AS n, true AS few FROM embeddings")
def _(t):
    """With every cluster normal, only the farthest half percent of the training rows lies outside."""
    v = _vectors(t)
    m = ml.train_kmeans(v, restarts=1, max_iter=10)
    a = ml.anomalous(m, v, v)
    normal = [c["cluster"] for c in ml.centres(m, [f"e{i}" for i in range(len(m.clusterCenters()[0]))]) if c["normal"]]
    inside = F.col("cluster").isin(*normal) if normal else F.lit(False)
    return a.agg(F.count("*").alias("n"), (F.count_if(inside & F.col("anomalous")) <= 0.005 * F.count_if(inside) + 1).alias("few"))


@query("m05_tree_support", """SELECT CAST(label AS DOUBLE) AS class, count(*) AS support FROM (SELECT label, row_number() OVER (ORDER BY vec_id) AS rn, count(*) OVER () AS n FROM embeddings) WHERE rn > floor(n * 0.7) GROUP BY 1""")
def _(t):
    rows, cols = _cells(t)
    a, b = ml.time_split(rows, "ts")
    return ml.class_scores(ml.tree(cols).fit(a).transform(b)).where("support > 0").select("class", "support")


@query("m06_svm_support", """SELECT CAST(label AS DOUBLE) AS class, count(*) AS support FROM (SELECT label, row_number() OVER (ORDER BY vec_id) AS rn, count(*) OVER () AS n FROM embeddings) WHERE rn > floor(n * 0.7) GROUP BY 1""")
def _(t):
    rows, cols = _cells(t)
    a, b = ml.time_split(rows, "ts")
    return ml.class_scores(ml.linear_svm(cols).fit(a).transform(b)).where("support > 0").select("class", "support")


@query("m10_stored_baseline", f"SELECT asset_id, metric, rnd(med, 4) AS med FROM ({_BASE})", "points")
def _(t):
    from .streams import scratch
    path = scratch(t.spark)
    ml.save_baseline(X.history_baseline(t.points, KEYS), path)
    return t.spark.read.parquet(path).select("asset_id", "metric", r("med"))


@query("j14_row_states", """WITH b AS (SELECT asset_id, metric, avg(value) AS med, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) END AS scale FROM hourly WHERE asset_id <> 'asset-4' GROUP BY ALL)
  SELECT asset_id, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, ['bueno', 'normal', 'critico'][coalesce(max(CASE WHEN value IS NULL OR med IS NULL THEN NULL WHEN coalesce((value - med) / scale, 0) >= 3.5 THEN 2 WHEN coalesce((value - med) / scale, 0) >= 1.5 THEN 1 ELSE 0 END), 0) + 1] AS state
  FROM hourly LEFT JOIN b USING (asset_id, metric) GROUP BY 1, bucket""", "hourly")
def _(t):
    h = t.hourly.withColumnRenamed("metric", "feature")
    base = h.where("asset_id <> 'asset-4'").groupBy("asset_id", "feature").agg(F.avg("value").alias("med"), F.nullif(F.stddev_pop("value"), F.lit(0.0)).alias("scale"))
    return X.row_states(h, base, ["asset_id", "bucket"]).select("asset_id", text("bucket"), "state")


@query("m03_overlapping_windows", """SELECT uid, "start" < TIMESTAMP '2024-01-15' AND coalesce("end", TIMESTAMP '9999-12-31') > TIMESTAMP '2024-01-10' AS warns FROM injections""", "injections")
def _(t):
    at = lambda s: F.to_timestamp(F.lit(s))
    return t.injections.select("uid", ml.overlap_warning(at("2024-01-10"), at("2024-01-15"), F.col("start"), F.col("end")).alias("warns"))
