"""Saturation projection and forecast baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# ---- fixed values
Z95 = 1.959964
HORIZON_MIN = 48 * 60
LEAST_POINTS = 4
TEST_HOURS = 12
# ---- end of fixed values


def _minutes(c) -> Column:
    return F.unix_micros(c) / 60000000


def fit(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """OLS of the value on minutes since the first point, all from mergeable sums.

    Sums are taken against the group's first instant and mean value, which
    keeps them small, so the residual sum does not drown in rounding.
    """
    base = df.groupBy(*keys).agg(F.min(ts).alias("_t0"), F.avg(value).alias("_y0"), F.avg(_minutes(ts)).alias("_x0"))
    j = df.join(base, keys)
    x, y = _minutes(ts) - F.col("_x0"), F.col(value) - F.col("_y0")
    g = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("_t0").alias("t0"), F.first("_x0").alias("xm"), F.first("_y0").alias("ym"),
        F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"), F.max(ts).alias("t_last"),
        F.min_by(ts, ts).alias("_a"), F.min(F.when(F.col(ts) > F.col("_t0"), F.col(ts))).alias("t_second"))
    slope = F.try_divide("sxy", F.nullif("sxx", F.lit(0.0)))
    g = g.withColumn("slope", slope)
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    return g.withColumn("r2", F.when(F.col("syy") > 0, 1 - sse / F.col("syy")).otherwise(1.0)).withColumn(
        "s", F.sqrt(sse / F.greatest(F.lit(1), F.col("n") - 2))).drop("_a")


def crossing(fits: DataFrame, threshold: Column | float, horizon_min: int = HORIZON_MIN, z: float = Z95) -> DataFrame:
    """First future step, on the data's own step, where the line and its 95 % prediction band reach the threshold.

    Each curve is a(t) = m + b·u ± z·s·sqrt(1 + 1/n + u²/Sxx), u in minutes
    from the mean time. The future grid has a fixed length per row (horizon over
    step), so it is searched inside the row by higher-order functions; no row
    is multiplied.
    """
    th = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    step = F.greatest((F.unix_micros("t_second") - F.unix_micros("t0")) / 60000000, F.lit(1e-9))
    last = _minutes("t_last") - F.col("xm")
    df = fits.where((F.col("n") >= LEAST_POINTS) & (F.col("slope") > 0)).withColumn("_step", step).withColumn("_last", last)
    steps = F.sequence(F.lit(1), F.floor(F.lit(horizon_min) / F.col("_step") + 1e-9).cast("int"))

    def first(sign: int) -> Column:
        def reach(k):
            u = F.col("_last") + k * F.col("_step")
            band = z * F.col("s") * F.sqrt(1 + 1 / F.col("n") + u * u / F.col("sxx"))
            return F.col("ym") + F.col("slope") * u + sign * band >= th
        return F.try_element_at(F.filter(steps, reach), F.lit(1))

    out = df.withColumn("k_mean", first(0)).withColumn("k_soon", first(1)).withColumn("k_late", first(-1))
    at = lambda k: F.timestamp_micros(F.round(F.unix_micros("t_last") + F.col(k) * F.col("_step") * 60000000).cast("bigint"))
    return out.withColumn("estimate", at("k_mean")).withColumn("earliest", at("k_soon")).withColumn("latest", at("k_late")).drop(
        "_step", "_last", "k_mean", "k_soon", "k_late")


def backtest(df: DataFrame, key: str, ts: str, value: str, threshold: float, horizon_min: int = HORIZON_MIN) -> DataFrame:
    """Per injection, the first minute whose expanding line warns, against the real crossing.

    A window over one injection: its minutes are a few, by construction. The
    line is refitted by running sums, not by refitting each prefix.
    """
    w = W.partitionBy(key).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    full = W.partitionBy(key)
    x = _minutes(ts) - F.min(_minutes(ts)).over(full)
    y = F.col(value)
    d = df.where(y.isNotNull()).withColumn("_x", x).withColumn("n", F.count(F.lit(1)).over(w)).withColumn(
        "slope", F.regr_slope(y, F.col("_x")).over(w)).withColumn("_b", F.regr_intercept(y, F.col("_x")).over(w)).withColumn(
        "r2", F.coalesce(F.regr_r2(y, F.col("_x")).over(w), F.lit(1.0)))
    ordered = W.partitionBy(key).orderBy(ts)
    step = F.nth_value(F.col("_x"), 2).over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    d = d.withColumn("_step", step)
    # first grid point at or over the threshold on the mean line
    k = F.greatest(F.lit(1.0), F.ceil((F.lit(threshold) - F.col("_b") - F.col("slope") * F.col("_x")) / (F.col("slope") * F.col("_step")) - 1e-9))
    warns = (F.col("n") >= LEAST_POINTS) & (F.col("slope") > 0) & (k <= F.floor(F.lit(horizon_min) / F.col("_step") + 1e-9))
    est = F.timestamp_micros((F.unix_micros(ts) + k * F.col("_step") * 60000000).cast("bigint"))
    d = d.withColumn("_w", F.when(warns, F.struct(F.col(ts).alias("at"), est.alias("est"), F.col("r2").alias("r2"))))
    g = d.groupBy(key).agg(F.min(ts).alias("start"), F.max(value).alias("peak"),
                           F.min(F.when(y >= threshold, F.col(ts))).alias("crossed"), F.min_by("_w", F.when(F.col("_w").isNotNull(), F.col(ts))).alias("w"))
    lead = (F.unix_micros("crossed") - F.unix_micros("w.at")) / 60000000
    err = F.abs(F.unix_micros("w.est") - F.unix_micros("crossed")) / 60000000
    return g.select(key, "start", "peak", "crossed", F.col("w.at").alias("warned"), F.col("w.est").alias("estimate"),
                    lead.alias("lead_min"), err.alias("error_min"), F.col("w.r2").alias("r2"),
                    (F.col("crossed").isNull() & F.col("w").isNotNull()).alias("false_warning"))


def holdout_scores(hours: DataFrame, key: str, ts: str, value: str, test: int = TEST_HOURS, season: int = 24) -> DataFrame:
    """Last value, value a day ago, and AR(1) by conditional least squares; MAE, RMSE, coverage and width of the 95 % band.

    ``hours`` is the hour table of each series: at most one row per hour of
    the retention, which bounds the windows.
    """
    desc = W.partitionBy(key).orderBy(F.desc(ts))
    o = W.partitionBy(key).orderBy(ts)
    d = hours.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(desc)).withColumn("_lag", F.lag(value, 1).over(o)).withColumn(
        "_season", F.lag(value, season).over(o)).withColumn("_i", F.row_number().over(o))
    train, tst = F.col("_r") > test, F.col("_r") <= test
    y, x = F.col(value), F.col("_lag")
    pair = train & x.isNotNull()
    m = d.groupBy(key).agg(
        F.max_by(value, F.when(train, F.col(ts))).alias("_last"), F.count_if(train).alias("_n"),
        F.regr_slope(F.when(pair, y), F.when(pair, x)).alias("_phi"), F.regr_intercept(F.when(pair, y), F.when(pair, x)).alias("_c"),
        F.count_if(pair).alias("_m"), F.regr_syy(F.when(pair, y), F.when(pair, x)).alias("_syy"),
        F.regr_sxy(F.when(pair, y), F.when(pair, x)).alias("_sxy"))
    t = d.where(tst).join(m, key).where("_n >= 3").withColumn("_h", F.lit(test) - F.col("_r") + 1)
    sig2 = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_phi") * F.col("_sxy")) / F.greatest(F.lit(1), F.col("_m") - 2)
    p = F.pow("_phi", F.col("_h"))
    geo = F.when(F.abs(F.col("_phi") - 1) < 1e-12, F.col("_h").cast("double")).otherwise((1 - p) / (1 - F.col("_phi")))
    mean = F.col("_c") * geo + p * F.col("_last")
    q = F.col("_phi") * F.col("_phi")
    var = sig2 * F.when(F.abs(q - 1) < 1e-12, F.col("_h").cast("double")).otherwise((1 - F.pow(q, F.col("_h"))) / (1 - q))
    half = Z95 * F.sqrt(F.greatest(F.lit(0.0), var))
    no = F.lit(None).cast("double")
    one = lambda n, pred, h: F.struct(F.lit(n).alias("model"), pred.alias("pred"), h.alias("half"))
    models = F.array(one("ultimo valor", F.col("_last"), no), one("hace 24 h", F.when(F.col("_n") >= season, F.col("_season")), no),
                     one("AR(1)", mean, half))
    e = t.select(key, value, F.explode(models).alias("m")).where("m.pred is not null").withColumn("_e", y - F.col("m.pred"))
    return e.groupBy(key, F.col("m.model").alias("model")).agg(
        F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg(F.when(F.col("m.half").isNotNull(), (F.abs("_e") <= F.col("m.half")).cast("double"))).alias("coverage"),
        F.avg(2 * F.col("m.half")).alias("width"))


def spread_without_faults(hours: DataFrame, key: str, ts: str, value: str, faults: DataFrame, fault_ts: str) -> DataFrame:
    """Sample deviation of the hourly series with and without the hours a fault touches."""
    hit = faults.select(key, F.date_trunc("hour", fault_ts).alias("_h")).distinct().withColumn("_f", F.lit(True))
    j = hours.withColumn("_h", F.date_trunc("hour", ts)).join(hit, [key, "_h"], "left")
    return j.groupBy(key).agg(F.stddev_samp(value).alias("std_all"), F.stddev_samp(F.when(F.col("_f").isNull(), F.col(value))).alias("std_clean"),
                              F.count("_f").alias("fault_hours"))
