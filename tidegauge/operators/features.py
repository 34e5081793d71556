"""Wide feature tables, the signed rolling score, row states, fault blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rollup, series
from .detect import MAD_SCALE, middle, severity, state_of
from .ordered import local_frames, shifted
from .quantiles import exact_percentile

# ---- fixed values
FEATURES = ["cpu_user", "cpu_system", "memoria_used", "disco_used_frac", "red_bytes_s", "tasa_llamadas_pedidos", "tasa_llamadas_catalogo"]
RATES = ["red_bytes_s", "tasa_llamadas_pedidos", "tasa_llamadas_catalogo"]
HISTORY = 60
FLOOR_SHARE = 0.1
Z_CLIP = 20.0
Z_CUT = 3.5
RUN, CALM = 3, 15
MAX_GAP = 120
# ---- end of fixed values


def feature_table(points: DataFrame, step: int = 60) -> DataFrame:
    """Seven features per (asset, minute).

    Each feature is built in long form and one conditional aggregation makes
    them wide, so aligning seven tables costs one shuffle, not six outer joins.
    """
    p = rollup.with_series(points)
    d = F.col("dims")
    gauge = (F.when((F.col("metric") == "system_cpu_utilization") & (d["state"] == "user"), "cpu_user")
             .when((F.col("metric") == "system_cpu_utilization") & (d["state"] == "system"), "cpu_system")
             .when((F.col("metric") == "system_memory_utilization") & (d["state"] == "used"), "memoria_used"))
    g = rollup.two_level_mean(p.withColumn("feature", gauge).where("feature is not null"), step, [*rollup.SERIES, "feature"],
                              ["asset_id", "feature"])
    fs = p.where((F.col("metric") == "system_filesystem_usage") & (d["mountpoint"] == "/")).withColumn("state", d["state"])
    state_mean = fs.groupBy("asset_id", "state", rollup.bucket(F.col("ts"), step).alias("bucket")).agg(F.avg("value").alias("v"))
    disk = state_mean.groupBy("asset_id", "bucket").agg(
        (F.max(F.when(F.col("state") == "used", F.col("v"))) / F.nullif(F.sum("v"), F.lit(0.0))).alias("value")).select(
        "asset_id", F.lit("disco_used_frac").alias("feature"), "bucket", "value")
    calls = F.col("metric") == "traces_span_metrics_calls"
    svc = F.lower("service_name")
    name = (F.when((F.col("metric") == "system_network_io") & (F.coalesce(d["device"], F.lit("")) != "lo"), "red_bytes_s")
            .when(calls & svc.contains("pedido"), "tasa_llamadas_pedidos").when(calls & svc.contains("catalogo"), "tasa_llamadas_catalogo"))
    c = p.withColumn("feature", name).where("feature is not null")
    per = c.groupBy(*rollup.SERIES, "feature", rollup.bucket(F.col("ts"), step).alias("bucket")).agg(F.avg("value").alias("value"))
    r = series.rate_per_asset(per, [*rollup.SERIES, "feature"], ["asset_id", "feature"])
    long = g.unionByName(disk).unionByName(r.select("asset_id", "feature", "bucket", "value"))
    return long.groupBy("asset_id", "bucket").agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in FEATURES])


def unpivoted(wide: DataFrame, keys: list[str], features: list[str] = FEATURES) -> DataFrame:
    return wide.unpivot(keys, features, "feature", "value")


def squeezed(value: Column, feature: Column, rates: list[str] = RATES) -> Column:
    return F.when(feature.isin(*rates), F.log1p(F.greatest(value, F.lit(0.0)))).otherwise(value)


def mad_floors(long: DataFrame, start: Column, end: Column, ts: str = "bucket") -> DataFrame:
    """0.1 sample deviations of the training window over all assets, at least 1e-6."""
    t = long.where((F.col(ts) >= start) & (F.col(ts) < end))
    return t.groupBy("feature").agg(F.greatest(F.coalesce(FLOOR_SHARE * F.stddev_samp("value"), F.lit(1e-6)), F.lit(1e-6)).alias("mad_floor"))


def rolling_scores(long: DataFrame, floors: DataFrame, key: str = "asset_id", ts: str = "bucket", history: int = HISTORY,
                   bucket_seconds: int = 86400, chunk_rows: int = 4096) -> DataFrame:
    """z = 0.6745 (x - med) / max(mad, floor) against the ``history`` rows before.

    The deviations use the median AT THEIR OWN row, unlike the detection
    baseline. Both frames must be full. ``floors`` has one row per feature.
    """
    cut, w = local_frames(long, [key, "feature"], ts, bucket_seconds, 2 * history, chunk_rows=chunk_rows)
    back = w.rowsBetween(-history, -1)
    h = F.collect_list("value").over(back)
    cut = cut.withColumn("_h", h).withColumn("med", F.when(F.size("_h") == history, middle(F.col("_h"))))
    cut = cut.withColumn("_d", F.abs(F.lag("value", 1).over(w) - F.col("med")))
    dev = F.collect_list("_d").over(w.rowsBetween(-(history - 1), 0))
    cut = cut.withColumn("_ds", dev).withColumn("mad", F.when(F.size("_ds") == history, middle(F.col("_ds"))))
    out = cut.where("own").join(floors, "feature", "left")
    z = 0.6745 * (F.col("value") - F.col("med")) / F.greatest("mad", F.coalesce("mad_floor", F.lit(1e-6)))
    return out.select(key, "feature", ts, "value", "med", "mad", F.when(F.col("mad").isNotNull(), z).alias("z"))


def wide_scores(scores: DataFrame, key: str = "asset_id", ts: str = "bucket", features: list[str] = FEATURES) -> DataFrame:
    """Rows where every feature has a score."""
    g = scores.groupBy(key, ts).agg(*[F.max(F.when(F.col("feature") == f, F.col("z"))).alias(f) for f in features])
    return g.na.drop(subset=features)


def state_runs(marked: DataFrame, key: str = "asset_id", ts: str = "bucket", run: int = RUN, calm: int = CALM, max_gap: int = MAX_GAP,
               bucket_seconds: int = 86400, chunk_rows: int = 4096) -> DataFrame:
    """``key, start, end``: opens at ``run`` anomalous rows in a row, closes after ``calm`` normal ones.

    A longer gap resets both counts. Whether the n-th row of a streak is
    reached is decided by the last n rows only, so both triggers are local.
    What remains is an alternation: of the triggers in time order, those that
    differ from the one before them. That is one ``lag`` over a sparse set.
    """
    n = max(run, calm) + 1
    cut, w = local_frames(marked, [key], ts, bucket_seconds, n, chunk_rows=chunk_rows)
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts, 1).over(w)) > max_gap * 1000000
    first = F.lag(ts, 1).over(w).isNull()
    bad = F.col("anomalous")
    cut = cut.withColumn("_brk_bad", (first | gap | ~F.lag("anomalous", 1).over(w)).cast("int")).withColumn(
        "_brk_ok", (first | gap | F.lag("anomalous", 1).over(w)).cast("int"))
    # the streak is exactly n long when the row n-1 back starts it and no later row does
    def reached(k: int, brk: str, ok: Column) -> Column:
        inner = F.coalesce(F.sum(brk).over(w.rowsBetween(-(k - 2), 0)), F.lit(0)) if k > 1 else F.lit(0)
        return ok & (inner == 0) & (F.lag(brk, k - 1).over(w) == 1)
    cut = cut.withColumn("_open", reached(run, "_brk_bad", bad)).withColumn("_close", reached(calm, "_brk_ok", ~bad)).withColumn(
        "_first_ok", F.lag(ts, calm - 1).over(w))
    trig = cut.where("own and (_open or _close)").select(key, ts, "_open", "_first_ok")
    flip = shifted(trig, [key], ts, 30 * bucket_seconds, {"_before": ("_open", 1)})
    flip = flip.where((F.col("_open") & ~F.coalesce("_before", F.lit(False))) | (~F.col("_open") & F.col("_before"))).drop("pos", "_before")
    pair = shifted(flip, [key], ts, 30 * bucket_seconds, {"_end": ("_first_ok", -1)})
    return pair.where("_open").select(key, F.col(ts).alias("start"), F.col("_end").alias("end"))


def run_rows(runs: DataFrame, scores: DataFrame, assigned: DataFrame, version: str, key: str = "asset_id", ts: str = "bucket",
             features: list[str] = FEATURES) -> DataFrame:
    """The anomaly row of every run: the feature with the largest absolute score at opening, and its direction."""
    at = runs.join(scores.select(key, F.col(ts).alias("start"), *features), [key, "start"]).join(
        assigned.select(key, F.col(ts).alias("start"), "cluster", "distance"), [key, "start"])
    arr = F.array(*[F.struct(F.abs(F.col(f)).alias("a"), F.lit(-i).alias("i"), F.lit(f).alias("f"), F.col(f).alias("z")) for i, f in enumerate(features)])
    top = F.array_max(arr)
    return at.select(key, "start", "end", top["f"].alias("metric"), F.round(top["a"], 3).alias("score"), severity(top["a"]).alias("severity"),
                     F.when(top["z"] > 0, "sube").otherwise("baja").alias("direction"), "cluster",
                     F.round("distance", 3).alias("distance"), F.lit(version).alias("model_version"))


# ------------------------------------------------------------ whole-history baseline
def derived_rates(rows: DataFrame) -> DataFrame:
    """Total CPU and the error share (0 without calls)."""
    share = F.try_divide("tasa_errores_pedidos", F.nullif("tasa_llamadas_pedidos", F.lit(0.0)))
    return rows.withColumn("cpu_total", F.col("cpu_user") + F.col("cpu_system")).withColumn("tasa_error_relativa", F.coalesce(share, F.lit(0.0)))


def history_baseline(long: DataFrame, keys: list[str] = ("asset_id", "feature"), value: str = "value") -> DataFrame:
    """Median and 1.4826·MAD, else the SAMPLE deviation, else null. Medians are exact at any group size."""
    keys = list(keys)
    med = exact_percentile(long, keys, value, 0.5, "med")
    dev = long.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("med")))
    mad = exact_percentile(dev, keys, "_d", 0.5, "_mad")
    sd = long.groupBy(*keys).agg(F.stddev_samp(value).alias("_sd"))
    raw = F.when(F.col("_mad") * MAD_SCALE > 0, F.col("_mad") * MAD_SCALE).otherwise(F.col("_sd"))
    return med.join(mad, keys).join(sd, keys).select(*keys, "med", F.when(raw > 0, raw).alias("scale"))


def row_states(long: DataFrame, base: DataFrame, row: list[str], keys: list[str] = ("asset_id", "feature"), value: str = "value") -> DataFrame:
    """J14 + W25: the most severe class over the metrics of a row. A null metric has no class; no scale means z = 0."""
    j = long.join(base, list(keys), "left")
    z = F.coalesce((F.col(value) - F.col("med")) / F.col("scale"), F.lit(0.0))
    code = F.when(F.col(value).isNull() | F.col("med").isNull(), None).when(z >= 3.5, 2).when(z >= 1.5, 1).otherwise(0)
    worst = F.coalesce(F.max(code), F.lit(0))
    return j.groupBy(*row).agg(F.when(worst == 2, "critico").when(worst == 1, "normal").otherwise("bueno").alias("state"))


def confusion(rows: DataFrame, predicted: Column, actual: Column, keys: list[str] = ()) -> DataFrame:
    """A40."""
    g = rows.groupBy(*keys) if keys else rows
    c = g.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
              F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select(*keys, "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def shares(rows: DataFrame, group: str, state: str) -> DataFrame:
    """Share of each state inside a group."""
    n = rows.groupBy(group, state).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of every pair, all in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r"))
                                          for a, b in pairs])).alias("x")).select("x.*")


def class_correlations(rows: DataFrame, columns: list[str], label: str, classes: list[str]) -> DataFrame:
    """Feature against one-hot class."""
    one = rows.agg(*[F.corr(c, (F.col(label) == k).cast("double")).alias(f"{c}|{i}") for c in columns for i, k in enumerate(classes)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(k).alias("label"), F.col(f"`{c}|{i}`").alias("r"))
                                          for c in columns for i, k in enumerate(classes)])).alias("x")).select("x.*")


def blocks(rows: DataFrame, key: str, ts: str, label: str, normal: str, max_gap: int = 10, least: int = 3, bucket_seconds: int = 86400) -> DataFrame:
    """Runs of equal label without a longer gap; fault blocks of at least ``least`` rows."""
    from .ordered import running_sum
    s = shifted(rows.select(key, ts, label), [key], ts, bucket_seconds, {"_t": (ts, 1), "_l": (label, 1)}).drop("pos")
    new = F.col("_t").isNull() | ~F.col("_l").eqNullSafe(F.col(label)) | (F.unix_micros(F.col(ts)) - F.unix_micros("_t") > max_gap * 1000000)
    b = running_sum(s, [key], ts, bucket_seconds, new.cast("int"), "block")
    g = b.where(F.col(label) != normal).groupBy(key, "block", label).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return g.where(F.col("rows") >= least)


def left_out(rows: DataFrame, events: DataFrame, key: str, ts: str, minutes: int = 10, width: int = 86400) -> DataFrame:
    """(event, row) pairs that lie within the margin of the event: what a fold leaves out.

    The training rows of a fold are all others; taking the few left out is a
    range join on (key, time slice), where the opposite would be a cross join.
    """
    from .evaluate import overlap_join
    m = F.expr(f"interval {minutes} minutes")
    e = events.select(key, "event_id", (F.col("start") - m).alias("_a"), (F.col("end") + m).alias("_z"))
    return overlap_join(rows, e, key, ts, "_a", "_z", width=width).drop("_a", "_z")
