"""Baseline, score, persistence: how an anomaly opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import TERMINAL_STATES
from .evaluate import overlap_join
from .ordered import local_frames

# ---- fixed values
WINDOW, RUN = 60, 3
Z_NORMAL, Z_CRITICAL = 1.5, 3.5
MAD_SCALE = 1.4826
EXCESS_MEDIUM, EXCESS_HIGH = 10, 100
# ---- end of fixed values


def middle(a: Column) -> Column:
    """Median of an array (null when empty)."""
    s, n = F.sort_array(a), F.size(a)
    lo = F.try_element_at(s, F.floor((n + 1) / 2).cast("int"))
    hi = F.try_element_at(s, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (lo + hi) / 2)


def baseline(df: DataFrame, frame, value: str = "value", least: int | Column = WINDOW, rel: Column | float = 0.0,
             floor: Column | float = 0.0) -> DataFrame:
    """``med`` and ``scale`` of the rows before this one.

    One median per window for the MAD; population deviation where the MAD is
    0; the scale never falls below the floors; no scale when all are 0.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    df = df.withColumn("_h", F.collect_list(value).over(frame)).withColumn("_sd", F.stddev_pop(value).over(frame))
    df = df.withColumn("_ok", F.size("_h") >= F.greatest(F.lit(2), F.lit(least) if isinstance(least, int) else least))
    df = df.withColumn("med", F.when(F.col("_ok"), middle(F.col("_h"))))
    df = df.withColumn("_mad", middle(F.transform("_h", lambda x: F.abs(x - F.col("med")))) * MAD_SCALE)
    raw = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.coalesce("_sd", F.lit(0.0)))
    scale = F.greatest(raw, lit(rel) * F.abs("med"), lit(floor))
    return df.withColumn("scale", F.when(F.col("_ok") & (scale > 0), scale)).drop("_h", "_sd", "_mad")


def score(df: DataFrame, value: str = "value") -> DataFrame:
    """``z`` (0 without a scale) and ``state``; unclassified rows have neither."""
    z = F.when(F.col("scale").isNull(), F.lit(0.0)).otherwise((F.col(value) - F.col("med")) / F.col("scale"))
    df = df.withColumn("z", F.when(F.col("med").isNotNull(), z))
    return df.withColumn("state", state_of(F.col("z")))


def state_of(z: Column) -> Column:
    return (F.when(z.isNull(), F.lit(None).cast("string")).when(z >= Z_CRITICAL, "critico")
            .when(z >= Z_NORMAL, "normal").otherwise("bueno"))


def severity(z: Column) -> Column:
    """By decades of the excess over the cut."""
    e = z / Z_CRITICAL
    return F.when(e >= EXCESS_HIGH, "alta").when(e >= EXCESS_MEDIUM, "media").otherwise("baja")


def scored(points: DataFrame, keys: list[str], ts: str = "bucket", value: str = "value", window: int = WINDOW, run: int = RUN,
           least: int | Column | None = None, rel=0.0, floor=0.0, bucket_seconds: int = 86400, chunk_rows: int = 4096) -> DataFrame:
    """W1 + W2 + W4 over every series in one plan.

    A run reaches ``run`` exactly when this row and the ``run - 1`` before it
    are critical and the one before those is not, so a frame of ``run`` rows is
    enough and no whole-series run number is needed. The halo covers both the
    baseline window and the run, hence a hot series is split into chunks.
    """
    cut, w = local_frames(points, keys, ts, bucket_seconds, window + run, chunk_rows=chunk_rows)
    df = score(baseline(cut, w.rowsBetween(-window, -1), value, window if least is None else least, rel, floor), value)
    # rows whose baseline frame is not whole inside this chunk are halo rows that the run test never reads
    crit = F.coalesce(F.col("state") == "critico", F.lit(False)).cast("int")
    df = df.withColumn("_c", crit)
    in_run = F.sum("_c").over(w.rowsBetween(-(run - 1), 0))
    opens = (in_run == run) & (F.coalesce(F.lag("_c", run).over(w), F.lit(0)) == 0)
    return df.withColumn("opens", opens).where("own").drop("chunk", "own", "_c", "_ok")


def events(scores: DataFrame) -> DataFrame:
    return scores.where("opens").withColumn("severity", severity(F.col("z")))


def latest_events(scores: DataFrame, keys: list[str], ts: str = "bucket", least_rows: int = WINDOW + RUN) -> DataFrame:
    """The last event of every series that is long enough (P15), with frozen baseline."""
    row = F.struct(F.col(ts).alias("start"), "value", "med", "scale", "z", severity(F.col("z")).alias("severity"))
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.max_by(F.when(F.col("opens"), row), F.when(F.col("opens"), F.col(ts))).alias("e")).where(
        (F.col("points") >= least_rows) & F.col("e").isNotNull()).select(
        *keys, "points", "e.start", "e.value", "e.med", "e.scale", "e.z", "e.severity")


def detect(level: DataFrame, signals: DataFrame, window: int = WINDOW, run: int = RUN, bucket_seconds: int = 86400) -> DataFrame:
    """A whole cycle's findings: points of every signal, rates for counters, baseline, persistence, last event."""
    from . import series as S
    from .signals import watched
    pts = watched(level, signals)
    keys = ["asset_id", "metric", "signal", "group_value", "filters_text", "kind", "floor", "group_dim"]
    gauges = pts.where("kind = 'medida'").select(*keys, "bucket", "value")
    rates = S.rate(pts.where("kind = 'acumulada'").select(*keys, "bucket", "value"), keys, bucket_seconds=bucket_seconds)
    both = gauges.unionByName(rates.select(*keys, "bucket", "value"))
    found = latest_events(scored(both, keys, window=window, run=run, floor=F.col("floor"), bucket_seconds=bucket_seconds),
                          keys, least_rows=window + run)
    filters = F.from_json("filters_text", "map<string,string>")
    own = F.when(F.col("group_dim").isNotNull(), F.create_map(F.col("group_dim"), F.col("group_value")))
    dims = F.when(own.isNull(), filters).otherwise(F.map_concat(filters, own))
    evidence = F.struct(F.lit(window).alias("ventana"), F.lit(run).alias("persistencia"),
                        F.col("value").alias("valor_observado"), F.col("med").alias("valor_esperado"),
                        F.struct(F.col("med").alias("mediana"), F.col("scale").alias("escala")).alias("linea_base"),
                        F.col("floor").alias("piso"), F.lit("mad-v2").alias("metodo"), F.col("signal").alias("senal"),
                        F.col("kind").alias("clase"), F.lit(60).alias("resolucion_s"))
    return found.select("asset_id", "metric", "signal", dims.alias("dims"), "start", "severity", F.col("z").alias("score"),
                        evidence.alias("evidence"))


def fresh(found: DataFrame, as_of: Column, minutes: int = 30, backfill: bool = False) -> DataFrame:
    """P19."""
    return found if backfill else found.where(F.col("start") >= as_of - F.expr(f"interval {minutes} minutes"))


def not_degraded(df: DataFrame, degraded: DataFrame) -> DataFrame:
    """Lack of data is neither an anomaly nor normality."""
    return df.join(degraded.select("asset_id").distinct(), "asset_id", "left_anti")


def not_registered(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """No second row for a series with an open anomaly, nor for a known (series, start) in any state.

    Two equi anti-joins: an OR in one condition would force a nested loop.
    """
    open_ones = known.where(F.col("end").isNull() & ~F.col("state").isin(*TERMINAL_STATES)).select(*keys).distinct()
    same = known.select(*keys, "start").distinct()
    return found.join(open_ones, keys, "left_anti").join(same, [*keys, "start"], "left_anti")


def coverage(assets: DataFrame, signals: DataFrame, seen: DataFrame, points: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """What each signal finds on each asset.

    ``seen``: asset_id, metric, dim_names (array); ``points``: asset_id, signal, n.
    The report has one row per asset and signal; the signals travel as one
    array in one row.
    """
    listed = signals.agg(F.collect_list(F.struct("metric", "signal", "kind", "filters", "group_dim")).alias("_s"))
    grid = assets.select("asset_id").join(listed, F.lit(True)).select("asset_id", F.explode("_s").alias("_s")).select("asset_id", "_s.*")
    need = F.lit(window + run) + F.when(F.col("kind") == "acumulada", 1).otherwise(0)
    used = F.array_compact(F.concat(F.map_keys("filters"), F.array("group_dim")))
    n = F.coalesce("n", F.lit(0))
    state = (F.when(F.col("dim_names").isNull(), "falta la metrica")
             .when(F.size(F.array_except(used, "dim_names")) > 0, "dimension no valida")
             .when(n == 0, "sin datos").when(n < need, "historial corto").otherwise("ok"))
    return grid.join(seen, ["asset_id", "metric"], "left").join(points, ["asset_id", "signal"], "left").select(
        "asset_id", "signal", state.alias("status"), n.alias("points"))


def unwatched(seen: DataFrame, signals: DataFrame) -> DataFrame:
    """Metrics that arrive and no signal reads."""
    return seen.select("asset_id", "metric").distinct().join(signals.select("metric").distinct(), "metric", "left_anti")


# ---- fixed values: name, least history, relative floor, absolute floor used
SETTINGS = [
    ("mad-v1 (historia 5, sin piso)", 5, 0.0, False),
    ("Historia completa, sin piso", 60, 0.0, False),
    ("Historia completa + piso absoluto (mad-v2)", 60, 0.0, True),
    ("mad-v2 + piso relativo 0,5 %", 60, 0.005, True),
    ("mad-v2 + piso relativo 1 %", 60, 0.01, True),
    ("mad-v2 + piso relativo 2 %", 60, 0.02, True),
    ("mad-v2 + piso relativo 5 %", 60, 0.05, True),
]
# ---- end of fixed values


def sweep(points: DataFrame, keys: list[str], injections: DataFrame, ts: str = "bucket", bucket_seconds: int = 86400,
          margin_minutes: int = 5, settings=None, run: int = RUN) -> DataFrame:
    """Events, hits, noise, injections found and high hits for every setting.

    The setting is part of the series key, so all settings share one plan; the
    copies are made by an explode of a literal array of seven entries. An event belongs to an injection as in J3, so one
    without an end counts from its start to the margin.
    """
    arr = F.array(*[F.struct(F.lit(n).alias("setting"), F.lit(h).alias("least"), F.lit(r).alias("rel"), F.lit(a).alias("abs"))
                    for n, h, r, a in (settings or SETTINGS)])
    many = points.withColumn("_s", F.explode(arr)).select("*", "_s.*").drop("_s")
    floor = F.when(F.col("abs"), F.col("floor")).otherwise(0.0)
    sc = scored(many, [*keys, "setting"], ts, run=run, least=F.col("least"), rel=F.col("rel"), floor=floor, bucket_seconds=bucket_seconds)
    ev = events(sc).withColumn("event_id", F.xxhash64(*keys, "setting", ts))
    until = F.coalesce("end", "start") + F.expr(f"interval {margin_minutes} minutes")
    inj = injections.select("asset_id", "uid", F.col("start").alias("_s"), until.alias("_e"))
    hit = overlap_join(ev, inj, "asset_id", ts, "_s", "_e", "left")
    one = hit.groupBy("setting", "event_id", "severity").agg(F.min("uid").alias("uid"))
    return one.groupBy("setting").agg(
        F.count(F.lit(1)).alias("events"), F.count("uid").alias("inside"), F.count_if(F.col("uid").isNull()).alias("noise"),
        F.count_distinct("uid").alias("found"),
        F.count_if((F.col("severity") == "alta") & F.col("uid").isNotNull()).alias("high_inside"))
