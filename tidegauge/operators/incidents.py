"""Open anomalies: closing, listing, marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import TERMINAL_STATES
from .detect import Z_CRITICAL
from .ordered import shifted

# ---- fixed values
CALM_POINTS = 15
CLOSING_FLOOR = 0.05
# ---- end of fixed values


def closings(open_anomalies: DataFrame, points: DataFrame, keys: list[str], ts: str = "bucket", value: str = "value", step: int = 60,
             calm: int = CALM_POINTS, slack: int = 1, bucket_seconds: int = 86400) -> DataFrame:
    """``anomaly_id, end`` of the anomalies whose series is normal again.

    ``open_anomalies``: anomaly_id, keys, start, med, scale (both frozen).
    The previous instant is taken once per series, before the join, so the
    rest is filters and mergeable aggregates: nothing orders the whole tail.
    """
    prev = shifted(points.select(*keys, ts, value), keys, ts, bucket_seconds, {"_pt": (ts, 1), "_pv": (value, 1)}).drop("pos")
    usable = open_anomalies.where("scale is not null and scale > 0 and med is not null")
    on = keys
    tail = prev.join(usable.select("anomaly_id", *keys, "start", "med", "scale"), on).where(F.col(ts) > F.col("start"))
    scale = F.greatest("scale", F.lit(CLOSING_FLOOR) * F.abs("med"))
    good = lambda v: (v - F.col("med")) / scale < Z_CRITICAL
    t = lambda c: F.unix_micros(c) / 1000000
    seam = (F.col("_pt").isNull() | (F.col("_pt") <= F.col("start")) | ~good(F.col("_pv"))
            | (t(ts) - t("_pt") > (slack + 1) * step))
    tail = tail.withColumn("_good", good(F.col(value))).withColumn("_seam", seam)
    newest = W.partitionBy("anomaly_id").orderBy(F.col(ts).desc())
    last = tail.withColumn("_rk", F.row_number().over(newest)).where(F.col("_rk") <= calm).groupBy("anomaly_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and("_good").alias("_all"), F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    last = last.where((F.col("_n") == calm) & F.col("_all") & (t("_to") - t("_from") <= (calm - 1 + slack) * step))
    return tail.join(last, "anomaly_id").where(F.col("_seam") & (F.col(ts) <= F.col("_from"))).groupBy("anomaly_id").agg(
        F.max(ts).alias("end"))


def apply_closings(anomalies: DataFrame, closed: DataFrame) -> DataFrame:
    """Close only what is still open; a mark of the operator is never overwritten."""
    c = closed.select("anomaly_id", F.col("end").alias("_end"))
    may = F.col("end").isNull() & ~F.col("state").isin(*TERMINAL_STATES) & F.col("_end").isNotNull()
    j = anomalies.join(c, "anomaly_id", "left")
    new = {"state": F.when(may, "cerrada").otherwise(F.col("state")), "end": F.when(may, F.col("_end")).otherwise(F.col("end"))}
    return j.select(*[new[c].alias(c) if c in new else c for c in anomalies.columns])


def apply_marks(anomalies: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks``: anomaly_id, mark, user, at. Terminal rows stay; the earliest mark that applies wins,
    later ones follow while the state is not terminal (a confirmed row can still be discarded)."""
    m = marks.groupBy("anomaly_id").agg(
        F.min_by(F.when(F.col("mark").isin(*TERMINAL_STATES), F.struct("mark", "user", "at")),
                               F.when(F.col("mark").isin(*TERMINAL_STATES), F.struct("at", "mark"))).alias("t"),
        F.max_by(F.struct("mark", "user", "at"), F.struct("at", "mark")).alias("l"))
    pick = F.coalesce("t", "l")
    j = anomalies.join(m.select("anomaly_id", pick.alias("m")), "anomaly_id", "left")
    may = F.col("m").isNotNull() & ~F.col("state").isin(*TERMINAL_STATES)
    return (j.withColumn("marked_by", F.when(may, F.col("m.user")).otherwise(F.col("marked_by")))
            .withColumn("marked_at", F.when(may, F.col("m.at")).otherwise(F.col("marked_at")))
            .withColumn("state", F.when(may, F.col("m.mark")).otherwise(F.col("state"))).select(*anomalies.columns))


def apply_diagnoses(anomalies: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """A detected anomaly with a diagnosis becomes ``diagnosticada``; other states stay."""
    d = diagnoses.select("anomaly_id").distinct().withColumn("_d", F.lit(True))
    j = anomalies.join(d, "anomaly_id", "left")
    return j.withColumn("state", F.when((F.col("state") == "detectada") & F.col("_d"), "diagnosticada").otherwise(
        F.col("state"))).select(*anomalies.columns)


def severity_rank(c: Column) -> Column:
    return F.when(c == "alta", 0).when(c == "media", 1).when(c == "baja", 2).otherwise(3)


def incident_list(anomalies: DataFrame, diagnoses: DataFrame, *, state=None, asset=None, start: Column | None = None,
                  end: Column | None = None, limit: int | None = 500, open_first: bool = False) -> DataFrame:
    """P16 + J4 + K1: filtered, with ``has_diagnosis``, by severity then newest; the list view puts open ones first."""
    df = anomalies
    if state is not None:
        df = df.where(F.col("state") == state)
    if asset is not None:
        df = df.where(F.col("asset_id") == asset)
    if end is not None:
        df = df.where(F.col("start") <= end)
    if start is not None:
        df = df.where(F.col("end").isNull() | (F.col("end") >= start))
    d = diagnoses.select("anomaly_id").distinct().withColumn("_d", F.lit(True))
    df = df.join(d, "anomaly_id", "left").withColumn("has_diagnosis", F.col("_d").isNotNull()).drop("_d")
    first = [(F.col("end").isNotNull() | F.col("state").isin(*TERMINAL_STATES)).cast("int")] if open_first else []
    df = df.orderBy(*first, severity_rank(F.col("severity")), F.desc("start"), F.desc("anomaly_id"))
    return df.limit(limit) if limit else df


def awaiting_diagnosis(anomalies: DataFrame, diagnoses: DataFrame, as_of: Column, severities=("alta", "media"), minutes: int = 30) -> DataFrame:
    """P17 + J5."""
    df = anomalies.where((F.col("state") == "detectada") & F.col("severity").isin(*severities)
                         & (F.col("detected_at") >= as_of - F.expr(f"interval {minutes} minutes")))
    return df.join(diagnoses.select("anomaly_id").distinct(), "anomaly_id", "left_anti").orderBy("detected_at", "anomaly_id")


def with_latest_diagnosis(anomalies: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Latest by generated, then id."""
    cols = [c for c in diagnoses.columns if c != "anomaly_id"]
    last = diagnoses.groupBy("anomaly_id").agg(F.max_by(F.struct(*cols), F.struct("generated", "diagnosis_id")).alias("d"))
    return anomalies.join(last, "anomaly_id", "left").select(*anomalies.columns, *[F.col(f"d.{c}").alias(c) for c in cols])


def diagnosis_delay(anomalies: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Seconds from detection to the first diagnosis; null without a detection time."""
    first = diagnoses.groupBy("anomaly_id").agg(F.min("generated").alias("_g"))
    return anomalies.join(first, "anomaly_id").select(
        "anomaly_id", "detected_at", ((F.unix_micros("_g") - F.unix_micros("detected_at")) / 1000000).alias("seconds"))


def public_interval(anomalies: DataFrame, as_of: Column, minutes: Column) -> DataFrame:
    """start minus the baseline window to the end (or now), never before the start."""
    m = F.when(minutes > 0, minutes).otherwise(60)
    return anomalies.withColumn("interval_from", F.timestamp_micros(F.unix_micros("start") - m.cast("bigint") * 60000000)).withColumn(
        "interval_to", F.greatest(F.coalesce("end", as_of), F.col("start")))
