"""Series requests: range, level and step, completeness, rates, down-sampling, chart alignment."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import as_lit, bucket, ceil_py, check_range, floor_py
from . import rollup
from .ordered import shifted

# ---- fixed values
STEPS = (60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400)
TARGET_POINTS = 1500
EXPECTED = {"1m": 6, "1h": 360}
MAX_GROUPS = 8
RAW_STEP = 10
# ---- end of fixed values
BASE_STEP = {"raw": RAW_STEP, "1m": 60, "1h": 3600}


def level_for(start: datetime, end: datetime) -> str:
    span = end - start
    return "raw" if span <= timedelta(hours=24) else "1m" if span <= timedelta(days=30) else "1h"


def step_for(level: str, start: datetime, end: datetime) -> int:
    if level == "raw":
        return RAW_STEP
    least = max(BASE_STEP[level], (end - start).total_seconds() / TARGET_POINTS)
    return next((s for s in STEPS if s >= least), STEPS[-1])


def in_range(df: DataFrame, start: datetime, end: datetime, ts: str = "ts") -> DataFrame:
    """Half-open range; where the data has a ``date`` partition column the partitions are pruned too."""
    out = df.where((F.col(ts) >= as_lit(start)) & (F.col(ts) < as_lit(end)))
    if "date" in df.columns:
        out = out.where(F.col("date").between(F.lit(start.date()), F.lit(end.date())))
    return out


def aligned(start: datetime, end: datetime, step: int, raw: bool) -> tuple[datetime, datetime]:
    """Raw floors both ends, summaries floor the start and raise the end."""
    a = floor_py(start, step)
    z = floor_py(end, step) if raw else ceil_py(end, step)
    return a, (z if z > a else a + timedelta(seconds=step))


def with_filters(df: DataFrame, filters: dict[str, str], known: list[str] | None = None) -> DataFrame:
    """Dimension equality; a dimension the metric does not have is an error."""
    for k, v in (filters or {}).items():
        if known is not None and k not in known:
            raise ValueError(f"no dimension {k!r}; has: {', '.join(known) or 'none'}")
        df = df.where(F.col("dims")[k] == v)
    return df


def top_groups(df: DataFrame, group: str, n: int = MAX_GROUPS) -> DataFrame:
    """First ``n`` groups by label, null last (W17). Ranks the labels, not the rows."""
    labels = df.select(F.col(group).alias("_label")).distinct().orderBy(F.col("_label").isNull(), "_label").limit(n)
    return df.join(F.broadcast(labels), F.col(group).eqNullSafe(F.col("_label")), "left_semi")


def omitted_groups(df: DataFrame, group: str, n: int = MAX_GROUPS) -> DataFrame:
    return df.select(group).distinct().agg(F.greatest(F.lit(0), F.count(F.lit(1)) - n).alias("omitted"))


def binned(points: DataFrame, step: int, keys: list[str], group: Column | None = None) -> DataFrame:
    """A1: mean per epoch-aligned bin; the null group is a group."""
    g = [group.alias("group")] if group is not None else []
    return points.groupBy(*keys, *g, bucket(F.col("ts"), step).alias("bucket")).agg(F.avg("value").alias("value"))


def rebucketed(level: DataFrame, step: int, keys: list[str], per_row: int, group: Column | None = None) -> DataFrame:
    """A4: weighted mean on a coarser step; incomplete if any summary row holds fewer samples than due."""
    g = [group.alias("group")] if group is not None else []
    return level.groupBy(*keys, *g, bucket(F.col("bucket"), step).alias("bucket")).agg(
        rollup.weighted_mean().alias("value"), F.min("value_count").alias("least"),
        (F.min("value_count") < per_row).alias("incomplete"))


def empty_intervals(bins: DataFrame, keys: list[str], start: Column, limit: Column, step: int, day: int = 86400) -> DataFrame:
    """A5: empty bins inside gaps longer than two steps, with the leading and the trailing gap.

    Gap lengths come from ``lag``; the two ends come from min and max, so no
    sentinel rows are needed. Keys without any bin are not in the output: they
    count as wholly empty, which the caller fills in from its key list.
    """
    inside = bins.where((F.col("bucket") >= start) & (F.col("bucket") < limit)).select(*keys, "bucket").distinct()
    lagged = shifted(inside, keys, "bucket", day, {"prev": ("bucket", 1)})
    s = lambda c: F.unix_seconds(c)
    missing = lambda d: F.when(d > 2 * step, F.floor(d / step) - 1).otherwise(0)
    gap = s(F.col("bucket")) - s(F.col("prev"))
    return lagged.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.when(F.col("prev").isNotNull(), missing(gap))), F.lit(0))
         + missing(s(F.min("bucket")) - s(start) + step) + missing(s(limit) - s(F.max("bucket")))
         ).cast("bigint").alias("empty"),
        F.count(F.lit(1)).alias("with_data"))


def sample_gaps(points: DataFrame, keys: list[str], start: Column, end: Column, longer_than: int = 20, day: int = 86400) -> DataFrame:
    """Every gap longer than the limit between distinct instants, range ends included."""
    t = points.where((F.col("ts") >= start) & (F.col("ts") < end)).select(*keys, "ts").distinct()
    near = shifted(t, keys, "ts", day, {"prev": ("ts", 1), "next": ("ts", -1)})
    gaps = near.select(*keys, F.explode(F.array_compact(F.array(
        F.struct(F.coalesce("prev", start).alias("gap_from"), F.col("ts").alias("gap_to")),
        F.when(F.col("next").isNull(), F.struct(F.col("ts").alias("gap_from"), end.alias("gap_to")))))).alias("g"))
    secs = (F.unix_micros("g.gap_to") - F.unix_micros("g.gap_from")) / 1000000
    return gaps.select(*keys, "g.gap_from", "g.gap_to", secs.alias("seconds")).where(F.col("seconds") > longer_than)


def rate(series: DataFrame, keys: list[str], ts: str = "bucket", value: str = "value", bucket_seconds: int = 86400) -> DataFrame:
    """Counter to rate per second. The first point, resets and repeated instants give no row."""
    s = shifted(series, keys, ts, bucket_seconds, {"_t0": (ts, 1), "_v0": (value, 1)})
    dt = (F.unix_micros(F.col(ts)) - F.unix_micros("_t0")) / 1000000
    dv = F.col(value) - F.col("_v0")
    return s.where((dt > 0) & (dv >= 0)).withColumn(value, dv / dt).drop("_t0", "_v0", "pos")


def rate_per_asset(series: DataFrame, keys: list[str], over: list[str], ts="bucket", value="value", bucket_seconds=86400) -> DataFrame:
    """Rate of each series alone, then the sum; a bucket without any rate is null, not 0."""
    s = shifted(series, keys, ts, bucket_seconds, {"_t0": (ts, 1), "_v0": (value, 1)})
    r = (F.col(value) - F.col("_v0")) / ((F.unix_micros(F.col(ts)) - F.unix_micros("_t0")) / 1000000)
    return s.withColumn("_r", F.when(r >= 0, r)).groupBy(*over, ts).agg(F.sum("_r").alias(value))


def peaks(series: DataFrame, keys: list[str], ts: str, value: str, n: int = 180, bucket_seconds: int = 86400) -> DataFrame:
    """At most ``n`` points per key, the highest (first on a tie) of each of n equal slices.

    Slice i holds the rows whose 0-based index is in [int(i*step), int((i+1)*step)).
    """
    from .ordered import with_position
    placed = with_position(series, keys, ts, bucket_seconds)
    size = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = placed.join(size, keys)
    i, step = F.col("pos") - 1, F.col("_n") / n
    guess = F.least(F.lit(n - 1), F.floor(i / step))
    lower = F.when(F.floor(guess * step) > i, guess - 1).when(F.floor((guess + 1) * step) <= i, guess + 1).otherwise(guess)
    slot = F.when(F.col("_n") <= n, i).otherwise(F.least(F.lit(n - 1), lower))
    best = F.max_by(F.struct(ts, value), F.struct(F.col(value), -F.unix_micros(F.col(ts))))
    return j.withColumn("slot", slot.cast("bigint")).groupBy(*keys, "slot").agg(best.alias("b")).select(
        *keys, "slot", f"b.{ts}", f"b.{value}")


def every(df: DataFrame, keys: list[str], ts: str, n: int, bucket_seconds: int = 86400, ties=None) -> DataFrame:
    """Rows at indexes int(i * len / n), i < n; all rows when there are at most n."""
    from .ordered import with_position
    placed = with_position(df, keys, ts, bucket_seconds, ties)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j, i = placed.join(size, keys), F.col("pos") - 1
    # index i is picked when some whole k < n has floor(k*len/n) = i
    k = F.ceil(i * F.lit(n) / F.col("_n"))
    hit = (k < n) & (F.floor(k * F.col("_n") / n) == i)
    return j.where((F.col("_n") <= n) | hit).drop("_n")


def chart_rows(series: DataFrame, keys: list[str], label: str, ts: str, value: str, step: int = RAW_STEP,
               gap_seconds: int = 20, bucket_seconds: int = 86400) -> DataFrame:
    """Every (instant, label) of a chart, null where a label has no point.

    Instants are the union over the labels; after a gap longer than the limit
    there is one more instant, a step after the last point, with only nulls.
    """
    spine = shifted(series.select(*keys, ts).distinct(), keys, ts, bucket_seconds, {"_next": (ts, -1)})
    late = F.unix_micros("_next") - F.unix_micros(F.col(ts)) > gap_seconds * 1000000
    instants = spine.select(*keys, F.explode(F.array_compact(F.array(
        F.col(ts), F.when(late, F.col(ts) + F.expr(f"interval {step} seconds"))))).alias(ts))
    labels = series.select(*keys, label).distinct()
    if keys:
        grid = instants.join(labels, keys)
    else:
        # one chart: its labels (at most 8 after top_groups) travel as one array
        grid = instants.join(labels.agg(F.collect_list(label).alias("_ls")), F.lit(True)).withColumn(label, F.explode("_ls")).drop("_ls")
    known = series.select(*[F.col(c).alias(f"_{c}") for c in (*keys, label, ts)], value)
    on = (F.col(ts) == F.col(f"_{ts}")) & F.col(label).eqNullSafe(F.col(f"_{label}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return grid.join(known, on, "left").select(*keys, ts, label, value)


def metrics_seen(points: DataFrame, asset: str, since: Column) -> DataFrame:
    """A7."""
    return points.where((F.col("asset_id") == asset) & (F.col("ts") >= since)).select("metric").distinct()


def dimension_values(points: DataFrame, keys: list[str], n: int = 100) -> DataFrame:
    """The first ``n`` values of each dimension, in order.

    Values are made distinct before they are ranked, and the rank limit is
    applied on the map side, so a dimension with very many values never sits
    in one task.
    """
    flat = points.select(*keys, F.explode("dims").alias("dim", "val")).distinct()
    w = W.partitionBy(*keys, "dim").orderBy("val")
    return flat.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")


def series(points_raw: DataFrame, points_1m: DataFrame, points_1h: DataFrame, asset: str, metric: str, start: datetime,
           end: datetime, *, group: str | None = None, filters: dict | None = None, known: list[str] | None = None,
           as_of: datetime | None = None):
    """A series request. Returns ``(points, summary)``.

    The level and the step follow from the length of the range; the summary
    frame has one row: expected, empty, incomplete, omitted, step, level.
    """
    check_range(start, end, 180)
    level = level_for(start, end)
    step = step_for(level, start, end)
    a, z = aligned(start, end, step, level == "raw")
    source = {"raw": points_raw, "1m": points_1m, "1h": points_1h}[level]
    t = "ts" if level == "raw" else "bucket"
    rows = in_range(source.where((F.col("asset_id") == asset) & (F.col("metric") == metric)), a, z, t)
    if known is not None and group and group not in known:
        raise ValueError(f"no dimension {group!r}; has: {', '.join(known) or 'none'}")
    rows = with_filters(rows, filters or {}, known)
    label = F.col("dims")[group] if group else F.lit(None).cast("string")
    if level == "raw":
        pts = binned(rows, step, [], label).withColumn("incomplete", F.lit(False))
    else:
        pts = rebucketed(rows, step, [], EXPECTED[level], label).drop("least")
    limit = min(z, floor_py((as_of or z + timedelta(seconds=30)) - timedelta(seconds=30), step))
    limit = max(limit, a)
    due = int((limit - a).total_seconds() // step)
    seen = pts.where(F.col("bucket") < as_lit(limit))
    if level == "raw":
        void = empty_intervals(pts.withColumn("_k", F.lit(0)), ["_k"], as_lit(a), as_lit(limit), step)
        void = void.agg(F.coalesce(F.sum("empty"), F.lit(due)).alias("empty"))
    else:
        void = seen.agg(F.greatest(F.lit(0), F.lit(due) - F.count_distinct("bucket")).alias("empty"))
    incomplete = seen.where("incomplete").agg(F.count_distinct("bucket").alias("incomplete"))
    summary = void.join(incomplete, F.lit(True)).join(omitted_groups(pts, "group"), F.lit(True)).select(
        F.lit(level).alias("level"), F.lit(step).alias("step"), F.lit(due).alias("expected"), "empty", "incomplete", "omitted")
    return top_groups(pts, "group"), summary


def with_health(summary: DataFrame, health: DataFrame, asset: str) -> DataFrame:
    """Flag an answer whose source is silent. No ledger row, no flag."""
    mine = health.where(F.col("asset_id") == asset).select(
        F.col("last_seen").alias("source_last_seen"), (F.col("state") == "degradado").alias("source_degraded"))
    return summary.join(mine, F.lit(True), "left").fillna({"source_degraded": False})
