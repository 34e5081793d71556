"""Evidence for incidents: windows, summaries, related signals, citations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import significant
from . import logs as L
from . import signals as S
from .evaluate import overlap_join
from .series import every, peaks

# ---- fixed values
MAX_POINTS, MAX_RELATED, MAX_LOGS, MAX_TRACES, MAX_PAIRS = 180, 3, 50, 20, 50
PACK_POINTS, PACK_LOGS, PACK_TRACES, PACK_PAIRS, PACK_TEXT = 60, 15, 10, 15, 300
# ---- end of fixed values
PACKED = PACK_LOGS, PACK_TRACES, PACK_PAIRS
LONGEST = 15000  # seconds: an hour before, three hours and ten minutes after the start
STATS = "before_median double, during_median double, during_min double, during_max double, points_before bigint, points_during bigint"


def _ago(interval: str) -> Column:
    return F.expr(f"interval {interval}")


def windows(incidents: DataFrame, as_of: Column) -> DataFrame:
    """F16: adds metrics_from, logs_from, until, during_to. Nothing goes past now or three hours after the start."""
    s = F.col("start")
    eff = F.least(F.coalesce("end", as_of), as_of, s + _ago("3 hours"))
    until = F.least(eff + _ago("10 minutes"), as_of)
    return (incidents.withColumn("metrics_from", s - _ago("60 minutes")).withColumn("logs_from", s - _ago("10 minutes"))
            .withColumn("until", F.when(until <= s, s + _ago("1 minute")).otherwise(until))
            .withColumn("during_to", F.greatest(eff, s + _ago("1 minute"))))


def incident_points(incidents: DataFrame, points: DataFrame, ts: str = "bucket", width: int = 86400) -> DataFrame:
    """Points of every incident's own series in its window: (asset, metric) and time slice are the join key."""
    inc = windows_ready(incidents).select("anomaly_id", F.concat_ws("|", "asset_id", "metric").alias("_am"), "metrics_from",
                                          (F.col("until") - F.expr("interval 1 microsecond")).alias("_until"), "start", "during_to")
    p = points.select(F.concat_ws("|", "asset_id", "metric").alias("_am"), ts, "value")
    return overlap_join(p, inc, "_am", ts, "metrics_from", "_until", width=width).drop("_am", "_until", "metrics_from")


def windows_ready(incidents: DataFrame) -> DataFrame:
    if "until" not in incidents.columns:
        raise ValueError("call windows() first")
    return incidents


def summary(rows: DataFrame, keys: list[str], ts: str = "bucket", value: str = "value") -> DataFrame:
    """Before / during medians and extremes; change is measured on the MAX.

    A group is one incident window (at most 4 h 10 min of one series), so the
    exact percentile buffer is bounded.
    """
    before, during = F.col(ts) < F.col("start"), (F.col(ts) >= F.col("start")) & (F.col(ts) <= F.col("during_to"))
    b, d = F.when(before, F.col(value)), F.when(during, F.col(value))
    g = rows.groupBy(*keys).agg(
        F.percentile(b, F.lit(0.5)).alias("before_median"), F.percentile(d, F.lit(0.5)).alias("during_median"), F.min(d).alias("during_min"),
        F.max(d).alias("during_max"), F.count(b).alias("points_before"), F.count(d).alias("points_during"))
    return _with_changes(g)


def _with_changes(g: DataFrame) -> DataFrame:
    base = F.abs(F.nullif("before_median", F.lit(0.0)))
    return (g.withColumn("change_abs", F.col("during_max") - F.col("before_median"))
            .withColumn("change_rel", (F.col("during_max") - F.col("before_median")) / base)
            .withColumn("change_rel_median", (F.col("during_median") - F.col("before_median")) / base))


def _median(x: np.ndarray) -> float | None:
    if not len(x):
        return None
    a, b = (len(x) - 1) // 2, len(x) // 2
    y = np.partition(x, (a, b))
    return float(y[a] if a == b else 0.5 * y[a] + 0.5 * y[b])


def _measured(keys: list[str]):
    """A function of the points of one series and slice and the windows that begin in it: a row for each window and label with points."""
    def rates(t, v, has):
        r = np.diff(v) / (np.diff(t) / 1e6)
        return np.r_[False, has[1:] & has[:-1] & ((r >= 0) | np.isnan(r))], np.r_[np.nan, r]

    def run(p: pa.Table, w: pa.Table) -> pa.Table:
        labels = p["_l"].combine_chunks().dictionary_encode() if len(p) and len(w) else None
        rows, named, out = [], [], []
        if labels is not None:
            t, v = p["_t"].to_numpy(), p["_v"].to_numpy().astype("float64")
            counter = w["_c"][0].as_py()
            has, code = p["_v"].is_valid().to_numpy(), labels.indices.to_numpy()
            a, z, s, d = (w[c].to_numpy() for c in ("_a", "_z", "_s", "_d"))
            for label in range(len(labels.dictionary)):
                at = np.flatnonzero(code == label)
                at = at[np.argsort(t[at], kind="stable")]
                time, value, ok = t[at], v[at], has[at]
                lo, hi = np.searchsorted(time, a), np.searchsorted(time, z)
                if counter:
                    ok, value = rates(time, value, ok)
                    lo = np.minimum(lo + 1, hi)
                # among the points that count: from, start, end of the fault, end of the window
                seen = np.r_[0, np.cumsum(ok)]
                start, end = np.clip(np.searchsorted(time, s), lo, hi), np.clip(np.searchsorted(time, d, "right"), lo, hi)
                i, j, k = seen[lo], seen[start], seen[np.maximum(start, end)]
                value = value[ok]
                met = seen[hi] > i if counter else hi > lo
                for n in np.flatnonzero(met):
                    b, m = value[i[n]:j[n]], value[j[n]:k[n]]
                    rows.append(n)
                    named.append(labels.dictionary[label])
                    out.append((_median(b), _median(m), float(np.fmin.reduce(m)) if len(m) else None, float(m.max()) if len(m) else None, len(b), len(m)))
        kept = w.select(keys).take(pa.array(rows, pa.int64()))
        cols = list(zip(*out)) or [()] * 6
        types = [pa.float64()] * 4 + [pa.int64()] * 2
        return pa.table([*kept.columns, pa.array(named, pa.string()), *[pa.array(c, y) for c, y in zip(cols, types)]],
                        names=[*keys, "label", *[c.split()[0] for c in STATS.split(", ")]])
    return run


def _by_slices(windows_: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, label and the values of :func:`summary` for windows of at most ``LONGEST`` seconds.

    ``windows_``: keys, _k and _a <= time < _z, _s, _d in microseconds, and _c, whether the series is a counter: its values are the rates
    between the points of a window, the first has none, and a fall counts for none. ``points``: _k, _l, _t, _v. Time is cut in slices as
    long as the longest window, and a point goes to its own slice and the one before, so every window finds all its points in the slice it
    begins in. Pairs of points and windows are never made: a task sorts the points of a slice once, and a window is two places in them.
    """
    width = LONGEST * 1_000_000
    home = lambda c: F.floor(F.col(c) / width)
    p = points.select("_k", "_l", "_t", F.col("_v").cast("double").alias("_v"), F.explode(F.array(home("_t"), home("_t") - 1)).alias("_w"))
    w = windows_.select(*keys, "_k", "_a", "_z", "_s", "_d", "_c", home("_a").alias("_w"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in w.select(*keys).schema)
    return p.groupBy("_k", "_w").cogroup(w.groupBy("_k", "_w")).applyInArrow(_measured(keys), f"{kinds}, label string, {STATS}")


def _single(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The windows of ``rows``, one for each value of ``keys`` with the number ``_n`` of times it comes, and the rows of the keys that have
    several windows or one that is longer than the longest."""
    one = F.struct("_k", "_a", "_z", "_s", "_d", "_c")
    g = rows.groupBy(*keys).agg(F.min(one).alias("_one"), F.max(one).alias("_other"), F.count(F.lit(1)).alias("_n"))
    short = (F.col("_one") == F.col("_other")) & (F.col("_one._z") - F.col("_one._a") <= LONGEST * 1_000_000)
    rest = g.where(~short).select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return g.where(short).select(*keys, "_n", "_one.*"), rows.join(rest, same, "left_semi")


def incident_summaries(incidents: DataFrame, points: DataFrame, ts: str = "bucket", width: int = 86400) -> DataFrame:
    """:func:`summary` of :func:`incident_points` by incident, without their pairs."""
    us = F.unix_micros
    inc = windows_ready(incidents).where("metrics_from is not null and until is not null and start is not null and during_to is not null").withColumn("_k", F.concat_ws("|", "asset_id", "metric"))
    one, rest = _single(inc.withColumns({"_a": us("metrics_from"), "_z": us("until"), "_s": us("start"), "_d": us("during_to"), "_c": F.lit(False)}), ["anomaly_id"])
    p = points.where(F.col(ts).isNotNull()).select(F.concat_ws("|", "asset_id", "metric").alias("_k"), F.lit("").alias("_l"), us(ts).alias("_t"), F.col("value").alias("_v"))
    fast = _by_slices(one, p, ["anomaly_id", "_n"]).withColumns({c: F.col(c) * F.col("_n") for c in ("points_before", "points_during")}).drop("_n", "label")
    slow = summary(incident_points(rest, points, ts, width), ["anomaly_id"], ts)
    return _with_changes(fast).unionByName(slow)


def _labelled(hit: DataFrame) -> DataFrame:
    """The rows that belong to the signal beside them, with the label of their series."""
    group = F.when(F.col("group_dim").isNotNull(), F.try_element_at("dims", "group_dim"))
    plain = lambda m: F.array_join(F.sort_array(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    label = F.concat_ws(",", F.nullif(plain(F.col("filters")), F.lit("")), F.when(group.isNotNull(), F.concat("group_dim", F.lit("="), group)))
    return hit.where(S.matches(F.col("filters"), F.col("dims")) & ~S.excluded(F.col("exclude"), F.col("dims"))).withColumn("label", label)


def _mean() -> Column:
    return F.sum(F.col("value_avg") * F.col("value_count")) / F.sum("value_count")


def incident_series(incidents: DataFrame, level: DataFrame, signals: DataFrame, as_of: Column, ts: str = "bucket", width: int = 86400) -> DataFrame:
    """F22 + J16 + W16: the affected series of every incident and, for each signal that shares a fault with it, the series that
    changed most.

    ``incidents``: anomaly_id, asset_id, metric, dims, start, end; ``level``: a summary with ``dims``. The result has anomaly_id,
    role (afectada, relacionada), metric, signal, kind, unit, dims, rank and the values of :func:`summary`.
    An incident is expanded to the few signals it needs. The points of each asked series are found once, whichever incidents ask for
    them, and measured in slices of time. A counter becomes a rate from the points inside the window, whose first has none. Ids that come with several
    windows, or a longer one, go through an interval join instead.
    """
    inc = incidents if "until" in incidents.columns else windows(incidents, as_of)
    asked = inc.select(F.col("anomaly_id").alias("ask_id"), "metric", "dims")
    own = S.own_signals(signals, asked).select("ask_id", F.col("own.signal").alias("_os"), F.col("own.kind").alias("_ok"))
    none = F.create_map().cast("map<string,string>")
    affected = inc.join(own, F.col("anomaly_id") == F.col("ask_id"), "left").select(
        "anomaly_id", F.lit("afectada").alias("role"), "metric", F.coalesce("_os", "metric").alias("signal"), F.col("_ok").alias("kind"),
        F.coalesce("dims", none).alias("filters"), F.lit(None).cast("string").alias("group_dim"), none.alias("exclude"))
    named = signals.select(F.col("signal").alias("rel_signal"), "kind", "filters", "group_dim", "exclude")
    related = S.related(signals, asked).join(named, "rel_signal").select(
        F.col("ask_id").alias("anomaly_id"), F.lit("relacionada").alias("role"), F.col("rel_metric").alias("metric"), F.col("rel_signal").alias("signal"), "kind", "filters", "group_dim", "exclude")
    span = inc.select("anomaly_id", "asset_id", "start", "during_to", "metrics_from", (F.col("until") - _ago("1 microsecond")).alias("_until"))
    iv = affected.unionByName(related).join(span, "anomaly_id").withColumn("_am", F.concat_ws("|", "asset_id", "metric")).drop("asset_id")
    p = level.select(F.concat_ws("|", "asset_id", "metric").alias("_am"), ts, "dims", "value_avg", "value_count")
    counter = F.coalesce(F.col("kind") == "acumulada", F.lit(False))
    as_text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    asks = ["_am", "_f", "group_dim", "_e", "_c"]
    us = F.unix_micros
    iv = iv.where("metrics_from is not null and _until is not null and start is not null and during_to is not null").withColumns(
        {"_f": as_text("filters"), "_e": as_text("exclude"), "_c": counter}).withColumn("_k", F.md5(as_text(F.struct(*asks))))
    keys = ["anomaly_id", "role", "metric", "signal", "kind"]
    one, rest = _single(iv.withColumns({"_a": us("metrics_from"), "_z": us("_until") + 1, "_s": us("start"), "_d": us("during_to")}), keys)
    # the points of every asked series, whichever incidents ask for it
    as_map = lambda c: F.from_json(c, "map<string,string>")
    series = iv.select("_k", *asks).distinct().select("_k", "_am", "group_dim", "_c", as_map("_f").alias("filters"), as_map("_e").alias("exclude"))
    pts = _labelled(p.where(F.col(ts).isNotNull()).join(series, "_am")).groupBy("_k", "_c", F.col("label").alias("_l"), us(ts).alias("_t")).agg(_mean().alias("_v")).where("_c or _v is not null")
    fast = _by_slices(one, pts, keys)
    hit = _labelled(overlap_join(p, rest.select(*keys, "filters", "group_dim", "exclude", "start", "during_to", "metrics_from", "_until", F.col("_am")), "_am", ts, "metrics_from", "_until", width=width))
    keys = [*keys, "label"]
    pts = hit.groupBy(*keys, "start", "during_to", ts).agg(_mean().alias("value"))
    w = W.partitionBy(*keys, "start", "during_to").orderBy(ts)
    rate = (F.col("value") - F.lag("value").over(w)) / ((F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / 1000000)
    pts = pts.withColumn("_r", rate).withColumn("value", F.when(counter, F.when(F.col("_r") >= 0, F.col("_r"))).otherwise(F.col("value"))).where("value is not null")
    best = top_related(_with_changes(fast).unionByName(summary(pts, keys, ts)), ["anomaly_id", "role", "signal"], "label")
    return best.withColumn("unit", F.when(counter, "por segundo")).withColumnRenamed("label", "dims")


def with_series(records: DataFrame, series: DataFrame) -> DataFrame:
    """The records of :func:`evidence` with ``series``: the affected one first, then by signal and rank. A record has at most
    ``MAX_RELATED`` of each signal."""
    one = F.struct((F.col("role") != "afectada").alias("_o"), "signal", "rank", "role", "metric", "kind", "unit", "dims",
                   *[c for c in series.columns if c.startswith(("before_", "during_", "points_", "change_"))])
    s = series.groupBy("anomaly_id").agg(F.sort_array(F.collect_list(one)).alias("series"))
    return records.join(s, "anomaly_id", "left")


def top_related(summaries: DataFrame, keys: list[str], label: str, n: int = MAX_RELATED) -> DataFrame:
    """Per signal, the series that changed most: relative first, then absolute."""
    w = W.partitionBy(*keys).orderBy(F.abs(F.coalesce("change_rel", F.lit(0.0))).desc(), F.abs(F.coalesce("change_abs", F.lit(0.0))).desc(), label)
    return summaries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _top_per_incident(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The rank is cut on the map side before rows of one incident meet."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("anomaly_id").orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def _runs(lo: np.ndarray, take: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each window ``take`` places from ``lo`` on, each of them ``times`` times."""
    nth = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    return np.repeat(lo, take) + nth // np.repeat(times, take)


def _listed(at: list[int] | np.ndarray, rows: pa.Table) -> pa.ListArray:
    """The rows in lists; ``at`` has the length of each."""
    items = pa.StructArray.from_arrays([c.combine_chunks() for c in rows.columns], names=rows.column_names)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(at)], pa.int32()), items)


def _some(rows: np.ndarray) -> pa.Array:
    return pa.array(rows, pa.int64(), mask=rows < 0)


class _Traces:
    """The traces with errors among the spans of a slice; what a window holds of one is found without a look at the others."""

    def __init__(self, s: pa.Table):
        """``s``: spans by start, then id."""
        bad = s["_bad"].to_numpy().astype("int64")
        ids = s["trace_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        code, self.names = ids.indices.to_numpy(), ids.dictionary
        hot = np.flatnonzero(np.bincount(code, bad, len(self.names))[code] > 0) if len(s) else np.zeros(0, int)
        at = hot[np.argsort(code[hot], kind="stable")]
        self.t, self.bad, self.code = s["_t"].to_numpy()[at], bad[at], code[at]
        self.end = s["_e"].fill_null(-2**62).to_numpy()[at]
        self.top = np.where(s["_top"].to_numpy()[at], at, 2**62)
        self.a = np.flatnonzero(np.r_[True, self.code[1:] != self.code[:-1]]) if len(at) else np.zeros(0, int)
        self.z = np.r_[self.a[1:], len(at)] if len(at) else self.a
        order = np.argsort(self.t[self.a], kind="stable")
        self.a, self.z = self.a[order], self.z[order]
        self.first, self.last = self.t[self.a], self.t[self.z - 1]
        self.place = np.empty(len(self.names), int)
        self.place[pc.sort_indices(self.names, null_placement="at_start").to_numpy()] = np.arange(len(self.names))
        whole = [self.part(i, j) for i, j in zip(self.a, self.z)]
        self.whole = np.array(whole, "int64").reshape(-1, 6)
        self.rank = np.empty(len(whole), int)
        self.rank[np.lexsort((self.whole[:, 1], -self.whole[:, 0]))] = np.arange(len(whole))
        self.spread = np.flatnonzero(self.last > self.first)

    def part(self, i: int, j: int) -> tuple:
        """End, place among the ids, id, root, number and errors of some spans of a trace."""
        c, root = self.code[i], self.top[i:j].min()
        return self.end[i:j].max(), self.place[c], c, -1 if root == 2**62 else root, j - i, self.bad[i:j].sum()

    def inside(self, a: int, z: int, most: int) -> np.ndarray:
        """The latest ``most`` traces with errors in a window, from the spans that start in it."""
        lo, hi = np.searchsorted(self.first, (a, z))
        full = lo + np.flatnonzero(self.last[lo:hi] < z)
        if len(full) > most:
            full = full[np.argpartition(self.rank[full], most - 1)[:most]]
        rows = self.whole[full]
        s = self.spread
        f, l = self.first[s], self.last[s]
        cut = []
        for k in s[(f < z) & (l >= a) & ((f < a) | (l >= z))]:
            i, j = self.a[k] + np.searchsorted(self.t[self.a[k]:self.z[k]], (a, z))
            if self.bad[i:j].any():
                cut.append(self.part(i, j))
        rows = np.concatenate([rows, np.array(cut, "int64").reshape(-1, 6)]) if cut else rows
        return rows[np.lexsort((rows[:, 1], -rows[:, 0]))[:most]]


class _Pairs:
    """Logs of a slice with their spans, those with an error on either side: the pairs by log, and a log with severity alone where
    none of its spans is in the window."""

    def __init__(self, l: pa.Table, s: pa.Table):
        """``l``: logs in the order of the lists."""
        severe, bad = l["_severe"].to_numpy(), s["_bad"].to_numpy()
        ids = ["trace_id", "span_id"]
        own = l.select(ids).append_column("i", pa.array(np.arange(len(l))))
        other = s.select(ids).append_column("j", pa.array(np.arange(len(s)))).filter(s["_linked"])
        met = own.join(other, ids, join_type="inner", use_threads=False)
        i, j = met["i"].to_numpy(), met["j"].to_numpy()
        self.start = s["_t"].to_numpy()
        self.starts = np.unique(self.start[j])
        self.wide = len(self.starts) + 1
        self.held = np.sort(i * self.wide + np.searchsorted(self.starts, self.start[j]))
        counts = severe[i] | bad[j]
        alone = np.flatnonzero(severe)
        i, j = np.r_[i[counts], alone], np.r_[j[counts], np.full(len(alone), -1)]
        order = np.argsort(i, kind="stable")
        self.i, self.j = i[order], j[order]

    def inside(self, lo: int, hi: int, a: int, z: int, times: int, most: int) -> np.ndarray:
        """The first ``most`` rows of the logs ``lo`` to ``hi`` with the spans that start in the window."""
        at, to = np.searchsorted(self.i, (lo, hi))
        ra, rz = np.searchsorted(self.starts, (a, z))
        out, n, step = [], 0, 4 * most
        while at < to and n < most:
            i, j = self.i[at:min(to, at + step)], self.j[at:min(to, at + step)]
            t = self.start[j] if len(self.start) else np.zeros(len(j))
            none = np.searchsorted(self.held, i * self.wide + rz) == np.searchsorted(self.held, i * self.wide + ra)
            ok = np.flatnonzero(np.where(j < 0, none, (t >= a) & (t < z)))
            many = np.minimum(np.where(j[ok] < 0, times, times * times), most)
            out.append(np.repeat(at + ok, many))
            n += len(out[-1])
            at, step = at + step, 2 * step
        return np.concatenate(out)[:most] if out else np.zeros(0, int)


def _told(w: pa.Table, x: pa.Table) -> pa.Table:
    """The logs, traces, pairs and counts of the windows that begin in a slice, from the logs and spans of the slice."""
    blocks = []
    if len(w) and len(x):
        is_log = x["_log"].to_numpy()
        l, s = x.filter(pa.array(is_log)), x.filter(pa.array(~is_log))
        l = l.take(pc.sort_indices(l, sort_keys=[("_t", "descending"), ("text", "ascending")], null_placement="at_start"))
        s = s.take(pc.sort_indices(s, sort_keys=[("_t", "ascending"), ("span_id", "ascending")], null_placement="at_start"))
        back = -l["_t"].to_numpy()
        wrong = np.flatnonzero(l["_bad"].to_numpy())
        start, bad = s["_t"].to_numpy(), np.r_[0, np.cumsum(s["_bad"].to_numpy())]
        traces, pairs = _Traces(s), _Pairs(l, s)
        for k in range(0, len(w), 256):
            some = w.slice(k, 256)
            a, z, n = (some[c].to_numpy() for c in ("_a", "_z", "_n"))
            lo, hi = np.searchsorted(back, -z, "right"), np.searchsorted(back, -a, "right")
            wlo, whi = np.searchsorted(wrong, lo), np.searchsorted(wrong, hi)
            slo, shi = np.searchsorted(start, a), np.searchsorted(start, z)
            take = np.minimum((whi - wlo) * n, MAX_LOGS)
            e = l.take(pa.array(wrong[_runs(wlo, take, n)], pa.int64()))
            t = [traces.inside(*az, MAX_TRACES) for az in zip(a, z)]
            p = [pairs.inside(*v, MAX_PAIRS) for v in zip(lo, hi, a, z, n)]
            tr, pr = np.concatenate(t), np.concatenate(p)
            times = np.repeat(n, [len(v) for v in t])
            pl, ps = l.take(pa.array(pairs.i[pr], pa.int64())), s.take(_some(pairs.j[pr]))
            lists = [
                _listed(take, pa.table({"ts": e["_t"], "service_name": e["service_name"], "severity": e["kind"], "body": e["text"]})),
                _listed([len(v) for v in t], pa.table({
                    "end_ts": pa.chunked_array([pa.array(tr[:, 0], pa.int64(), mask=tr[:, 0] == -2**62)]), "trace_id": pa.chunked_array([traces.names.take(pa.array(tr[:, 2]))]),
                    "root": s["text"].take(_some(tr[:, 3])), "spans": pa.chunked_array([pa.array(tr[:, 4] * times)]), "errors": pa.chunked_array([pa.array(tr[:, 5] * times)])})),
                _listed([len(v) for v in p], pa.table({"ts": pl["_t"], "service_name": pl["service_name"], "operation": ps["text"], "span_status": ps["kind"], "body": pl["text"]}))]
            counts = [pa.array(c * n) for c in (hi - lo, whi - wlo, shi - slo, bad[shi] - bad[slo])]
            out = pa.table([some["anomaly_id"].combine_chunks(), *lists, *counts], names=["anomaly_id", *TOLD])
            blocks.append(out.filter(pa.array((hi > lo) | (shi > slo))))
    none = pa.schema([("anomaly_id", w.schema.field("anomaly_id").type), *[(c, _arrow(k)) for c, k in TOLD.items()]])
    return pa.concat_tables([none.empty_table(), *blocks])


def _arrow(kind: str) -> pa.DataType:
    if not kind.startswith("array"):
        return {"bigint": pa.int64(), "string": pa.string()}[kind]
    return pa.list_(pa.struct([(f.split(":")[0], _arrow(f.split(":")[1])) for f in kind[len("array<struct<"):-2].split(",")]))


TOLD = {"error_logs": "array<struct<ts:bigint,service_name:string,severity:string,body:string>>",
        "error_traces": "array<struct<end_ts:bigint,trace_id:string,root:string,spans:bigint,errors:bigint>>",
        "correlation": "array<struct<ts:bigint,service_name:string,operation:string,span_status:string,body:string>>",
        "logs": "bigint", "error_log_count": "bigint", "spans": "bigint", "error_spans": "bigint"}


def _in_slices(rows: DataFrame) -> DataFrame:
    """Time ``_t`` in slices ``_w`` of twice the longest window; what lies in the first half also goes to the slice before, so that a
    window finds all it holds in the slice it begins in."""
    half = LONGEST * 1_000_000
    home = _home("_t")
    return rows.withColumn("_w", F.explode(F.array_compact(F.array(home, F.when(F.pmod("_t", F.lit(2 * half)) < half, home - 1)))))


def _home(c: str) -> Column:
    return F.floor(F.col(c) / (2 * LONGEST * 1_000_000))


def _sliced(windows_: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` for the windows (anomaly_id, _k, _a, _z, _n) that begin in a slice of a series, and the rows (_k, _t) of this slice."""
    w = windows_.select("anomaly_id", "_k", "_a", "_z", "_n", _home("_a").alias("_w"))
    return w.groupBy("_k", "_w").cogroup(_in_slices(rows).groupBy("_k", "_w")).applyInArrow(run, f"anomaly_id {windows_.schema['anomaly_id'].dataType.simpleString()}, {schema}")


def _spans_of_time(incidents: DataFrame, key: Column, start: str) -> tuple[DataFrame, DataFrame]:
    """:func:`_single` of the windows from ``start`` to until; the ids that it doesn't take keep all their rows."""
    us = F.unix_micros
    w = incidents.where(F.col(start).isNotNull() & F.col("until").isNotNull() & F.col("anomaly_id").isNotNull())
    return _single(w.withColumns({"_k": key, "_a": us(start), "_z": us("until"), "_s": us(start), "_d": us("until"), "_c": F.lit(False)}), ["anomaly_id"])


def _told_in_pairs(inc: DataFrame, logs: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """What :func:`_told` gives, for ids with several windows, by an interval join."""
    span_iv = inc.select("anomaly_id", "asset_id", "logs_from", (F.col("until") - F.expr("interval 1 microsecond")).alias("_u"))
    lg = overlap_join(logs.select("asset_id", "ts", "severity", "severity_num", "body", "trace_id", "span_id", "service_name"), span_iv, "asset_id",
                      "ts", "logs_from", "_u", width=width)
    sp = overlap_join(spans.select("asset_id", "start_ts", "end_ts", "duration_ns", "trace_id", "span_id", "parent_id", "name", "status", "service_name"),
                      span_iv, "asset_id", "start_ts", "logs_from", "_u", width=width)
    bad_logs = _top_per_incident(lg.where("severity_num >= 17"), [F.desc("ts"), "body"], MAX_LOGS)
    la = bad_logs.groupBy("anomaly_id").agg(F.sort_array(F.collect_list(F.struct("ts", "service_name", "severity", "body")), False).alias("error_logs"))
    traces = sp.groupBy("anomaly_id", "trace_id").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.min_by(F.when(F.col("parent_id") == "", F.col("name")), F.when(F.col("parent_id") == "", F.struct("start_ts", "span_id"))).alias("root")).where("errors > 0")
    ta = _top_per_incident(traces, [F.desc("end_ts"), "trace_id"], MAX_TRACES).groupBy("anomaly_id").agg(F.sort_array(
        F.collect_list(F.struct("end_ts", "trace_id", "root", "spans", "errors")), False).alias("error_traces"))
    so = sp.where("trace_id <> '' and span_id <> ''").select("anomaly_id", "trace_id", "span_id", F.col("name").alias("operation"),
                                                             F.col("status").alias("span_status"), "duration_ns")
    pairs = L.error_rows(lg.join(so, ["anomaly_id", "trace_id", "span_id"], "left"))
    pa = _top_per_incident(pairs, [F.desc("ts"), "body"], MAX_PAIRS).groupBy("anomaly_id").agg(F.sort_array(
        F.collect_list(F.struct("ts", "service_name", "operation", "span_status", "body")), False).alias("correlation"))
    out = L.window_counts(lg, sp, ["anomaly_id"]).withColumnRenamed("error_logs", "error_log_count")
    for part in (la, ta, pa):
        out = out.join(part, "anomaly_id", "left")
    return out.select("anomaly_id", *TOLD)


def _told_of(inc: DataFrame, logs: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Lists and counts of the logs and spans of every incident's window. Windows and rows meet in slices of an asset's time: a task
    sorts a slice once, a window is a range in it, and only the rows of its lists are copied."""
    one, rest = _spans_of_time(inc.where("asset_id is not null"), F.col("asset_id"), "logs_from")
    us, yes = F.unix_micros, lambda c: F.coalesce(c, F.lit(False))
    ids = ["service_name", "trace_id", "span_id"]
    a = logs.where("asset_id is not null and ts is not null").select(
        F.col("asset_id").alias("_k"), F.lit(True).alias("_log"), us("ts").alias("_t"), F.lit(None).cast("bigint").alias("_e"), F.col("severity").alias("kind"), F.col("body").alias("text"), *ids,
        yes(F.col("severity_num") >= 17).alias("_bad"), yes(L.is_severe()).alias("_severe"), F.lit(False).alias("_linked"), F.lit(False).alias("_top"))
    b = spans.where("asset_id is not null and start_ts is not null").select(
        F.col("asset_id").alias("_k"), F.lit(False).alias("_log"), us("start_ts").alias("_t"), us("end_ts").alias("_e"), F.col("status").alias("kind"), F.col("name").alias("text"), *ids,
        yes(F.col("status") == "error").alias("_bad"), F.lit(False).alias("_severe"), yes(F.expr("trace_id <> '' and span_id <> ''")).alias("_linked"), yes(F.col("parent_id") == "").alias("_top"))
    told = _sliced(one, a.unionByName(b), _told, ", ".join(f"{c} {k}" for c, k in TOLD.items()))
    at = lambda c, name: F.transform(c, lambda x: x.withField(name, F.timestamp_micros(x[name])))
    lists = {c: F.when(F.size(c) > 0, F.sort_array(at(c, name), False)) for c, name in (("error_logs", "ts"), ("error_traces", "end_ts"), ("correlation", "ts"))}
    return told.withColumns(lists).unionByName(_told_in_pairs(rest, logs, spans, width))


def evidence(incidents: DataFrame, points: DataFrame, logs: DataFrame, spans: DataFrame, as_of: Column, ts: str = "bucket",
             width: int = 86400, first: tuple[int, int, int] | None = None) -> DataFrame:
    """one record per incident, for ALL incidents in one batch.

    Each part is cut to its maximum before it is put in an array, so a record
    stays small however many rows its window holds. With ``first``, a record
    keeps only so many of its logs, traces and pairs, for a reader that takes
    no more.
    """
    inc = windows(incidents, as_of)
    summ = incident_summaries(inc, points, ts, width)
    s = summ.select("anomaly_id", F.struct(*[c for c in summ.columns if c != "anomaly_id"]).alias("affected"))
    told = _told_of(inc, logs, spans, width)
    if first:
        told = told.withColumns({c: F.slice(c, 1, n) for c, n in zip(("error_logs", "error_traces", "correlation"), first)})
    out = inc.join(s, "anomaly_id", "left").join(told, "anomaly_id", "left")
    missing = F.array_compact(F.array(F.when(F.col("affected").isNull(), "serie afectada"), F.when(F.col("logs").isNull(), "registros y trazas")))
    return out.withColumn("missing", missing).na.fill(0, ["logs", "error_log_count", "spans", "error_spans"])


@lru_cache(4096)
def _firsts(n: int, most: int) -> np.ndarray:
    """Where the slices of :func:`~.series.peaks` begin in ``n`` rows."""
    i = np.arange(n)
    if n <= most:
        return i
    step = n / most
    guess = np.minimum(most - 1, np.floor(i / step))
    slot = np.where(np.floor(guess * step) > i, guess - 1, np.where(np.floor((guess + 1) * step) <= i, guess + 1, guess))
    slot = np.minimum(most - 1, slot)
    return np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])


@lru_cache(4096)
def _picked(n: int, most: int) -> np.ndarray:
    """The places that :func:`~.series.every` picks in ``n`` rows."""
    i = np.arange(n)
    if n <= most:
        return i
    k = np.ceil(i * most / n)
    return i[(k < most) & (np.floor(k * n / most) == i)]


def _thinned(w: pa.Table, p: pa.Table) -> pa.Table:
    """:func:`~.series.every` of the :func:`~.series.peaks` of the windows that begin in a slice."""
    rows, sizes, at = [], [], []
    if len(w) and len(p):
        t, has = p["_t"].to_numpy(), p["_v"].is_valid().to_numpy()
        v = p["_v"].to_numpy().astype("float64")
        order = np.argsort(t, kind="stable")
        # the highest is the last: no value before any, one that is no number after all, the earliest on a tie
        best = np.lexsort((-t[order], np.where(has, v, 0.0)[order], has[order]))
        rank = np.empty(len(t), int)
        rank[best] = np.arange(len(t))
        a, z, n = (w[c].to_numpy() for c in ("_a", "_z", "_n"))
        lo, hi = np.searchsorted(t[order], a), np.searchsorted(t[order], z)
        for k in np.flatnonzero(hi > lo):
            r = rank[lo[k]:hi[k]] if n[k] == 1 else np.repeat(rank[lo[k]:hi[k]], n[k])
            top = best[np.maximum.reduceat(r, _firsts(len(r), MAX_POINTS))]
            top = top[_picked(len(top), PACK_POINTS)]
            rows.append(order[top])
            sizes.append(len(top))
            at.append(k)
    few = p.select(["_t", "_v"]).take(pa.array(np.concatenate(rows) if rows else [], pa.int64())).rename_columns(["t", "v"])
    few = few.set_column(1, "v", few["v"].cast(pa.float64()))
    return pa.table([w["anomaly_id"].take(pa.array(at, pa.int64())).combine_chunks(), _listed(np.array(sizes, int), few)], names=["anomaly_id", "puntos"])


def pack_points(incidents: DataFrame, points: DataFrame, ts: str = "bucket", width: int = 86400) -> DataFrame:
    """The points of a pack by incident: every third of 180 peaks of the whole window, so its end is as well covered as its start.

    Points and windows meet in slices of a series. Ids with several windows go through an interval join.
    """
    one, rest = _spans_of_time(windows_ready(incidents), F.concat_ws("|", "asset_id", "metric"), "metrics_from")
    p = points.where(F.col(ts).isNotNull()).select(F.concat_ws("|", "asset_id", "metric").alias("_k"), F.unix_micros(ts).alias("_t"), F.col("value").cast("double").alias("_v"))
    fast = _sliced(one, p, _thinned, "puntos array<struct<t:bigint,v:double>>")
    fast = fast.select("anomaly_id", F.sort_array(F.transform("puntos", lambda x: F.struct(F.timestamp_micros(x["t"]).alias("t"), significant(x["v"]).alias("v")))).alias("puntos"))
    few = every(peaks(incident_points(rest, points, ts, width), ["anomaly_id"], ts, "value", MAX_POINTS), ["anomaly_id"], ts, PACK_POINTS)
    slow = few.groupBy("anomaly_id").agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), significant(F.col("value")).alias("v")))).alias("puntos"))
    return fast.unionByName(slow)


def compact(records: DataFrame, points: DataFrame) -> DataFrame:
    """a small JSON text per incident: caps on points, logs, traces, pairs and text, 4 significant digits.

    ``points``: those of :func:`pack_points`. Parts without rows are empty lists.
    """
    cut = lambda c: F.substring(c, 1, PACK_TEXT)
    j = records.join(points, "anomaly_id", "left")
    had = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    four = lambda c: significant(F.col(f"affected.{c}")).alias(c)
    logs = F.transform(F.slice("error_logs", 1, PACK_LOGS), lambda x: F.struct(
        x["ts"].alias("momento"), x["service_name"].alias("servicio"), x["severity"].alias("severidad"), cut(x["body"]).alias("cuerpo")))
    traces = F.transform(F.slice("error_traces", 1, PACK_TRACES), lambda x: F.struct(
        x["trace_id"].alias("traza"), x["root"].alias("operacion"), x["end_ts"].alias("fin"), x["spans"].alias("tramos"), x["errors"].alias("errores")))
    pairs = F.transform(F.slice("correlation", 1, PACK_PAIRS), lambda x: F.struct(
        x["ts"].alias("momento"), x["service_name"].alias("servicio"), x["operation"].alias("operacion"), x["span_status"].alias("estado"), cut(x["body"]).alias("cuerpo")))
    told = F.coalesce(F.transform("series", lambda x: F.struct(
        x["metric"].alias("metrica"), x["dims"].alias("dimensiones"), x["role"].alias("papel"), x["kind"].alias("clase"), x["unit"].alias("unidad"),
        *[significant(x[c]).alias(n) for c, n in (("before_median", "mediana_antes"), ("during_median", "mediana_durante"), ("during_max", "maximo"), ("change_rel", "cambio_relativo"))])), F.array()) \
        if "series" in records.columns else None
    pack = F.struct(
        F.col("anomaly_id").alias("incidente"), F.col("asset_id").alias("activo"), F.col("metric").alias("metrica"), had("severity").alias("severidad"), had("score").alias("puntuacion"),
        had("model_version").alias("metodo"), F.col("start").alias("inicio"), F.col("end").alias("fin"),
        F.struct(F.col("metrics_from").alias("desde"), F.col("until").alias("hasta"), F.col("logs_from").alias("registros_desde")).alias("ventana"),
        F.struct(four("before_median"), four("during_median"), four("during_min"), four("during_max"), four("change_abs"), four("change_rel")).alias("resumen"),
        F.coalesce("puntos", F.array()).alias("puntos"), F.coalesce(logs, F.array()).alias("registros_error"), F.coalesce(traces, F.array()).alias("trazas_error"), F.coalesce(pairs, F.array()).alias("correlacion"),
        *([told.alias("series")] if "series" in records.columns else []),
        F.struct("logs", "error_log_count", "spans", "error_spans").alias("conteos"), F.col("missing").alias("no_recuperado"))
    return j.select("anomaly_id", F.to_json(pack, {"ignoreNullFields": "false"}).alias("pack"))


CITATION = "array<struct<metrica:string,desde:string,hasta:string,observacion:string>>"


def checked_citations(answers: DataFrame, incidents: DataFrame, metrics: DataFrame, hypothesis: str = "hypothesis") -> DataFrame:
    """``answers``: anomaly_id, hypothesis, citations (JSON text); ``metrics``: anomaly_id, metric in the evidence.

    A citation is valid when its metric is in the evidence and its interval
    lies in the window within a minute. Answers without any valid citation are
    not in the output.
    """
    from ..functions.times import parse_instant
    c = answers.where(F.coalesce(F.trim(hypothesis), F.lit("")) != "").select("anomaly_id", hypothesis, F.explode(F.from_json("citations", CITATION)).alias("c"))
    ok_metric = metrics.select("anomaly_id", F.col("metric").alias("_m")).distinct()
    w = incidents.select("anomaly_id", (F.col("metrics_from") - _ago("1 minute")).alias("_a"), (F.col("until") + _ago("1 minute")).alias("_z"))
    j = c.join(w, "anomaly_id").withColumn("_m", F.col("c.metrica")).join(ok_metric.withColumn("_ok", F.lit(True)), ["anomaly_id", "_m"], "left")
    d, h = parse_instant(F.col("c.desde")), parse_instant(F.col("c.hasta"))
    valid = F.coalesce(F.col("_ok") & (F.col("_a") <= d) & (d <= h) & (h <= F.col("_z")), F.lit(False))
    g = j.withColumn("_v", valid).groupBy("anomaly_id", hypothesis).agg(F.count_if("_v").alias("valid"), F.count_if(~F.col("_v")).alias("discarded"))
    return g.where("valid > 0")
