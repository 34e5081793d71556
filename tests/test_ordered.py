"""Chunked ordering and exact percentiles against brute force, with one series that holds most rows."""

import random
import statistics
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tidegauge.operators import detect, features, ordered, quantiles, series

T0 = datetime(2024, 1, 1)
DAY = 86400


def frame(spark, seed=1, hot=1500, cold=40):
    rnd = random.Random(seed)
    rows = []
    for key, n in (("hot", hot), ("a", cold), ("b", 3)):
        t = T0
        for _ in range(n):
            t += timedelta(seconds=rnd.choice([60, 60, 60, 120, 600, 90000]))
            rows.append((key, t, round(rnd.gauss(50, 5) + (200 if rnd.random() < 0.05 else 0), 3)))
    return pd.DataFrame(rows, columns=["key", "ts", "value"]), spark.createDataFrame(rows, "key string, ts timestamp, value double")


def test_position_lag_lead_across_chunks(spark):
    pdf, df = frame(spark)
    got = ordered.shifted(df, ["key"], "ts", DAY, {"prev": ("value", 1), "back3": ("value", 3), "next": ("value", -1)}, chunk_rows=7).toPandas()
    want = pdf.copy()
    g = want.groupby("key")["value"]
    want["prev"], want["back3"], want["next"] = g.shift(1), g.shift(3), g.shift(-1)
    m = got.merge(want, on=["key", "ts"], suffixes=("", "_w"))
    assert len(got) == len(pdf) == len(m)
    for c in ("prev", "back3", "next"):
        pd.testing.assert_series_equal(m[c], m[f"{c}_w"], check_names=False)


def test_running_sum_and_fill(spark):
    pdf, df = frame(spark, 2)
    got = ordered.running_sum(df, ["key"], "ts", DAY, "value", "total").toPandas().sort_values(["key", "ts"])
    want = pdf.sort_values(["key", "ts"]).groupby("key")["value"].cumsum()
    assert (abs(got["total"].to_numpy() - want.to_numpy()) < 1e-6).all()
    holes = df.withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    f = ordered.filled(holes, ["key"], "ts", DAY, ["value"]).toPandas().sort_values(["key", "ts"])
    p = pdf.sort_values(["key", "ts"]).copy()
    p["value"] = p["value"].where(p["value"] > 50)
    w = p.groupby("key")["value"].transform(lambda s: s.ffill().bfill())
    pd.testing.assert_series_equal(f["value"].reset_index(drop=True), w.reset_index(drop=True), check_names=False)


def test_exact_percentiles_of_skewed_groups(spark):
    rnd = random.Random(3)
    rows = [("big", rnd.choice([0.0, rnd.expovariate(1), rnd.gauss(0, 1e6), 7.0])) for _ in range(30000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for p in (0.0, 0.5, 0.95, 0.995, 1.0):
        got = {r["g"]: r["x"] for r in quantiles.exact_percentile(df, ["g"], "v", p, "x", rounds=2).collect()}
        assert set(got) == {"big", "one", "two"}
        built_in = {r["g"]: r["x"] for r in quantiles.exact_percentile(df, ["g"], "v", p, "x").collect()}
        assert set(built_in) == set(got) and all(abs(built_in[g] - got[g]) <= 1e-9 * max(1, abs(got[g])) for g in got)
        for g in got:
            xs = sorted(v for k, v in rows if k == g and v is not None)
            k = (len(xs) - 1) * p
            i = int(k)
            want = xs[i] + (xs[min(i + 1, len(xs) - 1)] - xs[i]) * (k - i)
            assert abs(got[g] - want) < 1e-9 * max(1, abs(want)), (g, p)
    assert abs(quantiles.exact_percentile(df.where("g = 'two'"), [], "v", 0.5, "x", rounds=1).first()["x"] - 1.5) < 1e-12


def brute_events(values, window=60, run=3, floor=0.0):
    out, streak = [], 0
    for i, v in enumerate(values):
        crit = False
        if i >= window:
            h = values[i - window:i]
            med = statistics.median(h)
            mad = statistics.median(abs(x - med) for x in h) * 1.4826
            scale = max(mad if mad > 0 else statistics.pstdev(h), floor)
            crit = scale > 0 and (v - med) / scale >= 3.5
        streak = streak + 1 if crit else 0
        if streak == run:
            out.append(i)
    return out


def minute_series(spark, named):
    rows = [(k, T0 + timedelta(minutes=i), float(v)) for k, vs in named.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "key string, bucket timestamp, value double")


def test_events_equal_brute_force(spark):
    rnd = random.Random(4)
    flat = [50 + rnd.gauss(0, 1) for _ in range(300)]
    step = flat[:150] + [v + 40 for v in flat[150:]]
    spike = [*flat[:200], 500.0, *flat[201:]]
    noisy = [rnd.choice([0, 0, 0, 1, 30]) + rnd.random() for _ in range(900)]
    bursts = [v + (80 if 100 <= i % 150 < 106 else 0) for i, v in enumerate(flat * 3)]
    named = {"flat": flat, "step": step, "spike": spike, "noisy": noisy, "bursts": bursts, "constant": [5.0] * 100, "short": flat[:20]}
    got = detect.scored(minute_series(spark, named), ["key"], bucket_seconds=3600, chunk_rows=64).where("opens").collect()
    seen = {}
    for r in got:
        seen.setdefault(r["key"], []).append(r["pos"] - 1)
    for k, vs in named.items():
        assert sorted(seen.get(k, [])) == brute_events(vs), k
    assert len(seen["step"]) == 1 and "spike" not in seen and "constant" not in seen


def test_counter_is_watched_as_a_rate(spark):
    rnd = random.Random(5)
    total, ramp = 0.0, []
    for i in range(200):
        total += 100 + rnd.random() + (200 if 120 <= i < 130 else 0)
        ramp.append(total)
    reset = [*ramp[:50], *[v - ramp[50] for v in ramp[50:100]]]
    df = minute_series(spark, {"ramp": ramp, "reset": reset})
    rate = series.rate(df, ["key"], bucket_seconds=3600)
    n = {r["key"]: r["n"] for r in rate.groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert n == {"ramp": 199, "reset": 98}
    assert detect.scored(rate, ["key"], bucket_seconds=3600).where("opens").count() == 1
    assert detect.scored(df.where("key = 'ramp'"), ["key"], bucket_seconds=3600).where("opens").count() == 0


def brute_runs(rows, run=3, calm=15, gap=120):
    streak = normal = 0
    opened = first = prev = None
    out = []
    for t, bad in rows:
        joined = prev is not None and (t - prev).total_seconds() <= gap
        prev = t
        if not joined:
            streak = 0
        if bad:
            streak, normal = streak + 1, 0
            if opened is None and streak == run:
                opened = t
        else:
            streak = 0
            if opened is not None:
                normal, first = (1, t) if normal == 0 or not joined else (normal + 1, first)
                if normal == calm:
                    out.append((opened, first))
                    opened, normal = None, 0
    if opened is not None:
        out.append((opened, None))
    return out


def test_state_runs_equal_brute_force(spark):
    for seed in range(6):
        rnd = random.Random(seed)
        t, rows, bad = T0, [], False
        for _ in range(600):
            t += timedelta(seconds=rnd.choice([60] * 20 + [120, 121, 700]))
            bad = rnd.random() < (0.9 if bad else 0.06)
            rows.append((t, bad))
        df = spark.createDataFrame([("a", *x) for x in rows], "asset_id string, bucket timestamp, anomalous boolean")
        got = sorted((r["start"], r["end"]) for r in features.state_runs(df, bucket_seconds=3600, chunk_rows=50).collect())
        assert got == brute_runs(rows), seed


def test_peaks_keep_the_highest_of_each_slice(spark):
    rnd = random.Random(7)
    vs = [rnd.random() for _ in range(1000)]
    got = series.peaks(minute_series(spark, {"x": vs}), ["key"], "bucket", "value", 180, 3600).orderBy("slot").collect()
    step = len(vs) / 180
    want = [max(vs[int(i * step):max(int((i + 1) * step), int(i * step) + 1)]) for i in range(180)]
    assert [r["value"] for r in got] == want
    few = series.peaks(minute_series(spark, {"x": vs[:5]}), ["key"], "bucket", "value", 180, 3600)
    assert few.count() == 5
