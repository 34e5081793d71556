"""Streams against their batch twins, the ingest job end to end, idempotence of a repeated batch."""

import json
import random
import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegauge.operators import audit
from tidegauge.schema import METRIC_POINTS
from tidegauge.sources import versions
from tidegauge.streaming import detect, ingest, rollup

T0 = datetime(2024, 1, 1)
TAGS = ("h1", "svc", "aws", "r", "lab")
POINT = ("metric string, ts timestamp, time_ns bigint, value double, asset_id string, host_name string, service_name string, cloud_provider string, "
         "cloud_region string, deployment_environment string, dims map<string,string>, received_at timestamp, date date")


def cpu_points(spark):
    """Three hours at 10 s, two cores, two samples missing at minute 7."""
    rows = []
    for core in ("cpu0", "cpu1"):
        for i in range(3 * 360):
            t = T0 + timedelta(seconds=10 * i)
            if i // 6 == 7 and i % 6 > 3:
                continue
            rows.append(("system_cpu_utilization", t, i * 10 ** 10, 0.6 if (i // 6) % 2 else 0.2, "A", *TAGS, {"cpu": core, "state": "user"}, t, t.date()))
    return spark.createDataFrame(rows, POINT)


def test_two_level_summaries_and_redo(spark, folder):
    from tidegauge.operators import rollup as R
    pts = cpu_points(spark)
    minutes = R.summarise(pts, 60)
    m = {r["bucket"]: r for r in minutes.where("dims_key like '%cpu0%'").collect()}
    assert len(m) == 180 and (m[T0 + timedelta(minutes=1)]["value_avg"], m[T0 + timedelta(minutes=1)]["value_count"]) == (0.6, 6.0)
    assert m[T0 + timedelta(minutes=7)]["value_count"] == 4.0
    hour = R.summarise_again(minutes, 3600).where("dims_key like '%cpu0%'").orderBy("bucket").first()
    assert hour["value_count"] == 358 and abs(hour["value_avg"] - (180 * 0.2 + 178 * 0.6) / 358) < 1e-12
    # a redo of one hour writes that hour only, and twice gives the same
    late = spark.createDataFrame([("system_cpu_utilization", T0 + timedelta(hours=1))], "metric string, hour timestamp")
    for _ in range(2):
        rollup.redo(spark, late, pts, f"{folder}/m", f"{folder}/h")
    assert spark.read.parquet(f"{folder}/m").count() == 120 and spark.read.parquet(f"{folder}/h").count() == 2
    rollup.redo(spark, late.unionByName(spark.createDataFrame([("system_cpu_utilization", T0)], late.schema)), pts, f"{folder}/m", f"{folder}/h")
    assert spark.read.parquet(f"{folder}/m").count() == 240
    assert audit.lag(minutes, F.lit(T0 + timedelta(hours=3, seconds=60)), 60).first()["lag_s"] <= 120


def test_streamed_minutes_equal_batch(spark, folder):
    pts = cpu_points(spark).orderBy("ts").repartition(1)
    pts.write.parquet(f"{folder}/in")
    src = spark.readStream.schema(METRIC_POINTS).parquet(f"{folder}/in")
    q = rollup.minute_summaries(src).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    from tidegauge.operators import rollup as R
    got = spark.read.parquet(f"{folder}/out").select("dims_key", "bucket", "value_avg", "value_count")
    last = T0 + timedelta(hours=3) - timedelta(seconds=40)
    want = R.summarise(pts, 60).where(F.col("bucket") + F.expr("interval 60 seconds") <= F.lit(last)).select("dims_key", "bucket", "value_avg", "value_count")
    assert got.count() == want.count() > 300 and got.exceptAll(want).count() == 0


def brute_cycle(values, window=60, need=3, calm_need=15):
    ring, run, opened, calm, out = [], 0, None, 0, []
    for i, v in enumerate(values):
        if opened is not None:
            _, med, scale = opened
            if (v - med) / max(scale, 0.05 * abs(med)) < 3.5:
                calm = calm + 1
            else:
                calm = 0
            if calm >= calm_need:
                out.append(("close", opened[0], i - calm + 1))
                opened, calm = None, 0
        crit = False
        if len(ring) == window:
            med = statistics.median(ring)
            mad = statistics.median(abs(x - med) for x in ring) * 1.4826
            scale = mad if mad > 0 else statistics.pstdev(ring)
            crit = scale > 0 and (v - med) / scale >= 3.5
        run = run + 1 if crit else 0
        if run == need and opened is None:
            opened = (i, med, scale)
            out.append(("open", i, None))
        ring = [*ring, v][-window:]
    return out


def test_detection_cycle_stream_in_many_batches(spark, folder):
    rnd = random.Random(9)
    named = {"burst": [50 + rnd.gauss(0, 1) + (60 if 100 <= i < 130 or 250 <= i < 256 else 0) for i in range(330)], "flat": [50 + rnd.gauss(0, 1) for _ in range(330)]}
    rows = [(k, T0 + timedelta(minutes=i), float(v)) for k, vs in named.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    for part in range(4):
        a, z = T0 + timedelta(minutes=100 * part), T0 + timedelta(minutes=100 * (part + 1))
        df.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(z))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = detect.cycle(src).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["series"], r["event"], r["ts"], r["end"]) for r in spark.read.parquet(f"{folder}/out").collect())
    at = lambda i: None if i is None else T0 + timedelta(minutes=i)
    want = sorted((k, e, at(a), at(z)) for k, vs in named.items() for e, a, z in brute_cycle(vs))
    assert got == want and [w[1] for w in want] == ["close", "close", "open", "open"]


def test_detection_cycle_floors_late_points_and_closing_span(spark):
    rnd = random.Random(4)
    base = [50 + rnd.gauss(0, 0.1) for _ in range(70)]
    at = lambda i: T0 + timedelta(minutes=i)
    jump = [(i, v) for i, v in enumerate(base)] + [(70 + i, 52.0) for i in range(5)]
    # 15 normal points, two minutes apart, span 28 minutes: not close enough; then one a minute
    sparse = [(76 + 2 * i, 50.0) for i in range(15)]
    dense = [(76 + 2 * 14 + 1 + i, 50.0) for i in range(14)]
    rows = [("low", at(i), v, 0.0) for i, v in jump + sparse] + [("high", at(i), v, 5.0) for i, v in jump + sparse] + [("both", at(i), v, None) for i, v in jump + sparse + dense]
    rows += [("low", at(3), 9.9, 0.0)]  # a second value of an instant
    got = detect.cycle(spark.createDataFrame(rows, "series string, ts timestamp, value double, floor double")).collect()
    assert sorted((r["series"], r["event"]) for r in got) == [("both", "close"), ("both", "open"), ("low", "late"), ("low", "open")]
    assert next(r["end"] for r in got if r["event"] == "close") == at(73)  # a twentieth of the level is normal


def otlp_lines(n):
    for i in range(n):
        attrs = [{"key": "host.name", "value": {"stringValue": f"h{i % 3}"}}, {"key": "cloud.provider", "value": {"stringValue": "aws"}}]
        dps = [{"timeUnixNano": str(1704067200_000000000 + i * 10 ** 10), "asDouble": float(i)}]
        yield json.dumps({"resourceMetrics": [{"resource": {"attributes": attrs}, "scopeMetrics": [{"metrics": [{"name": "Load", "gauge": {"dataPoints": dps}}]}]}]})


def test_ingest_job_counts_every_row_and_repeats_safely(spark, folder):
    import os
    os.makedirs(f"{folder}/inbox")
    with open(f"{folder}/inbox/a.json", "w") as f:
        f.write("\n".join([*otlp_lines(30), "broken line"]))
    paths = ingest.Paths(f"{folder}/root")
    versions.publish(spark.createDataFrame([("h0", "A0", "host.name", "aws"), ("h1", "A1", "host.name", "aws")], ingest.KEYS), paths.keys, 0)
    log = ingest.ProgressLog()
    spark.streams.addListener(log)
    q = ingest.start_metrics(spark, f"{folder}/inbox", paths, available_now=True)
    q.awaitTermination()
    pts = ingest.read_points(spark, paths)
    assert pts.count() == 30
    assert {r["asset_id"]: r["count"] for r in pts.groupBy("asset_id").count().collect()} == {"A0": 10, "A1": 10, "sin_resolver": 10}
    src = versions.latest(spark, paths.sources, ingest.SOURCES)
    assert src.agg(F.sum("received")).first()[0] == 30
    orphans = versions.latest(spark, paths.orphans, ingest.ORPHANS)
    assert [(r["key"], r["metrics"], r["key_type"]) for r in orphans.collect()] == [("h2", 10, "host.name")]
    assert spark.read.json(f"{paths.rejects}/batch=0").where("line is not null").count() == 1
    # the same batch again leaves everything as it was
    from tidegauge.sources import otlp
    ingest.metric_batch(paths)(otlp.read(spark, f"{folder}/inbox", "metrics"), 0)
    assert ingest.read_points(spark, paths).count() == 30
    assert versions.latest(spark, paths.sources, ingest.SOURCES).agg(F.sum("received")).first()[0] == 30
    orphans = versions.latest(spark, paths.orphans, ingest.ORPHANS)
    # the orphan's host becomes known: its rows move, and their hours are to be redone
    keys = spark.createDataFrame([("h2", "A2", "host.name", "aws")], ingest.KEYS)
    late = ingest.associate(ingest.read_points(spark, paths), orphans, keys)
    assert late[0].where("asset_id = 'A2'").count() == 0  # older than two hours before the orphan was first seen
    orphans = orphans.withColumn("first_seen", F.lit(T0 + timedelta(hours=1)))
    moved, hours, by_hand = ingest.associate(ingest.read_points(spark, paths), orphans, keys)
    assert moved.where("asset_id = 'A2'").count() == 10 and moved.count() == 30 and hours.count() == 1 and by_hand.count() == 0
    spark.streams.removeListener(log)
    # all of it came too late for the stream: the queue names its hour once, and a second pass has nothing to do
    hours = ingest.run_redo(spark, paths).collect()
    assert [(r["metric"], r["hour"]) for r in hours] == [("load", T0)]
    again = spark.read.parquet(paths.points_1m)
    assert again.agg(F.sum("value_count")).first()[0] == 30 and spark.read.parquet(paths.points_1h).agg(F.sum("value_count")).first()[0] == 30
    assert ingest.run_redo(spark, paths).count() == 0
    # a later batch sends two samples again with other values: they replace, also in the summaries
    with open(f"{folder}/inbox/b.json", "w") as f:
        f.write("\n".join(x.replace('"asDouble": 4.0', '"asDouble": 400.0').replace('"asDouble": 5.0', '"asDouble": 500.0') for x in list(otlp_lines(30))[4:6]))
    ingest.start_metrics(spark, f"{folder}/inbox", paths, available_now=True).awaitTermination()
    assert ingest.read_points(spark, paths).count() == 30
    assert ingest.run_redo(spark, paths).count() == 1
    assert spark.read.parquet(paths.points_1m).agg(F.max("value_max")).first()[0] == 500.0 and spark.read.parquet(paths.points_1m).agg(F.sum("value_count")).first()[0] == 30
