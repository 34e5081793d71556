"""The merging store and the roll-up cycle against plain batch results: late, repeated and far-future points, moves, dropped folders."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from test_streaming import POINT, T0, TAGS
from tidegauge.operators import rollup as R
from tidegauge.sources import store as stores
from tidegauge.sources import versions
from tidegauge.streaming import ingest, rollup


def rows_of(spark, items):
    """(seconds from T0, value, arrival second[, host]) as points of one metric."""
    out = []
    for s, v, a, *host in items:
        t = T0 + timedelta(seconds=s)
        out.append(("m", t, s * 10 ** 9, float(v), "A" if not host else "sin_resolver", host[0] if host else "h1", *TAGS[1:], {"k": "x"}, T0 + timedelta(seconds=a), t.date()))
    return spark.createDataFrame(out, POINT)


def put(paths, batch, points):
    stores.write_run(points, paths.store, batch)
    rollup.note_changes(points, paths.levels, batch)


def seen(df):
    return sorted((r.time_ns, r.value, r.asset_id) for r in df.collect())


def levels(spark, paths):
    m = rollup.read_level(spark, paths.points_1m)
    h = rollup.read_level(spark, paths.points_1h)
    return [sorted((r.asset_id, r.bucket, round(r.value_avg, 9), r.value_count) for r in d.collect()) for d in (m, h)]


def batch_levels(points):
    m = R.summarise(points, 60)
    h = R.summarise_again(m, 3600)
    return [sorted((r.asset_id, r.bucket, round(r.value_avg, 9), r.value_count) for r in d.collect()) for d in (m, h)]


FAR = int((datetime(2099, 1, 1) - T0).total_seconds())
BATCHES = [
    [(10 * i, i, 10 * i) for i in range(60)],
    [(600 + 10 * i, i, 600 + 10 * i) for i in range(60)] + [(FAR, 7, 650)],  # one sender's clock is far ahead
    [(5, 100, 1300), (20, 200, 1301), (3700, 1, 1302)],                    # late, sent again with another value, a new hour
    [(610, 50, 500)],                                                      # sent again, but it arrived before: the stored value stays
    [(86400 + 10 * i, i, 90000) for i in range(30)],
]


def test_cycle_counts_late_repeated_and_far_rows(spark, folder):
    paths = ingest.Paths(f"{folder}/r")
    for b, items in enumerate(BATCHES):
        put(paths, b, rows_of(spark, items))
        if b != 2:  # a cycle that takes two batches at once
            rollup.cycle(spark, paths.store, paths.levels)
            assert levels(spark, paths) == batch_levels(ingest.read_points(spark, paths))
    assert ingest.read_points(spark, paths).count() == 60 + 61 + 2 + 30
    assert rollup.read_level(spark, paths.points_1m).where("bucket > '2098-01-01'").count() == 1
    assert rollup.cycle(spark, paths.store, paths.levels).count() == 0
    # a batch that is repeated changes nothing
    put(paths, 4, rows_of(spark, BATCHES[4]))
    assert levels(spark, paths) == batch_levels(ingest.read_points(spark, paths))


def test_hours_wait_for_the_clock_and_passes_are_cut(spark, folder):
    paths = ingest.Paths(f"{folder}/r")
    put(paths, 0, rows_of(spark, [(600 * i, i, 600 * i) for i in range(18)]))  # three hours
    at = lambda s: F.lit(T0 + timedelta(seconds=s))
    first = rollup.cycle(spark, paths.store, paths.levels, at(7250), most=2)
    assert [r.hour for r in first.orderBy("hour").collect()] == [T0, T0 + timedelta(hours=1)]
    assert rollup.read_level(spark, paths.points_1m).count() == 12
    # at 02:00:50 the minutes are published up to 02:00, the hours up to 01:00
    assert rollup.progress(spark, paths.levels)["1h"][2] == T0 + timedelta(hours=1)
    assert [r.bucket for r in rollup.read_level(spark, paths.points_1h).collect()] == [T0]
    assert rollup.cycle(spark, paths.store, paths.levels, at(10_920), most=2).count() == 1
    assert rollup.read_level(spark, paths.points_1h).count() == 2 and rollup.read_level(spark, paths.points_1m).count() == 18
    assert rollup.published(spark, paths.levels, "1m").count() == 18
    assert rollup.cycle(spark, paths.store, paths.levels, at(10_990)).count() == 0
    assert rollup.read_level(spark, paths.points_1h).count() == 3
    # a late row changes an hour that was published
    put(paths, 1, rows_of(spark, [(5, 9, 11_000)]))
    rollup.cycle(spark, paths.store, paths.levels, at(11_050))
    assert levels(spark, paths) == batch_levels(ingest.read_points(spark, paths))


def test_merges_keep_rows_and_bound_the_files(spark, folder):
    paths = ingest.Paths(f"{folder}/r")
    want = {}
    for b in range(40):
        items = [(60 * ((7 * b + i) % 50), 1000 * b + i, b) for i in range(5)]
        want |= {s * 10 ** 9: float(v) for s, v, _ in items}
        stores.write_run(rows_of(spark, items), paths.store, b)
        if b % 4 == 3:
            assert stores.merge(spark, paths.store, 4) == 1
    assert seen(stores.read(spark, paths.store)) == sorted((t, v, "A") for t, v in want.items())
    assert stores.merge(spark, paths.store, 4) == 0
    assert len(versions.listed(spark, paths.points_raw, "batch=*/metric=*/date=*/*.parquet")) <= 12
    assert len(versions.listed(spark, paths.points_merged, "v=*/metric=*/date=*")) <= 3
    assert len(versions.committed(spark, paths.points_manifest, "v")) <= versions.KEEP
    # a batch that comes again after its merge is ignored
    stores.write_run(rows_of(spark, [(0, -1, 0)]), paths.store, 3)
    assert seen(stores.read(spark, paths.store)) == sorted((t, v, "A") for t, v in want.items())


def test_readers_of_the_old_manifest_can_finish(spark, folder):
    paths = ingest.Paths(f"{folder}/r")
    for b in range(4):
        stores.write_run(rows_of(spark, [(60 * b, b, b)]), paths.store, b)
    stores.merge(spark, paths.store, 4)
    before = stores.read(spark, paths.store)
    for b in range(4, 8):
        stores.write_run(rows_of(spark, [(60 * b, b, b)]), paths.store, b)
    stores.merge(spark, paths.store, 4)
    assert before.count() == 4 and stores.read(spark, paths.store).count() == 8


def test_a_pass_scans_only_its_partitions(spark, folder):
    paths = ingest.Paths(f"{folder}/r")
    for b in range(3):
        stores.write_run(rows_of(spark, [(86400 * d + b, d, b) for d in range(20)]), paths.store, b)
    stores.merge(spark, paths.store, 3)
    stores.write_run(rows_of(spark, [(86400 * 3 + 50, 1, 9), (86400 * 9, 1, 9)]), paths.store, 3)
    parts = spark.createDataFrame([("m", (T0 + timedelta(days=3)).date())], "metric string, date date")
    df = stores.read(spark, paths.store, parts)
    assert df.count() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "PartitionFilters" in line and "metric=" not in line and "points" in line]
    assert scans and all("2024-01-04" in s or "19726" in s for s in scans), scans
    files = {f for f in df.inputFiles()}
    assert all("date=2024-01-04" in f for f in files if "/metric=" in f) or df.select("date").distinct().count() == 1


def test_moved_rows_and_their_hours_are_one_commit(spark, folder):
    paths = ingest.Paths(f"{folder}/r")
    put(paths, 0, rows_of(spark, [(60 * i, i, 60 * i, "h9") for i in range(10)] + [(60 * i, i, 60 * i) for i in range(10)] + [(9000, 1, 9000)]))
    rollup.cycle(spark, paths.store, paths.levels)
    versions.publish(spark.createDataFrame([("h9", "host.name", "aws", 10, 0, 0, T0, T0, None, None)], ingest.ORPHANS), paths.orphans, 0)
    keys = spark.createDataFrame([("h9", "A9", "host.name", "aws")], ingest.KEYS)
    assert ingest.run_moves(spark, paths, keys) == 1
    pts = ingest.read_points(spark, paths)
    assert {r.asset_id: r["count"] for r in pts.groupBy("asset_id").count().collect()} == {"A": 11, "A9": 10}
    led = ingest.all_orphans(spark, paths).first()
    assert led.associated_to == "A9" and led.associated_at is not None
    # a merge in between doesn't lose the queued hours
    put(paths, 1, rows_of(spark, [(9060, 1, 9060)]))
    assert ingest.run_merge(spark, paths, 1) == 1
    hours = rollup.cycle(spark, paths.store, paths.levels)
    assert sorted(r.hour for r in hours.collect()) == [T0, T0 + timedelta(hours=2)]
    assert levels(spark, paths) == batch_levels(pts.unionByName(rows_of(spark, [(9060, 1, 9060)]).select(*pts.columns)))
    assert ingest.run_moves(spark, paths, keys) == 0 and rollup.cycle(spark, paths.store, paths.levels).count() == 0


def test_levels_in_days(spark, folder):
    from dataclasses import replace
    paths = ingest.Paths(f"{folder}/r")
    levels_ = replace(paths.levels, unit="day")
    for b in (0, 2):
        stores.write_run(rows_of(spark, BATCHES[b]), paths.store, b)
        rollup.note_changes(rows_of(spark, BATCHES[b]), levels_, b)
        rollup.cycle(spark, paths.store, levels_)
    got = [sorted((r.asset_id, r.bucket, round(r.value_avg, 9), r.value_count) for r in rollup.read_level(spark, p, unit="day").collect()) for p in (levels_.minutes, levels_.hours)]
    assert got == batch_levels(ingest.read_points(spark, paths))
