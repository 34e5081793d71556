"""What has to hold so that time, memory and shuffles grow no faster than the input."""

import os
import random
import subprocess
import sys
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidegauge.functions import redaction
from tidegauge.functions.values import significant
from tidegauge.operators import evidence, logs as tracing, ml, series, signals

ROOT = Path(__file__).parents[1]
AT = datetime(2024, 1, 1)
FRESH = """
from datetime import datetime, timedelta
from pyspark.sql import SparkSession
from tidegauge.streaming.detect import cycle
s = SparkSession.builder.master("local[1]").config(map={"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "1",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}).getOrCreate()
at = datetime(2024, 1, 1)
rows = [("a", at + timedelta(minutes=i), 100.0 if i > 65 else float(i % 2)) for i in range(70)]
print("events", [r["event"] for r in cycle(s.createDataFrame(rows, "series string, ts timestamp, value double")).collect()])
"""


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cycle_over_a_batch_frame_is_the_first_thing_a_session_runs(tmp_path):
    out = subprocess.run([sys.executable, "-c", FRESH], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert "events ['open']" in out.stdout, out.stderr[-2000:]


def test_related_signals_keep_one_number_an_ask(spark):
    asked = spark.createDataFrame([(1, "system_cpu_utilization", {"state": "user", "x": "1"}), (1, "system_cpu_utilization", {"state": "user"}), (2, "system_disk_io", {"direction": "read"}),
                                   (3, "ghost", {}), (None, "system_paging_usage", {"state": "used"}), (4, None, {"state": "user"})], "ask_id int, metric string, dims map<string,string>")
    cat = signals.catalogue(spark)
    got = signals.related(cat, asked)
    # texts and maps of all asks were sorted by ask before
    assert "SortAggregate" not in plan(got.select("ask_id", "rel_signal"))
    rows = sorted((r["ask_id"] or 0, r["rel_signal"]) for r in got.collect())
    assert rows == [(0, "system_memory_utilization[state=used]"), (0, "system_paging_operations[direction=page_in, por type]"), (1, "system_cpu_load_average_1m"), (1, "system_cpu_utilization[state=system]"),
                    (1, "system_processes_count[status=running]"), (2, "system_cpu_utilization[state=wait]"), (2, "system_disk_io[direction=write, por device]"), (2, "system_filesystem_usage[state=used, por mountpoint]")]
    own = {r["ask_id"]: r["s"] for r in signals.own_signals(cat, asked).select("ask_id", F.col("own.signal").alias("s")).collect()}
    assert own == {1: "system_cpu_utilization[state=user]", 2: "system_disk_io[direction=read, por device]", None: "system_paging_usage[state=used, por device]"}


def _incidents(spark, rnd):
    rows = [(str(i), f"a{i % 2}", "m", AT + timedelta(minutes=rnd.randrange(3000)), rnd.choice([None, 0, 20, 400])) for i in range(60)]
    rows += rows[:3] + [("4", "a1", "m", AT + timedelta(minutes=700), None), (None, "a0", "m", AT, 20), (None, "a1", "m", AT + timedelta(hours=9), 20), ("n", None, "m", AT, None), ("s", "a0", "m", None, None)]
    rows = [(i, a, m, s, s + timedelta(minutes=e) if s and e is not None else None) for i, a, m, s, e in rows]
    inc = spark.createDataFrame(rows, "anomaly_id string, asset_id string, metric string, start timestamp, end timestamp")
    return evidence.windows(inc, F.to_timestamp(F.lit("2024-01-03 00:00:00")))


def test_summaries_without_pairs_are_those_of_the_pairs(spark):
    rnd = random.Random(3)
    inc = _incidents(spark, rnd)
    pts = [(f"a{rnd.randrange(3)}", "m", AT + timedelta(seconds=rnd.randrange(200_000)), rnd.choice([None, float("nan"), *[rnd.uniform(-9, 9)] * 20])) for _ in range(3000)]
    pts = spark.createDataFrame([*pts, *pts[:50], ("a0", "m", None, 1.0), (None, "m", AT, 2.0)], "asset_id string, metric string, ts timestamp, value double")
    # one window is longer than a slice
    inc = inc.withColumn("until", F.when(F.col("anomaly_id") == "7", F.col("until") + F.expr("interval 9 hours")).otherwise(F.col("until")))
    text = lambda d: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in d.select(*names).collect())
    pairs = evidence.summary(evidence.incident_points(inc, pts, "ts"), ["anomaly_id"], "ts")
    names = pairs.columns
    assert text(evidence.incident_summaries(inc, pts, "ts")) == text(pairs)


def test_series_of_incidents_are_measured_in_slices(spark):
    """A counter's rates, a fall among them, for an id that comes once, one that comes twice, and one with two windows."""
    level = [("a", "system_disk_io", AT + timedelta(minutes=i), {"direction": d, "device": v}, float(i * 60 if i != 70 else 0) * (2 if v == "sdb" else 1), 1.0) for i in range(120) for d in ("read", "write") for v in ("sda", "sdb")]
    level = spark.createDataFrame(level, "asset_id string, metric string, ts timestamp, dims map<string,string>, value_avg double, value_count double")
    own = {"direction": "write", "device": "sda"}
    row = lambda i, m: (i, "a", "system_disk_io", own, AT + timedelta(minutes=m), AT + timedelta(minutes=m + 10))
    inc = spark.createDataFrame([row("1", 60), row("2", 60), row("2", 60), row("3", 60), row("3", 90)], "anomaly_id string, asset_id string, metric string, dims map<string,string>, start timestamp, end timestamp")
    got = evidence.incident_series(inc, level, signals.catalogue(spark), F.to_timestamp(F.lit("2024-01-03 00:00:00")), "ts")
    rows = {(r["anomaly_id"], r["role"], r["dims"]): (r["before_median"], r["during_median"], r["points_before"], r["points_during"], r["unit"]) for r in got.collect()}
    one = {k[1:]: v for k, v in rows.items() if k[0] == "1"}
    # the first of 60 points before has no rate, and the fall at the end of the fault counts for none
    assert one == {("afectada", "device=sda,direction=write"): (1.0, 1.0, 59, 10, "por segundo"), ("relacionada", "direction=read,device=sda"): (1.0, 1.0, 59, 10, "por segundo"),
                   ("relacionada", "direction=read,device=sdb"): (2.0, 2.0, 59, 10, "por segundo")}
    assert {k[1:]: v for k, v in rows.items() if k[0] == "2"} == one and {k[1:] for k in rows if k[0] == "3"} == set(one)
    # points and incidents met in pairs of one interval join before
    assert "FlatMapCoGroupsInArrow" in plan(got)


def test_nearest_neighbours_meet_in_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    monkeypatch.setattr(ml, "BLOCK", 30)
    rows = [(i, float(rnd.randrange(3)), *[float(rnd.randrange(6)) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label double, a double, b double, c double")
    a, b = df.where("id < 220"), df.where("id >= 220")
    got = ml.knn(a, b, "id", "id", ["a", "b", "c"], cells=4)
    train = [r for r in rows if r[0] < 220]
    sd = [(sum((r[c] - sum(x[c] for x in train) / 220) ** 2 for r in train) / 219) ** 0.5 for c in (2, 3, 4)]
    want = {}
    for q in rows[220:]:
        near = sorted((round(sum(((q[c] - r[c]) / s) ** 2 for c, s in zip((2, 3, 4), sd)), 9), r[1]) for r in train)[:5]
        want[q[0]] = max({y for _, y in near}, key=lambda y: (sum(v == y for _, v in near), -y))
    same = sum(r["prediction"] == want[r["id"]] for r in got.collect())
    # equal distances may differ in the last digit once they are scaled
    assert got.count() == 80 and same >= 76
    assert "FlatMapCoGroupsInArrow" in plan(got)


def test_logs_and_traces_without_pairs_are_those_of_the_pairs(spark):
    """Traces of one span and of many, cut by windows or not, spans sent twice, ids that are empty or null, logs without a span."""
    rnd = random.Random(7)
    inc = _incidents(spark, rnd).where("anomaly_id is not null").withColumn("asset_id", F.coalesce("asset_id", F.lit("a1")))
    when = lambda: AT + timedelta(microseconds=rnd.randrange(200_000_000_000))
    logs, spans = [], []
    for i in range(2500):
        t, asset, n = when(), f"a{i % 2}", rnd.choice([1, 1, 1, 2, 9])
        trace = rnd.choice(["", None, *[f"{i:04}"] * 60])
        for k in range(n):
            at = t + timedelta(minutes=rnd.choice([0, 0, 1, 40]) * k)
            spans.append((asset, at, rnd.choice([None, *[at + timedelta(seconds=rnd.randrange(9999))] * 9]), 1, trace, rnd.choice(["", None, *[f"s{k}"] * 30]), rnd.choice(["", "", "s0", None]),
                          f"op{k}", rnd.choice(["ok", "ok", "error", None]), "svc"))
        sev = rnd.choice([("ERROR", 17), ("INFO", 9), ("fatal", 21), (None, None), ("INFO", 17), ("error", None)])
        logs.append((asset, t + timedelta(seconds=rnd.choice([0, 3, 4000])), *sev, rnd.choice([None, f"body {i}"]), trace, "s0", rnd.choice(["x", None])))
    logs += [(None, AT, "ERROR", 17, "b", "t", "s", "x"), ("a0", None, "ERROR", 17, "b", "t", "s", "x"), *logs[:40]]
    lg = spark.createDataFrame(logs, "asset_id string, ts timestamp, severity string, severity_num int, body string, trace_id string, span_id string, service_name string")
    sp = spark.createDataFrame([*spans, *spans[:60]], "asset_id string, start_ts timestamp, end_ts timestamp, duration_ns long, trace_id string, span_id string, parent_id string, name string, status string, service_name string")
    # ids that come twice stay, and one window is longer than a slice
    inc = inc.withColumn("until", F.when(F.col("anomaly_id") == "7", F.col("until") + F.expr("interval 9 hours")).otherwise(F.col("until")))
    # more windows in a slice than are told at once
    noon = F.lit("2024-01-01 12:00:00").cast("timestamp")
    inc = inc.unionByName(inc.where("anomaly_id > '3'").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("anomaly_id", F.concat("anomaly_id", F.lit("x"), "x")).drop("x")
                          .withColumn("start", noon).withColumn("logs_from", noon).withColumn("until", noon + F.expr("interval 90 minutes")))
    got = evidence._told_of(inc, lg, sp, 86400)
    # spans by start and id are in no order where both are equal, so roots are compared by whether there is one
    plain = lambda d: {r["anomaly_id"]: (*[[tuple(x) for x in r[c] or []] for c in ("error_logs", "correlation")], [(*x[:2], x[2] is None, *x[3:]) for x in r["error_traces"] or []],
                                         *[r[c] for c in ("logs", "error_log_count", "spans", "error_spans")]) for r in d.collect()}
    want = plain(evidence._told_in_pairs(inc.where("start is not null"), lg, sp, 86400))
    assert len(want) > 50 and any(len(v[0]) == 50 for v in want.values()) and any(len(v[2]) == 20 for v in want.values()) and plain(got) == want
    # logs and windows met in pairs of an interval join alone before
    assert "FlatMapCoGroupsInArrow" in plan(got)


def test_points_of_packs_without_pairs_are_those_of_the_pairs(spark):
    rnd = random.Random(11)
    inc = _incidents(spark, rnd).where("anomaly_id is not null")
    at = rnd.sample(range(200_000), 40_000)
    pts = [(f"a{i % 2}", "m", AT + timedelta(seconds=t), rnd.choice([None, float("nan"), *[rnd.randrange(-9, 9) / 7] * 8])) for i, t in enumerate(at)]
    pts = spark.createDataFrame([*pts, ("a0", "m", None, 1.0), (None, "m", AT, 2.0)], "asset_id string, metric string, ts timestamp, value double")
    text = lambda d: {r["anomaly_id"]: str(r["puntos"]) for r in d.collect()}
    few = series.every(series.peaks(evidence.incident_points(inc.where("start is not null"), pts, "ts"), ["anomaly_id"], "ts", "value", 180), ["anomaly_id"], "ts", 60)
    want = text(few.groupBy("anomaly_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ts").alias("t"), significant(F.col("value")).alias("v")))).alias("puntos")))
    got = evidence.pack_points(inc, pts, "ts")
    assert len(want) > 50 and text(got) == want
    assert "FlatMapCoGroupsInArrow" in plan(got)


def test_short_traces_are_walked_as_long_ones_are_ranked(spark, monkeypatch):
    """Forests with ties, orphans, cycles, repeats, spans without an id, a trace without one, and a chain."""
    rnd = random.Random(2)
    rows = [(f"t{t}", f"s{i}", rnd.choice(["", None, f"s{i}", f"s{i + 1}", *[f"s{rnd.randrange(i + 1)}" for _ in range(9)]]), rnd.choice([None, *[AT + timedelta(seconds=rnd.randrange(5) * 40)] * 9]))
            for t in range(30) for i in range(rnd.randrange(1, 25))]
    rows += [("chain", f"c{i:03}", f"c{i - 1:03}", AT) for i in range(40)] + rows[:50] + [("n", None, "", AT), ("n", "a", "", AT), (None, "a", "", AT)]
    sp = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, start_ts timestamp")
    for ordered in (True, False):
        got = tracing.span_tree(sp, ordered)
        assert sorted(map(str, got.collect())) == sorted(map(str, tracing._by_ranking(sp, ordered).collect()))
        # all traces were ranked by joins before
        assert "FlatMapGroupsInArrow" in plan(got)
    monkeypatch.setattr(tracing, "TRACE_SPANS", 12)
    monkeypatch.setattr(tracing, "TOGETHER", 50)
    assert sorted(map(str, tracing.span_tree(sp).collect())) == sorted(map(str, tracing._by_ranking(sp, True).collect()))


def test_svm_passes_over_few_written_parts(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(float(y), y + rnd.gauss(0, .4), rnd.gauss(0, 1), (y == 1) + rnd.gauss(0, .4)) for y in (rnd.randrange(3) for _ in range(400))]
    df = spark.createDataFrame(rows, "label double, a double, b double, c double").repartition(40)
    seen, fit = [], ml.OneVsRest.fit
    monkeypatch.setattr(ml.OneVsRest, "fit", lambda self, rows: seen.append(rows) or fit(self, rows))
    svm = ml.linear_svm(["a", "b", "c"], max_iter=5)
    got = svm.fit(df).transform(df).groupBy("a", "label", "prediction").count().collect()
    # every pass of every class ran the plan of the rows in as many tasks as it had partitions before
    assert seen[0].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and "Exchange" not in plan(seen[0])
    plain = Pipeline(stages=svm.getStages()).fit(df).transform(df).groupBy("a", "label", "prediction").count().collect()
    assert len(set(map(tuple, got)) & set(map(tuple, plain))) >= 398 and sum(r["label"] == r["prediction"] for r in got) > 250


def test_svm_is_trained_until_its_search_ends(spark, folder, monkeypatch):
    """Two classes apart by a small difference of two coordinates that go together."""
    rnd, rows = random.Random(5), []
    for i in range(100):
        y, g = rnd.randrange(2), rnd.gauss(0, 1)
        rows.append((i, y, [g, g + .4 * (y - .5 + rnd.uniform(-.3, .3))]))
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    models, fit = [], ml.OneVsRest.fit
    monkeypatch.setattr(ml.OneVsRest, "fit", lambda self, rows: models.append(fit(self, rows)) or models[-1])
    entry = queries()
    # five iterations before: a macro F1 of 0.697
    assert tuple(entry["m06_svm_predictions"](spark, folder).first()) == (1.0, 1.0)
    want = sorted((float(y), n) for y, n in Counter(y for _, y, _ in rows[70:]).items())
    assert sorted(map(tuple, entry["m06_svm_support"](spark, folder).collect())) == want
    # five and two iterations before, both stopped by the count
    assert len(models) == 2 and all(5 < m.summary().totalIterations < m.getMaxIter() for found in models for m in found.models)


def test_identifiers_are_searched_near_their_signs(spark):
    """Shapes in the runs that hold a sign, known values between their first and last letters: the places are those of the whole texts."""
    rnd = random.Random(6)
    bits = ["10.0.0.7", "300.1.1.1", ".", ":", "::", "fe80::1", "%eth0", "12:30:45", "1:2:3:4:5:6:7:8", "-", "i-0abc1234", "\u0131-0abc1234", "ip-10-0-0-1", ".ec2", "/subscriptions/123e4567-e89b-12d3-a456-426614174000", "/x(1)",
            "/\u017fUBSCRIPTIONS/", "aws:", "vm/7", "AWS:\u212a/9", "[IP_1]", "[ID_", "]", "(", " ", " ", " ", "\n", "\n12\n", ",", "word", "Word.", "\u00f1and\u00fa", "web-01", "WEB-01", "\u0663", "\U0001d7d9", "\u00b2", "_", "a", "A-1", "-1", "Is", "\u0130\u017f"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    texts += ["a.b" * 20000 + " 10.0.0.9", "plain words - and more, " * 5000 + "host 10.0.0.7 and others"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, _t string")
    every = [f"{redaction.FLAGS}{redaction.BEFORE}{p}{redaction.AFTER}" for _, p in redaction.SHAPES]
    whole = t.select("k", F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), redaction._places(F.col("_t"), F.lit(p)).alias("places")) for i, p in enumerate(every)])).alias("f")).select("k", "f.*")
    hits = redaction._offsets(whole, ["k", "nth"]).where(F.when(F.col("nth") == 6, redaction.is_ipv4(F.col("hit"))).when(F.col("nth") == 5, redaction.is_ipv6(F.col("hit"))).otherwise(True))
    want = sorted((r["k"], r["s"], r["e"], r["hit"]) for r in hits.collect())
    got = redaction.shaped(t, ["k"]).where("kind is not null")
    assert len(want) > 1500 and sorted((r["k"], r["s"], r["e"], r["hit"]) for r in got.collect()) == want
    # all shapes were searched in whole texts before
    assert spark.createDataFrame([(texts[-1],)], "t string").select(redaction.runs(F.col("t"))).first()[0] == f"\n{24 * 5000 + 5}\n10.0.0.7"

    values = ["web-01", "is", "a-1", "a", "\u00f1and\u00fa", "10.0.0.7"]
    known = spark.createDataFrame([(v, "ID") for v in values], "value string, kind string")
    want = []
    for v in values:
        found = t.select("k", redaction._places(F.col("_t"), F.lit(f"{redaction.FLAGS}{redaction.BEFORE}\\Q{v}\\E{redaction.AFTER}")).alias("places"), F.regexp_extract_all(F.lower("_t"), F.lit(f"({redaction.WORD})")).alias("w"))
        # a value is asked for where its rarest word stands
        found = found.where(F.array_contains("w", {"web-01": "01", "a-1": "1", "10.0.0.7": "0"}.get(v, v)))
        want += [(r["k"], r["s"], r["e"], r["hit"]) for r in redaction._offsets(found, ["k"]).collect()]
    named = redaction.named(t, ["k"], known)
    assert len(want) > 500 and sorted((r["k"], r["s"], r["e"], r["hit"]) for r in named.collect()) == sorted(want)
