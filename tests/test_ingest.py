"""OTLP/JSON parsing, invoices, snapshots, truth events, sinks."""

import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import names, times
from tidegauge.operators import catalog, evaluate
from tidegauge.operators import series as S
from tidegauge.sources import files, otlp, sinks, versions

NOW = datetime(2024, 1, 1)
KEYS = "key string, asset_id string, kind string, provider string"
T = str(1704067200_000000000)


def attrs(**kv):
    return [{"key": k, "value": {"stringValue": v}} for k, v in kv.items()]


def metrics(spark, folder, ms, name="m.json"):
    line = {"resourceMetrics": [{"resource": {"attributes": attrs(**{"host.name": "h1"})}, "scopeMetrics": [{"metrics": ms}]}]}
    with open(f"{folder}/{name}", "w") as f:
        f.write(json.dumps(line) + "\nnot json\n")
    return otlp.read(spark, folder, "metrics")


def test_metric_points(spark, folder):
    dp = lambda **k: {"timeUnixNano": T, "attributes": attrs(cpu="cpu0"), **k}
    ms = [
        {"name": "System.CPU", "gauge": {"dataPoints": [dp(asDouble=0.5), dp(asInt="3"), dp(asDouble=1.0, flags=1), dp(), dp(asDouble="NaN")]}},
        {"name": "io", "sum": {"dataPoints": [dp(asInt="7"), {"asInt": "8", "timeUnixNano": "99999999999999999999"}, {"asInt": "9"}]}},
        {"name": "dur", "histogram": {"dataPoints": [dp(count="4", sum=2.5), dp(count="4")]}},
        {"name": "q", "summary": {"dataPoints": [dp(count="2", sum=0.0)]}},
        {"name": "odd"}]
    b = metrics(spark, folder, ms)
    assert b.where("_corrupt_record is not null").count() == 1
    rows = otlp.metric_rows(b.where("_corrupt_record is null"), F.lit(NOW)).collect()
    got = sorted((r["metric"], r["value"]) for r in rows if r["route"] == "valid")
    assert got == [("dur_count", 4.0), ("dur_count", 4.0), ("dur_sum", 2.5), ("io", 7.0), ("io", 9.0), ("q_count", 2.0), ("q_sum", 0.0), ("system_cpu", 0.5), ("system_cpu", 3.0)]
    assert sum(r["route"] == "no_value" for r in rows) == 4 and sum(r["route"] == "error" for r in rows) == 1
    late = next(r for r in rows if r["value"] == 9.0)
    assert late["ts"] == NOW
    pts = otlp.points(otlp.metric_rows(b.where("_corrupt_record is null"), F.lit(NOW)), spark.createDataFrame([("h1", "A", "host.name", "p")], KEYS))
    assert {r["asset_id"] for r in pts.collect()} == {"A"}


def test_names(spark):
    pairs = [("system.cpu.utilization", "system_cpu_utilization"), (" HTTP.Server ", "http_server"), ("9lives", "m_9lives"), ("--", "sin_nombre"), ("select", "select_x"),
             ("a" * 80, "a" * 63), ("é.x", "x"), ("value", "value_x"), ("", "sin_nombre")]
    df = spark.createDataFrame(pairs, "i string, o string").withColumn("got", names.canonical_name("i"))
    assert [(r["o"], r["got"]) for r in df.collect() if r["o"] != r["got"]] == []
    d = spark.createDataFrame([("host.name",), ("time",), ("cpu",)], "i string").withColumn("o", names.canonical_dimension("i"))
    assert [r["o"] for r in d.collect()] == ["host_name_dim", "time_x", "cpu"]
    bad = spark.createDataFrame([("a;drop",), ("A",), ("ok_1",), ("1a",)], "i string").withColumn("o", names.is_identifier("i"))
    assert [r["o"] for r in bad.collect()] == [False, False, True, False]


def test_dates(spark):
    xs = [("2024-01-01T00:00:00Z", True), ("2024-01-01 00:00:00+00", True), ("2023-12-31T19:00:00-05:00", True), ("2024-01-01T00:00:00", False), ("x", None)]
    df = spark.createDataFrame([(a,) for a, _ in xs], "s string").select("s", times.parse_instant(F.col("s")).alias("a"), times.parse_instant(F.col("s"), True).alias("b"))
    for row, (_, zoned) in zip(df.collect(), xs):
        assert row["a"] == (None if zoned is None else NOW)
        assert row["b"] == (NOW if zoned else None)


CSV = """﻿product,group_description,description,hours,start,end,USD,project_name,category
Droplets,,node-a (s-1vcpu),720,2026-09-01 00:00:00 +0000,2026-10-01 00:00:00 +0000,$28.80,p,c
Droplets,,activo-do-b disk,720,2026-09-01 00:00:00 +0000,2026-10-01,"12.00",p,c
Backups,node-a and node-c,copies,1,2026-09-02,,0.00,p,c

Spaces,,bucket xnode-a,1,2026-09-03,,1.37,p,c
"""


def test_invoices(spark, folder):
    for n, t in {"a.csv": CSV, "same.csv": CSV, "bad.csv": CSV.replace("1.37", "n/a"), "cols.csv": "x,y\n1,2\n"}.items():
        with open(f"{folder}/{n}", "w", encoding="utf-8") as f:
            f.write(t)
    fs = files.invoice_files(spark, folder)
    new = files.new_files(fs, spark.createDataFrame([], "digest string"))
    assert new.count() == 3
    charges, refused = files.invoice_charges(new)
    assert sorted(r["reason"] for r in refused.collect()) == ["line 6: not a number", "missing columns"]
    keys = spark.createDataFrame([("node-a", "activo-do-a", "host.name", "p"), ("node-b", "activo-do-b", "host.name", "p"), ("node-c", "activo-do-c", "host.name", "p")], KEYS)
    from tidegauge.operators import costs
    got = {r["line"]: r for r in costs.attribute(charges, keys, "line", ["description", "group_text"]).collect()}
    assert [got[i]["asset_id"] for i in (2, 3, 4, 6)] == ["activo-do-a", "activo-do-b", None, None]
    assert "varios" in got[4]["reason"] and got[6]["reason"].startswith("ningun")
    assert float(sum(r["amount"] for r in got.values())) == 42.17
    assert got[2]["start"] == date(2026, 9, 1) and got[2]["end"] == date(2026, 10, 1)
    assert files.new_files(fs, new.select("digest")).count() == 0


def test_snapshots(spark):
    ok = {"nodo": "n", "entorno": "lab", "tomada_en": "2024-01-01T00:00:00", "version_agente": "1", "intervalo_muestreo_s": 10,
          "puertos": [{"puerto": 22, "protocolo": "tcp", "direccion": "0.0.0.0", "proceso": "sshd"}], "contenedores": [{"nombre": "c", "imagen": "i", "version": "1", "usuario": ""}]}
    bads = [{**ok, "nodo": ""}, {**ok, "tomada_en": "x"}, {**ok, "intervalo_muestreo_s": 0}, {**ok, "intervalo_muestreo_s": "10"}, {**ok, "puertos": "no"},
            {**ok, "puertos": [{"puerto": 70000, "protocolo": "tcp", "direccion": "a"}]}, {**ok, "contenedores": [{"nombre": "", "imagen": "i"}]}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate([ok, *bads])] + [(99, "[1")], "i int, line string")
    good, rejected = files.snapshots(df, "line", spark.createDataFrame([("n", "A", "host.name", "p")], KEYS), F.col("i"))
    assert [(r["seq"], r["asset_id"], r["ports"][0]["puerto"]) for r in good.collect()] == [(0, "A", 22)]
    assert rejected.count() == 8


def truth(spark, rows):
    logs = [(i, json.dumps(b) if isinstance(b, dict) else b, a, i) for i, (b, a) in enumerate(rows)]
    return otlp.truth_events(spark.createDataFrame(logs, "i int, body string, asset_id string, time_ns bigint"), F.col("time_ns"))


def test_truth_ledger(spark):
    a = {"uid": "1", "evento": "inicio", "tipo": "cpu", "nodo": "n1", "inicio": "2024-01-01T00:00:00Z", "intensidad": "alta", "parametros": {"p": "1"}}
    z = {"uid": "1", "evento": "fin", "fin": "2024-01-01T00:10:00Z", "estado": "completada", "motivo": "m"}
    rows = [(z, "sin_resolver"), (a, "sin_resolver"), ({**a, "uid": "2"}, "A"), ({**a, "uid": "3", "tipo": "otro"}, "A"), ({**a, "uid": "4", "inicio": "2024-01-01T00:00:00"}, "A"),
            ({**z, "uid": "5"}, "A"), ("plain text", "A"), ("{broken", "A"), ({"evento": "inicio"}, "A")]
    good, bad = evaluate.pair_events(truth(spark, rows))
    got = {r["uid"]: r for r in good.collect()}
    assert sorted(got) == ["1", "2"] and sorted(r["uid"] for r in bad.collect()) == ["3", "4"]
    assert got["1"]["params"] == {"p": "1", "motivo": "m"} and got["1"]["state"] == "completada" and got["2"]["end"] is None
    empty = spark.createDataFrame([], good.schema)
    first = evaluate.merge_injections(empty, good)
    assert first.where("changed").count() == 2
    state = spark.createDataFrame(first.drop("changed").collect(), good.schema)
    assert evaluate.merge_injections(state, good).where("changed").count() == 0
    older, _ = evaluate.pair_events(truth(spark, [(a, "B")]))
    m = {r["uid"]: r for r in evaluate.merge_injections(state, older).collect()}
    assert (m["1"]["state"], m["1"]["asset_id"], m["1"]["end"]) == ("completada", "B", got["1"]["end"])
    keys = spark.createDataFrame([("n1", "K", "host.name", "p")], KEYS)
    assert {r["asset_id"] for r in evaluate.fill_assets(state, keys).collect()} == {"K", "A"}


POINT = ("metric string, ts timestamp, time_ns bigint, value double, asset_id string, host_name string, service_name string, cloud_provider string, "
         "cloud_region string, deployment_environment string, dims map<string,string>, received_at timestamp, date date")


def test_sink_export_and_retention(spark, folder):
    tags = ("A", "h", "s", "p", "r", "e")
    rows = [(m, NOW + timedelta(days=d), d * 10 ** 9, float(d), *tags, {"k": "1"}, NOW + timedelta(days=d + late), (NOW + timedelta(days=d)).date())
            for m in ("cpu", "mem") for d in range(4) for late in (0, 1)]
    df = spark.createDataFrame(rows, POINT)
    sinks.write_points(df, f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    assert raw.count() == 8
    inj = spark.createDataFrame([("1", NOW, None, {"a": "b"}), ("2", NOW - timedelta(days=9), NOW - timedelta(days=8), None)], "uid string, start timestamp, end timestamp, params map<string,string>")
    gaps = spark.createDataFrame([("A", NOW, NOW, 30.0)], "asset_id string, gap_from timestamp, gap_to timestamp, seconds double")
    a = NOW.replace(tzinfo=timezone.utc)
    sinks.export_range(raw.select(*df.columns), inj, gaps, a, a + timedelta(days=2), f"{folder}/export")
    assert sinks.read_export(spark, f"{folder}/export", "cpu").count() == 2
    assert sinks.read_export(spark, f"{folder}/export", "ghost").count() == 0
    assert spark.read.csv(f"{folder}/export/injections", header=True).count() == 1
    assert {r["metric"]: r["rows"] for r in spark.read.json(f"{folder}/export/manifest").collect()} == {"cpu": 2, "mem": 2}
    assert len(sinks.drop_old(spark, f"{folder}/raw", 2, date(2024, 1, 4))) == 2
    assert spark.read.parquet(f"{folder}/raw").count() == 6


def test_versions_fall_back(spark, folder):
    root = f"{folder}/state"
    assert versions.latest(spark, root, "x int").count() == 0
    for v in (1, 2):
        versions.publish(spark.createDataFrame([(v,)], "x int"), root, v)
    assert versions.latest(spark, root, "x int").first()["x"] == 2 and versions.latest(spark, root, "x int", 1).first()["x"] == 1
    import glob
    for f in glob.glob(f"{root}/v=000000000002/*.parquet"):
        with open(f, "wb") as h:
            h.write(b"broken")
    for f in glob.glob(f"{root}/v=000000000002/.*.crc"):
        with open(f, "wb") as h:
            h.write(b"")
    assert versions.last_good(spark, root, "x int").first()["x"] == 1


def test_requests_are_checked(spark):
    a = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for z, limit in ((a, None), (a + timedelta(days=181), None), (a + timedelta(days=1), 0), (a + timedelta(days=1), 2001)):
        with pytest.raises(ValueError):
            times.check_range(a, z, 180, limit)
    with pytest.raises(ValueError):
        times.check_trace_id("XYZ")
    assert [S.level_for(a, a + timedelta(hours=h)) for h in (24, 25, 720, 721)] == ["raw", "1m", "1m", "1h"]
    assert S.step_for("1m", a, a + timedelta(days=3)) == 300 and S.step_for("1m", a, a + timedelta(days=1, hours=1)) == 60
    df = spark.createDataFrame([({"cpu": "0"},)], "dims map<string,string>")
    with pytest.raises(ValueError):
        S.with_filters(df, {"ghost": "1"}, ["cpu"])


def test_known_identifiers(spark):
    a = spark.createDataFrame([("id1", "web")], "asset_id string, name string")
    k = spark.createDataFrame([("web", "id1", "host.name", "p"), ("aws:i-1", "id1", "nativo", "p")], KEYS)
    assert {r["value"]: r["kind"] for r in catalog.known_identifiers(a, k).collect()} == {"id1": "ACTIVO", "web": "ANFITRION", "aws:i-1": "ID"}
