"""CSV inputs, remaining sinks, model helpers, back-fill and the truth loader."""

import json
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidegauge.operators import features, ml
from tidegauge.sources import files, otlp, sinks, versions
from tidegauge.streaming import ingest, rollup

T0 = datetime(2024, 1, 1)


def put(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_inputs(spark, folder):
    cols = [c.split()[0] for c in files.LABELLED.split(", ")]
    put(f"{folder}/d.csv", ",".join(cols) + "\n2024-01-01 00:00:00+00:00,A" + ",0.5" * 13 + ",campana,u1,disco_gradual\n")
    r = files.labelled_rows(spark, f"{folder}/d.csv").first()
    assert (r["asset_id"], r["time"], r["tasa_errores_pedidos"], r["ref_tipo_eval"]) == ("A", T0, 0.5, "disco_gradual")
    put(f"{folder}/i.csv", 'uid,tipo,nodo,activo,inicio,fin,intensidad,parametros,estado\n1,disco,n,A,2024-01-01 00:00:00+00,,alta,"{""modo"": ""abrupto""}",completada\n'
        '2,disco,n,,2024-01-01T00:00:00Z,2024-01-01T01:00:00Z,alta,bad,completada\n3,cpu,n,A,2024-01-01T00:00:00Z,,x,{},en_curso\n')
    got = {x["uid"]: x for x in files.injections_csv(spark, f"{folder}/i.csv").collect()}
    assert [got[k]["type"] for k in "123"] == ["disco_abrupto", "disco_gradual", "cpu"] and got["2"]["asset_id"] is None and got["1"]["start"] == T0 and got["1"]["end"] is None
    put(f"{folder}/a.csv", 'id,activo,metrica,dimensiones,inicio,fin,estado,severidad,puntaje,evidencia,version_modelo\n7,A,m,"{""k"": ""v""}",2024-01-01T00:00:00+00:00,,detectada,alta,4.2,{},mad-v2\n')
    a = files.anomalies_csv(spark, f"{folder}/a.csv").first()
    assert (a["anomaly_id"], a["dims"], a["start"], a["model_version"]) == ("7", {"k": "v"}, T0, "mad-v2")
    put(f"{folder}/keys.json", '{"node-do": "activo-do-01", "x": "other"}')
    assert {r["key"]: r["provider"] for r in files.key_file(spark, f"{folder}/keys.json").collect()} == {"node-do": "digitalocean", "x": "desconocido"}


def test_signal_and_json_sinks(spark, folder):
    rows = spark.createDataFrame([("A", "s", T0 + timedelta(days=i % 2), f"t{i}", "b") for i in range(10)], "asset_id string, service_name string, ts timestamp, trace_id string, body string")
    sinks.write_signal(rows, f"{folder}/logs", "ts")
    back = spark.read.parquet(f"{folder}/logs")
    assert back.count() == 10 and back.where("date = '2024-01-02'").count() == 5
    sinks.write_json_lines(rows, f"{folder}/json", "registros", "ts")
    assert spark.read.json(f"{folder}/json").where("signal = 'registros'").count() == 10


def cells(spark, n=400):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        y = 1.0 if (i // 10) % 4 == 3 else 0.0
        rows.append((i, "A", T0 + timedelta(seconds=10 * i), y, rnd.gauss(5 * y, 1), rnd.gauss(0, 1)))
    return spark.createDataFrame(rows, "id int, asset_id string, ts timestamp, label double, a double, b double")


def test_classifiers_and_robustness(spark, folder):
    df, cols = cells(spark), ["a", "b"]
    train, test = ml.time_split(df, "ts")
    assert (train.count(), test.count()) == (280, 120) and train.agg(F.max("ts")).first()[0] < test.agg(F.min("ts")).first()[0]
    model = ml.tree(cols).fit(train)
    s = ml.overall_scores(ml.class_scores(model.transform(test))).first()
    assert s["accuracy"] > 0.9 and s["macro_f1"] > 0.85
    assert ml.overall_scores(ml.class_scores(ml.perceptron(cols, 2, max_iter=30).fit(train).transform(test))).first()["accuracy"] > 0.9
    weak = {r["factor"]: r["recall"] for r in ml.weakened_recall(model, test, cols, "label", 0.0).collect()}
    assert weak[1.0] > 0.9 > weak[0.3]
    blocks = features.blocks(df.withColumn("label", F.col("label").cast("string")), "asset_id", "ts", "label", "0.0").where("start < '2024-01-01 00:20:00'")
    ev = blocks.select("asset_id", F.col("block").alias("event_id"), F.col("label").cast("double").alias("label"), "start", "end")
    left = ml.leave_one_out(df, ev, lambda: ml.tree(cols), cols, "label", "asset_id", "ts", minutes=1)
    assert len(left) == ev.count() >= 2 and min(x["recall"] for x in left) > 0.7
    best = ml.grid_search(ml.time_folds(df, "ts", 3), cols, "label", "fold", depths=(1, 4), leaves=(1,), impurities=("gini",))
    assert best["depth"] == 1 and best["f1"] > 0.9
    from pyspark.ml.functions import array_to_vector
    vec = df.withColumn("features", array_to_vector(F.array("a", "b")))
    e = ml.elbow(vec, ks=(2, 3))
    assert e[0][1] > e[1][1] and e[0][2] > 0
    km = ml.train_kmeans(vec, k=2, restarts=2)
    names = ml.profile_names(km, cols)
    lab = ml.labelled(df.withColumnRenamed("id", "row"), ml.assign(km, vec).select(F.col("id").alias("row"), "cluster"), names, ["row"], cols)
    assert lab.count() == 400 and lab.select("profile").distinct().count() <= 2
    base = features.history_baseline(features.unpivoted(df, ["asset_id", "ts"], cols))
    ml.save_baseline(base, f"{folder}/base")
    assert spark.read.parquet(f"{folder}/base").count() == 2


def test_backfill_resumes(spark, folder):
    df = spark.createDataFrame([(i,) for i in range(30)], "x int")
    df.repartition(3).write.parquet(f"{folder}/in")
    seen = []
    for _ in range(2):
        rollup.backfill(spark, f"{folder}/in", df.schema, f"{folder}/cp", lambda b, i: seen.append((i, b.count())), 1).awaitTermination()
    assert sum(n for _, n in seen) == 30 and len(seen) == 3


def test_truth_loader_is_order_free_and_repeatable(spark, folder):
    lines = [{"uid": "1", "evento": "fin", "fin": "2024-01-01T00:10:00Z", "estado": "completada"},
             {"uid": "1", "evento": "inicio", "tipo": "cpu", "nodo": "n1", "inicio": "2024-01-01T00:00:00Z", "intensidad": "alta", "parametros": {"p": "1"}}]
    logs = spark.createDataFrame([(json.dumps(b), "sin_resolver", i) for i, b in enumerate(lines)], "body string, asset_id string, time_ns bigint")
    keys = spark.createDataFrame([("n1", "A", "host.name", "p")], ingest.KEYS)
    for _ in range(2):
        out = ingest.load_truth(spark, logs, keys, f"{folder}/inj").collect()
        assert [(r["uid"], r["state"], r["asset_id"], r["end"]) for r in out] == [("1", "completada", "A", T0 + timedelta(minutes=10))]
    assert versions.next_version(spark, f"{folder}/inj") == 2


def test_listing_pages_from_files(spark, folder):
    put(f"{folder}/do.json", json.dumps({"droplets": [{"id": 1, "name": "a", "region": {"slug": "nyc3"}, "tags": ["x"]}, {"id": 2, "name": "b", "tags": []}]}, indent=1))
    assert [(r["native_id"], r["region"]) for r in files.droplets(files.pages(spark, f"{folder}/do.json"), tag="x").collect()] == [("droplet/1", "nyc3")]
    put(f"{folder}/pve.json", json.dumps({"data": [{"id": "qemu/1", "template": 1}, {"id": "qemu/2", "name": "", "tags": "x;y"}, {"id": "lxc/3", "name": "c", "tags": "z"}]}))
    assert [r["name"] for r in files.proxmox_vms(files.pages(spark, f"{folder}/pve.json"), tag="x").collect()] == ["qemu/2"]


def test_nested_values_and_bytes(spark):
    line = {"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [
        {"observedTimeUnixNano": "1704067200000000001", "body": {"bytesValue": "AQI="}, "traceId": "AB", "attributes": [{"key": "k", "value": {"boolValue": True}}, {"key": "k", "value": {"intValue": "5"}}, {"key": "e", "value": {}}]},
        {"timeUnixNano": "1704067200000000000", "body": {"arrayValue": {"values": [{"stringValue": 'a"b'}, {"intValue": "1"}, {"boolValue": False}]}}}]}]}]}
    df = otlp.parsed(spark.createDataFrame([(json.dumps(line),)], "value string"), "logs")
    a, b = otlp.log_rows(df, F.lit(datetime(2030, 1, 1, tzinfo=timezone.utc))).collect()
    assert (a["body"], a["trace_id"], a["attributes"], a["time_ns"]) == ("0102", "ab", {"k": "5", "e": ""}, 1704067200000000001)
    assert b["body"] == '["a\\"b", 1, false]' and b["ts"] == T0


def test_invoices_of_any_width_with_line_ends_in_quotes(spark):
    from tidegauge.sources import files
    head = [f"extra{i}" for i in range(60)] + ["Description", "USD", "start", "end", "product"]
    line = [""] * 60 + ['"two\nlines, ""quoted"""', '"$1,234.50"', "2024-01-01", "2024-01-31", '""']
    text = ",".join(head) + "\r\n" + ",".join(line) + "\n" + ",".join([""] * 65) + "\n"
    f = spark.createDataFrame([("a.csv", bytearray(text.encode()), "d1", len(text)), ("b.csv", bytearray(b"x"), "d2", 5_000_000)], "file string, content binary, digest string, bytes bigint")
    charges, refused = files.invoice_charges(f)
    r = charges.collect()
    assert [(x["description"], float(x["amount"]), x["line"]) for x in r] == [('two\nlines, "quoted"', 1234.5, 2)]
    assert [(x["file"], x["reason"]) for x in refused.collect()] == [("b.csv", "file over 2 MB")]
    assert [x["file"] for x in files.invoice_charges(f, max_lines=0)[1].where("reason = 'too many lines'").collect()] == ["a.csv"]


def test_span_tree_of_any_depth_and_cycles(spark):
    from tidegauge.operators import logs
    n = 1500
    rows = [("t", f"s{i}", f"s{i - 1}" if i else "", i) for i in range(n)] + [("t", "x", "y", 1), ("t", "y", "x", 2), ("u", "z", "s3", 1)]
    sp = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, n int").withColumn("start_ts", F.timestamp_seconds("n"))
    got = {(r["trace_id"], r["span_id"]): r["level"] for r in logs.span_tree(sp).select("trace_id", "span_id", "level").collect()}
    assert got == {("t", f"s{i}"): i for i in range(n)} | {("u", "z"): 0}


def test_layers_of_ordered_rows_read_the_input_once(spark, folder):
    import re

    from tidegauge.operators.ordered import with_position
    spark.range(2000).selectExpr("id % 3 as k", "timestamp_seconds(id * 7) as ts", "cast(id as double) as value").write.parquet(f"{folder}/in")
    d = with_position(spark.read.parquet(f"{folder}/in"), ["k"], "ts", 3600)
    rows = sorted((r["k"], r["ts"], r["pos"]) for r in d.collect())
    assert [p for _, _, p in rows] == [i + 1 for k in range(3) for i in range(sum(x[0] == k for x in rows))]
    plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("FileScan", plan)) == 1 and "ReusedExchange" in plan


def test_repeated_spans_deep_chains_and_wide_levels(spark):
    from tidegauge.operators import logs
    n = 20_000
    rows = [("t", f"s{i}", f"s{i - 1}" if i else "", i) for i in range(n)] * 3 + [("w", f"c{i}", "" if i == 0 else "c0", 10_000 - i) for i in range(3000)] * 2
    rows += [("v", "r2", "", 5), ("v", "r1", "", 5), ("v", "a", "r2", None), ("v", "b", "r2", 9), ("v", "b", "r2", 9), ("v", "x", "y", 1), ("v", "y", "x", 2)]
    sp = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, n int").withColumn("start_ts", F.timestamp_seconds("n"))
    out = logs.span_tree(sp).collect()
    assert len(out) == n + 3000 + 4
    got = {(r["trace_id"], r["span_id"]): (r["level"], r["path"]) for r in out}
    assert all(got["t", f"s{i}"] == (i, i) for i in range(n))
    assert got["w", "c0"] == (0, 0) and [k[1] for k, v in sorted(got.items(), key=lambda x: x[1][1]) if k[0] == "w"][1:] == [f"c{i}" for i in range(2999, 0, -1)]
    assert {k[1]: v for k, v in got.items() if k[0] == "v"} == {"r1": (0, 0), "r2": (0, 1), "a": (1, 2), "b": (1, 3)}
    assert {(r["span_id"], r["level"]) for r in logs.span_tree(sp.where("trace_id = 'v'"), ordered=False).collect()} == {("r1", 0), ("r2", 0), ("a", 1), ("b", 1)}
