"""Closing, evaluation, evidence, redaction, clustering properties."""

import ipaddress
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidegauge.functions import redaction
from tidegauge.operators import costs, evaluate, evidence, features, incidents, ml, signals

T0 = datetime(2024, 1, 1)


def at(m):
    return T0 + timedelta(minutes=m)


def closing(spark, points, med=10.0, scale=1.0, start=0):
    pts = spark.createDataFrame([("s", at(m), float(v)) for m, v in points], "series string, bucket timestamp, value double")
    op = spark.createDataFrame([("a", "s", at(start), med, scale)], "anomaly_id string, series string, start timestamp, med double, scale double")
    got = incidents.closings(op, pts, ["series"], bucket_seconds=3600).collect()
    return got[0]["end"] if got else None


def test_closing_rule(spark):
    bad = [(m, 50) for m in range(-5, 10)]
    calm = lambda a, n: [(m, 10) for m in range(a, a + n)]
    assert closing(spark, bad) is None
    assert closing(spark, bad + calm(10, 14)) is None
    assert closing(spark, bad + calm(10, 15)) == at(10)
    assert closing(spark, bad + calm(10, 40)) == at(10)
    assert closing(spark, bad + calm(10, 8) + calm(40, 8)) is None
    assert closing(spark, bad + calm(10, 8) + calm(40, 15)) == at(40)
    assert closing(spark, bad + calm(10, 5) + [(15, 50)] + calm(16, 16)) == at(16)
    assert closing(spark, [(m, 50) for m in range(200)]) is None
    assert closing(spark, bad + calm(10, 15), scale=None) is None
    # 0.3 % above before: the closing floor of 5 % of the median calls it normal
    assert closing(spark, [(m, 1003) for m in range(0, 30)], med=1000.0, scale=0.01) == at(1)


INJ = "uid string, type string, asset_id string, start timestamp, end timestamp, state string"
ANO = "anomaly_id string, asset_id string, metric string, start timestamp, state string, model_version string"


def judge(spark, injections, anomalies, **kw):
    i = spark.createDataFrame(injections, INJ)
    a = spark.createDataFrame([(str(n), *x) for n, x in enumerate(anomalies)], ANO)
    v = evaluate.judged(a, i, F.lit(T0), F.lit(T0 + timedelta(days=1)), **kw)
    return v, evaluate.per_injection(i, v, F.lit(T0), F.lit(T0 + timedelta(days=1)))


def test_evaluation_cases(spark):
    inj = [("a", "cpu", "A", at(100), at(110), "completada"), ("b", "memoria", "A", at(300), None, "completada"), ("c", "cpu", "A", at(400), at(410), "fallida"),
           ("d", "latencia", "A", at(500), at(510), "completada"), ("e", "disco", "A", at(700), at(710), "completada")]
    an = lambda m, asset="A", state="detectada", ver="mad-v2": (asset, "m", at(m), state, ver)
    v, per = judge(spark, inj, [an(100), an(115), an(116), an(99), an(105, "B"), an(305), an(306), an(405), an(505), an(112, ver="mad-v1"), an(2000), an(104, state="falso_positivo")], version="mad-v2")
    got = {int(r["anomaly_id"]): (r["verdict"], r["uid"], r["reason"]) for r in v.collect()}
    assert got[0] == ("correcta", "a", None) and got[1] == ("correcta", "a", None) and got[5] == ("correcta", "b", None)
    assert [got[i][0] for i in (2, 3, 4, 6)] == ["falso_positivo"] * 4
    assert got[7] == ("ignorada", None, "inyeccion fallida") and got[8] == ("ignorada", None, "latencia, fuera del alcance")
    assert 9 not in got and 10 not in got
    p = {r["uid"]: r for r in per.collect()}
    assert sorted(p) == ["a", "b", "e"] and p["a"]["delay_min"] == 0.0 and not p["e"]["detected"] and p["a"]["anomalies"] == 3
    t = evaluate.totals(per, v).first()
    assert (t["injections"], t["detected"], t["correct"], t["false_positives"]) == (3, 2, 4, 4) and abs(t["recall"] - 2 / 3) < 1e-12 and t["delay_median"] == 2.5
    m = evaluate.operator_marks(v).first()
    assert (m["marked"], m["right"], m["wrong"], m["unmarked"]) == (1, 0, 1, 4)


def test_later_injection_wins(spark):
    v, _ = judge(spark, [("x", "cpu", "A", at(0), at(60), "completada"), ("y", "cpu", "A", at(30), at(40), "completada")], [("A", "m", at(35), "d", "v"), ("A", "m", at(50), "d", "v")])
    assert {r["anomaly_id"]: r["uid"] for r in v.collect()} == {"0": "y", "1": "x"}


def test_slices_do_not_lose_long_intervals(spark):
    i = spark.createDataFrame([("k", at(0), at(5000))], "key string, a timestamp, z timestamp")
    p = spark.createDataFrame([("k", at(m)) for m in (-1, 0, 1, 1440, 4999, 5000, 5001)], "key string, t timestamp")
    assert evaluate.overlap_join(p, i, "key", "t", "a", "z", width=3600).count() == 5


def test_sweep_meets_every_fault(spark):
    from tidegauge.operators import detect
    day = lambda d, m=0: T0 + timedelta(days=d, minutes=m)
    spikes = {75: 500.0, 76: 500.0, 85: 500.0, 86: 500.0}
    pts = spark.createDataFrame([("A", "m", day(d), spikes.get(d, 10.0 + d % 3), 1.0) for d in range(90)], "asset_id string, metric string, bucket timestamp, value double, floor double")
    # events start on days 76 and 86: one fault is open, one covers three days, the others miss by minutes or by asset
    inj = spark.createDataFrame([("open", "A", day(76, -5), None), ("long", "A", day(84), day(87)), ("late", "A", day(76, 1), day(77)), ("past", "A", day(85), day(86, -6)), ("other", "B", day(76), day(77))],
                                "uid string, asset_id string, start timestamp, end timestamp")
    got = {r["setting"]: (r["events"], r["inside"], r["noise"], r["found"], r["high_inside"]) for r in detect.sweep(pts, ["asset_id", "metric"], inj, run=2).collect()}
    assert len(got) == 7 and all(v[:4] == (2, 2, 0, 2) for k, v in got.items() if "piso relativo 5" not in k), got


def plain_redact(texts, known):
    """Every place tried by hand: known values first, then shapes, at each position from the left."""
    low = {k.lower().strip(): v for k, v in known.items() if not k.isdigit()}
    edge = lambda t, a, z: not (a and (t[a - 1].isalnum() or t[a - 1] in "_.-")) and not (z < len(t) and (t[z].isalnum() or t[z] in "_-" or t[z] == "." and z + 1 < len(t) and (t[z + 1].isalnum() or t[z + 1] == "_")))
    counts, marks, out, back = {}, {}, [], {}
    for t in texts:
        blocked = {i for m in re.finditer(redaction.MARKER, t) for i in range(*m.span())}
        res, at = "", 0
        while at < len(t):
            was = at
            hits = [(len(k), v) for k, v in low.items() if t[at:at + len(k)].lower() == k and edge(t, at, at + len(k))]
            if not hits:
                for kind, p in redaction.SHAPES:
                    m = re.compile(redaction.BEFORE + p + redaction.AFTER, re.I).match(t, at)
                    if m and kind in ("IP4", "IP6"):
                        try:
                            ipaddress.ip_address(m[0])
                        except ValueError:
                            res, at = res + m[0], m.end()  # what only looks like an address is left as a whole
                            break
                    if m:
                        hits.append((len(m[0]), "IP" if kind.startswith("IP") else kind))
            if at > was:
                continue
            hits = [(n, k) for n, k in hits if not blocked & set(range(at, at + n))]
            if not hits:
                res, at = res + t[at], at + 1
                continue
            n, kind = max(hits)
            key = (kind, t[at:at + n].lower())
            if key not in marks:
                counts[kind] = counts.get(kind, 0) + 1
                marks[key] = f"[{kind}_{counts[kind]}]"
                back[marks[key]] = t[at:at + n]
            res, at = res + marks[key], at + n
        out.append(res)
    return out, back


def test_redaction(spark):
    texts = ["web-01 talks to db.local at 10.0.0.7, not 300.1.2.3 nor 12:30:45", "WEB-01 again, web-011 not, ip fe80::1%eth0 and 10.0.0.7.", "aws:instancia/i-0abc1234 i-0abc1234 ip-10-0-0-1.ec2",
             "guid 123e4567-e89b-12d3-a456-426614174000 [IP_1] stays; 42 stays", "", "ñandú web-01"]
    known = {"web-01": "ANFITRION", "db.local": "ANFITRION", "42": "ID", "web": "ACTIVO", "aws:instancia/i-0abc1234": "ID"}
    df = spark.createDataFrame([("inc", i, t) for i, t in enumerate(texts)] + [("other", 0, "10.9.9.9")], "incident string, seq int, text string")
    kn = spark.createDataFrame(list(known.items()), "value string, kind string")
    out, marks = redaction.redact(df, "incident", "seq", "text", kn)
    got = {(r["incident"], r["seq"]): r["text"] for r in out.collect()}
    assert [got[("inc", i)] for i in range(len(texts))] == plain_redact(texts, known)[0]
    assert got[("inc", 0)] == "[ANFITRION_1] talks to [ANFITRION_2] at [IP_1], not 300.1.2.3 nor 12:30:45"
    assert got[("inc", 1)].startswith("[ANFITRION_1] again, web-011 not, ip [IP_2] and [IP_1].") and got[("other", 0)] == "[IP_1]"
    assert "42 stays" in got[("inc", 3)] and "[IP_1] stays" in got[("inc", 3)]
    back = redaction.restore(out.where("incident = 'inc' and seq = 0"), "incident", "seq", "text", marks).first()["text"]
    assert back == texts[0] and not re.search(redaction.MARKER, back)


def test_redaction_of_any_characters_and_case(spark):
    texts = ["Customer#000000001 called nodo-ÑU about Customer#000000002.", "see node one (rack 2), NODE ONE (Rack 2) and customer#000000001x", "2001:db8::1 1::2::3 :1: 10:20:30 ::1 1:2:3:4:5:6:7:8 01.2.3.4 1.2.3.4.",
             r"a\Eb[x] and Nodo-ñu; /subscriptions/123e4567-e89b-12d3-a456-426614174000/x", "[ID_9] Customer#000000002[IP_1]"]
    known = {"Customer#000000001": "ID", "Customer#000000002": "ID", "nodo-ñu": "ANFITRION", "node one (rack 2)": "ACTIVO", r"a\Eb[x]": "ID", "node": "ACTIVO"}
    df = spark.createDataFrame([("inc", i, t) for i, t in enumerate(texts)] + [("inc", 9, None)], "incident string, seq int, text string")
    out, marks = redaction.redact(df, "incident", "seq", "text", spark.createDataFrame(list(known.items()), "value string, kind string"))
    want, back = plain_redact(texts, known)
    got = {r["seq"]: r["text"] for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == want and got[9] is None
    assert want[0] == "[ID_1] called [ANFITRION_1] about [ID_2]." and want[1].startswith("see [ACTIVO_1], [ACTIVO_1] and customer#")
    assert {r["marker"]: r["value"] for r in marks.collect()} == back and back["[ANFITRION_1]"] == "nodo-ÑU"
    assert redaction.restore(out.where("seq = 0"), "incident", "seq", "text", marks).first()["text"] == texts[0]


def test_redaction_queries_over_whole_texts(spark, folder):
    import hashlib

    from tidegauge.plans import base, evidence as plans, load
    queries = load()[0]
    texts = ["7 calls from 10.1.2.3 to 10.1.2.4, then 10.1.2.3", "guid 123e4567-e89b-12d3-a456-426614174000, i-0abc1234, fe80::1 and host-2 in 2024", "HOST-2 at 10.1.2.4", ""]
    docs = [(i, x) for i, x in enumerate(texts)] + [(9, None)]
    turns = [(1, 0, texts[0]), (1, 1, texts[2]), (1, 2, texts[1]), (2, 0, texts[2]), (2, 1, "10.0.2.7 again")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(1, "Customer#000000001", "BUILDING", 5.0), (2, "Customer#000000002", "BUILDING", 3000.0), (3, "Customer#000000003", "BUILDING", -1.0)],
                          "c_custkey bigint, c_name string, c_mktsegment string, c_acctbal double").write.parquet(f"{folder}/customer.parquet")
    known = {r["value"]: r["kind"] for r in plans._known(base.Tables(spark, folder)).collect()}
    tail = lambda n: f" Customer#{n:09d} Host-{n}, 10.0.{n % 9}.7 300.1.1.1"
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    want = {9: (None, 0)}
    for i, x in docs[:-1]:
        out, back = plain_redact([x + tail(i)], known)
        want[i] = (md5(out[0]), len(back))
    assert {r["doc_id"]: (r["digest"], r["markers"]) for r in queries["f19_redacted_whole_documents"](spark, folder).collect()} == want
    want = {}
    for c in (1, 2):
        own = [(k, x + tail(c * 10 + k)) for i, k, x in turns if i == c]
        out, back = plain_redact([x for _, x in own], known)
        want |= {(c, k): (md5(o), len(back)) for (k, _), o in zip(own, out)}
    assert {(r["conv_id"], r["turn"]): (r["digest"], r["markers"]) for r in queries["f19_redacted_whole_conversations"](spark, folder).collect()} == want


def test_evidence_windows_and_summary(spark):
    inc = spark.createDataFrame([("1", "A", "m", at(100), at(120)), ("2", "A", "m", at(100), None)], "anomaly_id string, asset_id string, metric string, start timestamp, end timestamp")
    w = {r["anomaly_id"]: r for r in evidence.windows(inc, F.lit(at(1000))).collect()}
    assert (w["1"]["metrics_from"], w["1"]["logs_from"], w["1"]["until"], w["1"]["during_to"]) == (at(40), at(90), at(130), at(120))
    assert (w["2"]["during_to"], w["2"]["until"]) == (at(280), at(290))
    pts = spark.createDataFrame([("A", "m", at(m), 0.0 if m < 100 else (100.0 if m == 105 else 10.0)) for m in range(0, 200)], "asset_id string, metric string, bucket timestamp, value double")
    s = evidence.summary(evidence.incident_points(evidence.windows(inc.where("anomaly_id = '1'"), F.lit(at(1000))), pts), ["anomaly_id"]).first()
    assert (s["before_median"], s["during_max"], s["change_abs"], s["change_rel"], s["points_before"], s["points_during"]) == (0.0, 100.0, 100.0, None, 60, 21)


def test_signal_catalogue(spark):
    sig = signals.catalogue(spark).collect()
    assert len(sig) == 14 and len({s["signal"] for s in sig}) == 14 and {f for s in sig for f in s["faults"]} >= {"cpu", "memoria", "disco", "caida", "latencia"}
    lvl = spark.createDataFrame([("A", "system_disk_io", at(0), {"device": d, "direction": "write"}, 1.0, 6.0) for d in ("sda", "sda1", "nvme0n1", "nvme0n1p1", "loop0")],
                                "asset_id string, metric string, bucket timestamp, dims map<string,string>, value_avg double, value_count double")
    assert {r["group_value"] for r in signals.watched(lvl, signals.catalogue(spark)).collect()} == {"sda", "nvme0n1"}


def test_under_use_verdicts(spark):
    use = []
    for a, cpu, mem, n in (("idle", 0.03, 0.20, 48), ("busy", 0.55, 0.70, 48), ("short", 0.03, 0.2, 5), ("free", 0.03, 0.2, 48), ("sin_resolver", 0.0, 0.0, 48)):
        use += [(a, k, T0 + timedelta(hours=h), v) for h in range(n) for k, v in (("cpu", cpu), ("memoria", mem))]
    use += [("peaks", "cpu", T0 + timedelta(hours=h), 0.85 if h == 3 else 0.02) for h in range(48)] + [("peaks", "memoria", T0 + timedelta(hours=h), 0.1) for h in range(48)]
    cost = spark.createDataFrame([(a, "p", 10) for a in ("idle", "busy", "short", "peaks")], "asset_id string, provider string, amount int").withColumn("amount", F.col("amount").cast("decimal(14,4)"))
    got = {r["asset_id"]: r for r in costs.under_used(cost, spark.createDataFrame(use, "asset_id string, kind string, bucket timestamp, busy double")).collect()}
    assert {k: v["under_used"] for k, v in got.items()} == {"idle": True, "busy": False, "short": None, "peaks": False, "free": None}
    assert got["idle"]["reason"] == "CPU promedio 3% y pico 3%, memoria promedio 20%, en 48 h medidas" and got["short"]["reason"].startswith("solo 5 h")


@pytest.fixture(scope="module")
def day(spark):
    rnd = random.Random(1)
    base = {"cpu_user": .2, "cpu_system": .1, "memoria_used": .3, "disco_used_frac": .4, "red_bytes_s": 1000., "tasa_llamadas_pedidos": 5., "tasa_llamadas_catalogo": 7.}
    fault = [("cpu_user", .9), ("memoria_used", .75), ("disco_used_frac", .8), ("tasa_llamadas_pedidos", 0.)]
    rows = []
    for i in range(1440 * 2):
        r = {k: v * (1 + rnd.gauss(0, .03)) for k, v in base.items()}
        if i > 360 and i % 180 < 12:
            k, v = fault[i // 180 % 4]
            r[k] = v
        rows.append(("A", at(i), *r.values()))
    return spark.createDataFrame(rows, "asset_id string, bucket timestamp, " + ", ".join(f"{k} double" for k in base))


def test_clustering_finds_every_fault_and_no_normal_run(spark, day):
    long = features.unpivoted(day, ["asset_id", "bucket"]).withColumn("value", features.squeezed(F.col("value"), F.col("feature")))
    floors = features.mad_floors(long, F.lit(T0), F.lit(at(1440)))
    z = features.wide_scores(features.rolling_scores(long, floors, chunk_rows=512)).persist()
    assert z.count() == 1440 * 2 - 119
    rows = ml.clipped(z)
    train, test = ml.between(rows, F.lit(T0), F.lit(at(1440))), ml.between(rows, F.lit(at(1440)), F.lit(at(2880)))
    model = ml.train_kmeans(train, restarts=3)
    marked = ml.anomalous(model, train, test)
    runs = features.state_runs(marked).collect()
    starts = [1440 + i for i in range(1440) if (1440 + i) % 180 == 0]
    hit = [s for s in starts if any(at(s) <= r["start"] <= at(s + 12) for r in runs)]
    assert hit == starts and len(runs) <= len(starts) + 1
    full = features.run_rows(spark.createDataFrame(runs, "asset_id string, start timestamp, end timestamp"), z, marked, "v").collect()
    kinds = {r["metric"]: r["direction"] for r in full}
    assert kinds["cpu_user"] == "sube" and kinds["tasa_llamadas_pedidos"] == "baja"
    names = ml.profile_names(model)
    assert "Operación normal" in names.values() and ml.windows_overlap((at(0), at(10)), (at(9), at(20))) and not ml.windows_overlap((at(0), at(9)), (at(9), at(20)))


def test_knn_equals_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, float(rnd.random() > .5), rnd.random(), rnd.random() * 50) for i in range(300)]
    df = spark.createDataFrame(pts, "id int, label double, a double, b double")
    train, rows = df.where("id < 220"), df.where("id >= 220")
    got = {r["id"]: r["prediction"] for r in ml.knn(train, rows, "id", "id", ["a", "b"], cells=7).collect()}
    import statistics as st
    tr = [p for p in pts if p[0] < 220]
    sa, sb = st.stdev(p[2] for p in tr), st.stdev(p[3] for p in tr)
    for p in pts[220:]:
        near = sorted(tr, key=lambda q: (((q[2] - p[2]) / sa) ** 2 + ((q[3] - p[3]) / sb) ** 2, q[1]))[:5]
        assert got[p[0]] == float(sum(q[1] for q in near) >= 3)


def test_assignment_is_the_nearest_centre(spark):
    df = spark.createDataFrame([(i, [float(i % 3) * 10, float(i % 3)]) for i in range(60)], "id int, v array<double>").withColumn("features", array_to_vector("v"))
    m = ml.train_kmeans(df, k=3, restarts=2)
    assert ml.assign(m, df).agg(F.max("distance")).first()[0] < 1e-6


def test_logs_without_ids_are_kept_and_match_nothing(spark):
    from tidegauge.operators import logs
    lg = spark.createDataFrame([(1, "t", "s"), (2, "", ""), (3, None, "s"), (4, "t", "x")], "i int, trace_id string, span_id string")
    sp = spark.createDataFrame([("t", "s", "op", 5, "ok"), ("", "", "ghost", 1, "ok")], "trace_id string, span_id string, name string, duration_ns bigint, status string")
    assert {r["i"]: r["operation"] for r in logs.correlated(lg, sp).collect()} == {1: "op", 2: None, 3: None, 4: None}


def test_span_tree_order_and_orphans(spark):
    from tidegauge.operators import logs
    rows = [("t", "r", "", 0), ("t", "b", "r", 5), ("t", "a", "r", 2), ("t", "c", "a", 3), ("t", "o", "gone", 1), ("u", "r", "", 0)]
    sp = spark.createDataFrame([(t, s, p, at(m)) for t, s, p, m in rows], "trace_id string, span_id string, parent_id string, start_ts timestamp")
    got = [(r["span_id"], r["level"]) for r in logs.span_tree(sp).where("trace_id = 't'").orderBy("path").collect()]
    assert got == [("r", 0), ("a", 1), ("c", 2), ("b", 1), ("o", 0)]
