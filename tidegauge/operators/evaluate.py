"""Scoring of anomalies against injected faults, and the ledger of those faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EOF_DATE, FAULT_TYPES

# ---- fixed values
MARGIN = "interval 5 minutes"
OUT_OF_SCOPE = ("latencia",)
# ---- end of fixed values
WIDTH = 86400


def overlap_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, how: str = "inner",
                 width: int = WIDTH) -> DataFrame:
    """Equi key plus ``start <= at <= end``.

    The time axis is cut in slices and an interval is copied to each slice it
    touches, so the join key is (key, slice): a hot key is spread over its
    slices, and points meet only the intervals of their own slice.
    """
    p = points.withColumn("_w", F.floor(F.unix_seconds(at) / width))
    i = intervals.withColumn("_w", F.explode(F.sequence(F.floor(F.unix_seconds(start) / width),
                                                        F.floor(F.unix_seconds(end) / width)))).withColumnRenamed(key, "_k")
    on = (p[key] == i["_k"]) & (p["_w"] == i["_w"]) & (p[at] >= i[start]) & (p[at] <= i[end])
    return p.join(i, on, how).drop("_w", "_k")


def attribute(anomalies: DataFrame, injections: DataFrame, width: int = WIDTH) -> DataFrame:
    """``anomaly_id, uid, type, inj_start, inj_state`` of the latest-started injection that covers the start."""
    inj = injections.select("asset_id", "uid", "type", F.col("state").alias("inj_state"), F.col("start").alias("inj_start"),
                            (F.coalesce("end", "start") + F.expr(MARGIN)).alias("inj_until"))
    hit = overlap_join(anomalies.select("anomaly_id", "asset_id", "start"), inj, "asset_id", "start", "inj_start", "inj_until",
                       width=width)
    best = F.max_by(F.struct("uid", "type", "inj_state", "inj_start"), F.struct("inj_start", "uid"))
    return hit.groupBy("anomaly_id").agg(best.alias("b")).select("anomaly_id", "b.*")


def evaluated(injections: DataFrame, start: Column, end: Column, with_latency: bool = False) -> DataFrame:
    """P20: adds ``counted`` (in the totals) and ``valid`` (completed, known asset, starts inside the window)."""
    valid = (F.col("state") == "completada") & F.col("asset_id").isNotNull() & (F.col("start") >= start) & (F.col("start") < end)
    scope = F.lit(True) if with_latency else ~F.col("type").isin(*OUT_OF_SCOPE)
    return injections.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn(
        "counted", F.coalesce(valid & scope, F.lit(False)))


def judged(anomalies: DataFrame, injections: DataFrame, start: Column, end: Column, version: str = "",
           with_latency: bool = False, width: int = WIDTH) -> DataFrame:
    """Every anomaly of the window with ``verdict`` correcta / falso_positivo / ignorada, its injection and the reason."""
    a = anomalies.where((F.col("start") >= start) & (F.col("start") < end))
    if version:
        a = a.where(F.startswith("model_version", F.lit(version)))
    inj = evaluated(injections, start, end, with_latency)
    good = attribute(a, inj.where("counted"), width).select("anomaly_id", F.col("uid").alias("_u"), F.col("inj_start").alias("_is"),
                                                     F.col("type").alias("_t"))
    rest = inj.where("not counted")
    other = attribute(a, rest, width).join(rest.select("uid", "valid"), "uid").select(
        "anomaly_id", F.when(F.col("valid"), F.concat("type", F.lit(", fuera del alcance")))
        .when(F.col("inj_state") != "completada", F.concat(F.lit("inyeccion "), "inj_state"))
        .otherwise("inyeccion fuera de la ventana").alias("_why"))
    j = a.join(good, "anomaly_id", "left").join(other, "anomaly_id", "left")
    verdict = F.when(F.col("_u").isNotNull(), "correcta").when(F.col("_why").isNotNull(), "ignorada").otherwise("falso_positivo")
    return j.select(*a.columns, verdict.alias("verdict"), F.col("_u").alias("uid"), F.col("_t").alias("inj_type"),
                    F.col("_is").alias("inj_start"), F.when(F.col("_u").isNull(), F.col("_why")).alias("reason"))


def per_injection(injections: DataFrame, verdicts: DataFrame, start: Column, end: Column, with_latency: bool = False) -> DataFrame:
    """Detected, number and ids of its anomalies, minutes to the first one."""
    hits = verdicts.where("verdict = 'correcta'").groupBy("uid").agg(
        F.count(F.lit(1)).alias("anomalies"), F.min("start").alias("first"),
        F.array_join(F.sort_array(F.collect_list("anomaly_id")), ",").alias("anomaly_ids"))
    inj = evaluated(injections, start, end, with_latency).where("counted")
    delay = (F.unix_micros("first") - F.unix_micros("start")) / 60000000
    return inj.join(hits, "uid", "left").select(
        "uid", "type", "asset_id", "start", F.col("first").isNotNull().alias("detected"),
        F.coalesce("anomalies", F.lit(0)).alias("anomalies"), "anomaly_ids", delay.alias("delay_min"))


def totals(injection_rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row. The delay counts from the earliest matched anomaly; the median is exact."""
    # both inputs in one aggregation: a row is an injection or a verdict. The delays are one value an injection of a campaign
    rows = injection_rows.select(F.col("detected").alias("_d"), F.col("delay_min").cast("double").alias("_m"), F.lit(None).cast("string").alias("_v")).unionByName(
        verdicts.where("verdict <> 'ignorada'").select(F.lit(None).cast("boolean").alias("_d"), F.lit(None).cast("double").alias("_m"), F.col("verdict").alias("_v")))
    j = rows.agg(F.count("_d").alias("injections"), F.count_if("_d").alias("detected"), F.count_if(F.col("_v") == "correcta").alias("correct"),
                 F.count_if(F.col("_v") == "falso_positivo").alias("false_positives"), F.avg("_m").alias("delay_mean"), F.percentile("_m", F.lit(0.5)).alias("delay_median"), F.max("_m").alias("delay_max"))
    p = F.coalesce(F.try_divide("correct", F.col("correct") + F.col("false_positives")), F.lit(0.0))
    r = F.coalesce(F.try_divide("detected", "injections"), F.lit(0.0))
    return j.select("injections", "detected", "correct", "false_positives", p.alias("precision"), r.alias("recall"),
                    F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "delay_mean", "delay_median", "delay_max")


def by_type(injection_rows: DataFrame) -> DataFrame:
    """A27 per fault type: a false positive has no type, so recall and delays only."""
    g = injection_rows.groupBy("type").agg(
        F.count(F.lit(1)).alias("injections"), F.count_if("detected").alias("detected"), F.sum("anomalies").alias("correct"),
        F.avg("delay_min").alias("delay_mean"), F.max("delay_min").alias("delay_max"))
    return g.withColumn("recall", F.col("detected") / F.col("injections"))


def false_positives(verdicts: DataFrame, keys: list[str], days: float) -> DataFrame:
    """A28."""
    return verdicts.where("verdict = 'falso_positivo'").groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).withColumn(
        "per_day", F.col("total") / F.lit(days))


def operator_marks(verdicts: DataFrame) -> DataFrame:
    """A29."""
    v = verdicts.where("verdict <> 'ignorada'")
    marked, hit = F.col("state") == "falso_positivo", F.col("verdict") == "correcta"
    return v.agg(F.count_if(marked).alias("marked"), F.count_if(marked & ~hit).alias("right"),
                 F.count_if(marked & hit).alias("wrong"), F.count_if(~marked & ~hit).alias("unmarked"))


def fingerprint(ids: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """12 hex digits of the sha-256 of the sorted ids, one per line.

    The digest is of one text, so the ids of a group do meet in one place: it
    is meant for the injections of a campaign (tens of ids per group).
    """
    return ids.groupBy(*keys).agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(col)), "\n"), 256), 1, 12)
                                  .alias("fingerprint"), F.count(F.lit(1)).alias("ids"))


def overlapping(injections: DataFrame, start: Column, end: Column) -> DataFrame:
    """An open end reaches to infinity."""
    return injections.where((F.col("start") < end) & (F.coalesce("end", F.to_timestamp(F.lit(EOF_DATE))) >= start))


def from_labels(rows: DataFrame, uid: str, kind: str, ts: str, value: str) -> DataFrame:
    """One row per labelled fault: type, start, end, peak, minutes, and how many hours it touches."""
    g = rows.where(F.col(uid).isNotNull()).groupBy(uid, kind).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.max(value).alias("peak"),
        F.count_distinct(F.date_trunc("hour", ts)).alias("hours"))
    return g.withColumn("minutes", (F.unix_micros("end") - F.unix_micros("start")) / 60000000)


# ---------------------------------------------------------------- the fault ledger
def pair_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Start and end events to one row per uid; ``(rows, rejected)``.

    ``events``: uid, event (inicio / fin), seq, asset_id, type, node, start_text, end_text, end_state, intensity,
    params map, reason, closing. The last event of each kind wins; an end
    without its start waits for it. Bad types, end states and times without a
    zone are rejected as a whole.
    """
    from ..functions.times import parse_instant
    body = [c for c in events.columns if c not in ("uid", "event", "seq")]
    pick = lambda kind: F.max_by(F.when(F.col("event") == kind, F.struct(*body)), F.when(F.col("event") == kind, F.col("seq")))
    g = events.groupBy("uid").agg(pick("inicio").alias("i"), pick("fin").alias("f")).where("i is not null")
    ended = F.col("f").isNotNull()
    start, end = parse_instant(F.col("i.start_text"), True), parse_instant(F.col("f.end_text"), True)
    ok = (F.col("i.type").isin(*FAULT_TYPES) & F.col("i.node").isNotNull() & start.isNotNull()
          & (~ended | (F.col("f.end_state").isin("completada", "fallida") & end.isNotNull())))
    extra = F.map_filter(F.map_from_arrays(F.array(F.lit("motivo"), F.lit("cierre")), F.array("f.reason", "f.closing")),
                         lambda k, v: v.isNotNull() & (v != ""))
    params = F.coalesce("i.params", F.create_map().cast("map<string,string>"))
    base = F.map_filter(params, lambda k, v: ~F.array_contains(F.map_keys(extra), k))
    rows = g.select(
        "uid", F.coalesce(ok, F.lit(False)).alias("_ok"), F.col("i.type").alias("type"), F.col("i.node").alias("node"),
        F.col("i.asset_id").alias("asset_id"), start.alias("start"), F.when(ended, end).alias("end"),
        F.coalesce("i.intensity", F.lit("")).alias("intensity"),
        F.when(ended, F.map_concat(base, extra)).otherwise(params).alias("params"),
        F.when(ended, F.col("f.end_state")).otherwise("en_curso").alias("state"))
    return rows.where("_ok").drop("_ok"), rows.where("not _ok").select("uid", "type")


def merge_injections(state: DataFrame, rows: DataFrame) -> DataFrame:
    """U4: upsert by uid with ``changed``. Known asset and end stay, parameters merge (new wins), a final state never
    goes back to running, an equal row is not rewritten."""
    old = state.select("uid", F.struct(*[c for c in state.columns if c != "uid"]).alias("o"))
    new = rows.select("uid", F.struct(*[c for c in state.columns if c != "uid"]).alias("n"))
    j = old.join(new, "uid", "full")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    first, gone = F.col("o").isNull(), F.col("n").isNull()
    merged_params = F.map_concat(F.map_filter(o("params"), lambda k, v: ~F.array_contains(F.map_keys(n("params")), k)), n("params"))
    same_params = F.sort_array(F.map_entries(merged_params)) == F.sort_array(F.map_entries(o("params")))
    new_state = F.when((o("state") != "en_curso") & (n("state") == "en_curso"), o("state")).otherwise(n("state"))
    merged = {"asset_id": F.coalesce(n("asset_id"), o("asset_id")), "end": F.coalesce(n("end"), o("end")),
              "params": merged_params, "state": new_state}
    changed = ~(merged["asset_id"].eqNullSafe(o("asset_id")) & merged["end"].eqNullSafe(o("end")) & same_params
                & n("state").eqNullSafe(o("state")))
    col = lambda c: F.when(first, n(c)).when(gone, o(c)).otherwise(merged.get(c, o(c))).alias(c)
    return j.select("uid", *[col(c) for c in state.columns if c != "uid"],
                    F.when(first, True).when(gone, False).otherwise(changed).alias("changed"))


def fill_assets(injections: DataFrame, keys: DataFrame) -> DataFrame:
    """An injection of a node the catalogue did not know yet takes its asset later."""
    k = keys.select(F.col("key").alias("node"), F.col("asset_id").alias("_a"))
    return injections.join(k, "node", "left").withColumn("asset_id", F.coalesce("asset_id", "_a")).drop("_a").select(*injections.columns)
