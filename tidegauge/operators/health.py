"""Source and orphan ledgers, source state, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import UNRESOLVED

# ---- fixed values
SILENT_AFTER = "interval 5 minutes"
HEARTBEAT = "metricas"
# ---- end of fixed values


def state_of(last: Column, as_of: Column) -> Column:
    """Exactly five minutes is still fine."""
    return F.when(last.isNull(), "sin_datos").when(as_of - last > F.expr(SILENT_AFTER), "degradado").otherwise("ok")


def source_deltas(arrivals: DataFrame) -> DataFrame:
    """Per (asset, host, signal), by ARRIVAL time; ``last_seen`` moves only with received rows.

    ``arrivals``: asset_id, host_name, signal, provider, received_at, received, errors.
    """
    got = F.when(F.col("received") > 0, F.col("received_at"))
    return arrivals.groupBy("asset_id", "host_name", "signal").agg(
        F.max_by("provider", F.when(F.col("provider").isNotNull(), F.col("received_at"))).alias("provider"),
        F.min("received_at").alias("first_seen"), F.max(got).alias("last_seen"),
        F.sum("received").alias("received"), F.sum("errors").alias("errors"))


def merge_sources(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Counters add, the latest time and the newest known provider stay."""
    keys = ["asset_id", "host_name", "signal"]
    u = state.withColumn("_v", F.lit(0)).unionByName(delta.withColumn("_v", F.lit(1)))
    return u.groupBy(*keys).agg(
        F.max_by("provider", F.when(F.col("provider").isNotNull(), F.col("_v"))).alias("provider"),
        F.min_by("first_seen", "_v").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("received").alias("received"), F.sum("errors").alias("errors")).select(*state.columns)


def orphan_deltas(arrivals: DataFrame) -> DataFrame:
    """``arrivals``: key, key_type, provider, signal (metricas / registros / trazas), received_at, n."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("signal") == s, F.col("n"))), F.lit(0))
    return arrivals.groupBy("key").agg(
        F.max_by("key_type", "received_at").alias("key_type"),
        F.max_by("provider", F.when(F.col("provider").isNotNull(), F.col("received_at"))).alias("provider"),
        n("metricas").alias("metrics"), n("registros").alias("logs"), n("trazas").alias("traces"),
        F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"),
        F.lit(None).cast("string").alias("associated_to"), F.lit(None).cast("timestamp").alias("associated_at"))


def merge_orphans(state: DataFrame, delta: DataFrame) -> DataFrame:
    """As the sources; an associated orphan that arrives again is pending again."""
    u = state.withColumn("_v", F.lit(0)).unionByName(delta.withColumn("_v", F.lit(1)))
    return u.groupBy("key").agg(
        F.min_by("key_type", "_v").alias("key_type"),
        F.max_by("provider", F.when(F.col("provider").isNotNull(), F.col("_v"))).alias("provider"),
        F.sum("metrics").alias("metrics"), F.sum("logs").alias("logs"), F.sum("traces").alias("traces"),
        F.min_by("first_seen", "_v").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max_by("associated_to", "_v").alias("associated_to"), F.max_by("associated_at", "_v").alias("associated_at")).select(*state.columns)


def volume(internal: DataFrame, as_of: Column) -> DataFrame:
    """Received in 5 minutes and errors in 1 hour per source; ``internal``: asset_id, host_name, signal, kind, ts, value."""
    since = lambda i: F.col("ts") >= as_of - F.expr(i)
    return internal.where(since("interval 1 hour")).groupBy("asset_id", "host_name", "signal").agg(
        F.coalesce(F.sum(F.when((F.col("kind") == "recibidas") & since("interval 5 minutes"), F.col("value"))), F.lit(0)).cast("bigint").alias("received_5min"),
        F.coalesce(F.sum(F.when(F.col("kind") == "errores", F.col("value"))), F.lit(0)).cast("bigint").alias("errors_1h"))


def sources(ledger: DataFrame, vol: DataFrame, as_of: Column) -> DataFrame:
    """One row per (asset, host) with its signals; the heartbeat signal decides, else the newest one."""
    keys = ["asset_id", "host_name"]
    j = ledger.join(vol, [*keys, "signal"], "left").fillna(0, ["received_5min", "errors_1h"])
    sig = F.struct("last_seen", state_of(F.col("last_seen"), as_of).alias("state"), "received", "errors", "received_5min", "errors_1h")
    beat = F.struct((F.col("signal") == HEARTBEAT).cast("int").alias("b"), F.col("last_seen"))
    g = j.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("signal", sig)))).alias("signals"),
        F.max_by("last_seen", beat).alias("last_seen"), F.max("provider").alias("provider"),
        F.sum("received_5min").alias("received_5min"), F.sum("errors_1h").alias("errors_1h"))
    return g.select(*keys, "provider", (F.col("asset_id") == UNRESOLVED).alias("orphan"), "signals", "last_seen",
                    state_of(F.col("last_seen"), as_of).alias("state"),
                    F.bround((F.unix_micros(as_of) - F.unix_micros("last_seen")) / 60000000, 1).alias("silent_min"),
                    "received_5min", "errors_1h")


def state_rank(c: Column) -> Column:
    return F.when(c == "degradado", 0).when(c == "sin_datos", 1).otherwise(2)


def source_list(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """J10 + K4: assets that never reported come as ``sin_datos``; worst state first."""
    never = assets.where("state <> 'retirado'").select("asset_id").join(rows.select("asset_id").distinct(), "asset_id", "left_anti").select(
        "asset_id", F.lit("sin_datos").alias("state"))
    u = rows.unionByName(never, allowMissingColumns=True)
    return u.orderBy(state_rank(F.col("state")), "asset_id", "host_name")


def last_reception(ledger: DataFrame) -> DataFrame:
    """Metrics first, any other signal where there are none."""
    return ledger.groupBy("asset_id").agg(F.coalesce(
        F.max(F.when(F.col("signal") == HEARTBEAT, F.col("last_seen"))), F.max("last_seen")).alias("last_seen"))


def open_incidents(anomalies: DataFrame, terminal) -> DataFrame:
    """A18."""
    return anomalies.where(F.col("end").isNull() & ~F.col("state").isin(*terminal)).groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("open_incidents"))


def inventory(assets: DataFrame, ledger: DataFrame, incidents: DataFrame, cpu: DataFrame, as_of: Column) -> DataFrame:
    """Derived state: retired, no data, degraded, attention, ok."""
    j = assets.join(last_reception(ledger), "asset_id", "left").join(incidents, "asset_id", "left").join(cpu, "asset_id", "left")
    s = state_of(F.col("last_seen"), as_of)
    derived = (F.when(F.col("state") == "retirado", "retirado").when(s != "ok", s)
               .when(F.coalesce("open_incidents", F.lit(0)) > 0, "atencion").otherwise("ok"))
    return j.withColumn("health", derived).withColumn("open_incidents", F.coalesce("open_incidents", F.lit(0)))


def visible(rows: DataFrame, *, text: str | None = None, search_in=("asset_id",), **equals) -> DataFrame:
    """Optional equality filters and a case-blind text over some columns."""
    for col, v in equals.items():
        if v is not None:
            rows = rows.where(F.col(col) == v)
    if text:
        hit = F.lit(False)
        for c in search_in:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
        rows = rows.where(hit)
    return rows


def header_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by ``a`` and by ``(b, a)`` in one pass."""
    return rows.groupingSets([[a], [b, a]], a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(b).alias("all_rows"))
