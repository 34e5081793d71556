"""The watched signals, as a table that is joined to the points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import signal_key

# ---- fixed values: metric, class, fixed dimension, group dimension, scale floor, faults it shows, skipped values
PARTITION = r"[a-z]+\d+|.*\dp\d+"
FRACTION_FLOOR = 0.01
SIGNALS = [
    ("system_cpu_utilization", "medida", {"state": "user"}, None, FRACTION_FLOOR, ["cpu"], {}),
    ("system_cpu_utilization", "medida", {"state": "system"}, None, FRACTION_FLOOR, ["cpu"], {}),
    ("system_cpu_utilization", "medida", {"state": "wait"}, None, FRACTION_FLOOR, ["disco"], {}),
    ("system_cpu_load_average_1m", "medida", {}, None, 0.0, ["cpu"], {}),
    ("system_memory_utilization", "medida", {"state": "used"}, None, FRACTION_FLOOR, ["memoria"], {}),
    ("system_paging_usage", "medida", {"state": "used"}, "device", 0.0, ["memoria"], {}),
    ("system_filesystem_usage", "medida", {"state": "used"}, "mountpoint", 0.0, ["disco"], {}),
    ("system_disk_io", "acumulada", {"direction": "write"}, "device", 0.0, ["disco"], {"device": PARTITION}),
    ("system_disk_io", "acumulada", {"direction": "read"}, "device", 0.0, ["disco"], {"device": PARTITION}),
    ("system_paging_operations", "acumulada", {"direction": "page_in"}, "type", 0.0, ["memoria"], {}),
    ("system_network_io", "acumulada", {"direction": "transmit"}, "device", 0.0, [], {}),
    ("system_network_io", "acumulada", {"direction": "receive"}, "device", 0.0, [], {}),
    ("system_processes_count", "medida", {"status": "running"}, None, 0.0, ["cpu"], {}),
    ("traces_span_metrics_calls", "acumulada", {}, "status_code", 0.0, ["caida", "latencia"], {}),
]
# ---- end of fixed values
NUMBERS = 1 << 31  # above any number of a catalogue's row

_map = T.MapType(T.StringType(), T.StringType())
SCHEMA = T.StructType([
    T.StructField("metric", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("filters", _map),
    T.StructField("group_dim", T.StringType()), T.StructField("floor", T.DoubleType()),
    T.StructField("faults", T.ArrayType(T.StringType())), T.StructField("exclude", _map)])


def catalogue(spark: SparkSession, rows: list | None = None) -> DataFrame:
    df = spark.createDataFrame(rows if rows is not None else SIGNALS, SCHEMA)
    return df.withColumn("signal", signal_key(F.col("metric"), F.col("filters"), F.col("group_dim")))


def matches(filters, dims):
    """All fixed dimensions of the signal hold for the row."""
    return F.forall(F.map_entries(filters), lambda e: F.coalesce(F.try_element_at(dims, e["key"]) == e["value"], F.lit(False)))


def excluded(exclude, dims):
    """Whole-value match of a skipped dimension (disk partitions), P14."""
    def bad(e):
        v = F.try_element_at(dims, e["key"])
        return F.coalesce(F.regexp_like(v, F.concat(F.lit("^(?:"), e["value"], F.lit(")$"))), F.lit(False))
    return F.exists(F.map_entries(exclude), bad)


def watched(level: DataFrame, signals: DataFrame, value=None) -> DataFrame:
    """One row per (asset, signal, group value, bucket): the points every signal reads.

    ``level`` is the minute summary with ``dims``. The signal table is joined as
    it comes: the planner broadcasts it if its size allows.
    """
    s = signals.withColumnRenamed("metric", "_m")
    j = level.join(s, F.col("metric") == F.col("_m")).where(
        matches(F.col("filters"), F.col("dims")) & ~excluded(F.col("exclude"), F.col("dims")))
    grp = F.when(F.col("group_dim").isNotNull(), F.try_element_at("dims", "group_dim"))
    mean = F.sum(F.col("value_avg") * F.col("value_count")) / F.sum("value_count")
    return j.groupBy("asset_id", "metric", "signal", "kind", "floor", grp.alias("group_value"), "group_dim",
                     F.to_json("filters").alias("filters_text"), "bucket").agg(mean.alias("value"))


def _numbered(signals: DataFrame) -> DataFrame:
    """The catalogue (tens of rows) with a number for each row."""
    key = lambda x: F.concat_ws("|", x["signal"], x["kind"], F.to_json(x["filters"]))
    rows = F.array_sort(F.collect_list(F.struct("metric", "signal", "kind", "filters", "faults")), lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0))
    return signals.agg(rows.alias("_a")).select(F.posexplode("_a").alias("_i", "_s")).select("_i", "_s.*")


def _own_numbers(numbered: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask_id, _i): the number of the own signal. An ask meets the signals of its metric as one list; what is aggregated is one
    long: the size of the greatest match and, on a tie, the lower number."""
    lists = numbered.groupBy(F.col("metric").alias("_m")).agg(F.collect_list(F.struct("filters", "_i")).alias("_l"))
    hits = F.filter("_l", lambda x: matches(x["filters"], F.col("dims")))
    best = F.array_max(F.transform(hits, lambda x: F.size(x["filters"]).cast("bigint") * NUMBERS - x["_i"]))
    met = asked.join(lists, F.col("metric") == F.col("_m")).select("ask_id", best.alias("_b"))
    return met.groupBy("ask_id").agg(F.max("_b").alias("_b")).where("_b is not null").select("ask_id", F.pmod(-F.col("_b"), F.lit(NUMBERS)).cast("int").alias("_i"))


def own_signals(signals: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask_id, own): of the signals that a (metric, dims) belongs to, the one with the most fixed dimensions."""
    s = _numbered(signals)
    own = s.select("_i", F.struct("metric", "signal", "kind", "filters", "faults").alias("own"))
    return _own_numbers(s, asked).join(own, "_i").select("ask_id", "own")


def related(signals: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (metric, dims): its own signal (most fixed dimensions), and those sharing a fault.

    ``asked`` has ``ask_id, metric, dims``. Which signals go together is found in the catalogue alone, so an ask meets
    its own signal and then the short list that belongs to it, each of them once.
    """
    s = _numbered(signals)
    own = s.select("_i", F.col("metric").alias("_m"), F.col("signal").alias("own_signal"), F.to_json("filters").alias("_f"), F.explode("faults").alias("fault"))
    other = s.select(F.col("metric").alias("rel_metric"), F.col("signal").alias("rel_signal"), F.to_json("filters").alias("rel_filters"), F.explode("faults").alias("fault"))
    pairs = own.join(other, "fault").where((F.col("rel_signal") != F.col("own_signal")) & ~((F.col("_m") == F.col("rel_metric")) & (F.col("rel_filters") == F.col("_f")))).select(
        "_i", "own_signal", "rel_metric", "rel_signal").distinct()
    return _own_numbers(s, asked).join(pairs, "_i").select("ask_id", "own_signal", "rel_metric", "rel_signal")
