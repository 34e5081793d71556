"""Streaming jobs over the event table, run to the end of what is there."""

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..schema import TAGS
from ..session import shared_folder
from ..sources import store as stores
from ..streaming import detect, ingest, rollup
from .base import HOUR, query, r, text

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark) -> str:
    """A new folder below the one all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _source(t):
    e = t.read("events")
    s = t.spark.readStream.schema(e.schema).parquet(f"{t.dir}/events.parquet*")
    u = F.col("user_id")
    return s.select(
        F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value", F.concat(F.lit("asset-"), (u % 10).cast("string")).alias("asset_id"),
        F.lit("h").alias("host_name"), F.lit("s").alias("service_name"), F.lit("aws").alias("cloud_provider"), F.lit("r1").alias("cloud_region"),
        F.lit("lab").alias("deployment_environment"), F.create_map(F.lit("slot"), F.lit("0")).alias("dims"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"))


def _drained(t, stream):
    """Write the stream to Parquet until the source is empty, and read it back."""
    root = scratch(t.spark)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("t01_streamed_summaries", """SELECT metric, asset_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, rnd(avg(value), 4) AS value_avg, max(value) AS value_max, count(*)::DOUBLE AS value_count FROM (SELECT *, date_trunc('hour', ts) AS b FROM points)
  WHERE b + INTERVAL 1 HOUR <= (SELECT max(ts) FROM points) - INTERVAL 30 SECOND GROUP BY metric, asset_id, b""", "points")
def _(t):
    d = _drained(t, rollup.minute_summaries(_source(t), HOUR))
    return d.select("metric", "asset_id", text("bucket"), r("value_avg"), "value_max", "value_count")


@query("t08_deduplicated_stream", "SELECT metric, count(*) AS n FROM points GROUP BY 1", "points")
def _(t):
    twice = _source(t).withColumn("_i", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_i")
    return _drained(t, rollup.deduplicated(twice).drop("dims")).groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


@query("t02_late_hours", "SELECT DISTINCT metric, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour FROM points WHERE floor(value) > 30", "points")
def _(t):
    b = t.points.withColumn("received_at", F.timestamp_micros(F.unix_micros("ts") + F.floor("value").cast("bigint") * 1000000))
    return rollup.late_hours(b).select("metric", text("hour"))


@query("t05_detection_cycle")
def _(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    pts = t.hourly.select(F.concat_ws("/", "asset_id", "metric").alias("series"), F.col("bucket").alias("ts"), "value")
    return detect.cycle(pts, floor=1.0, run=2, calm=3, step=HOUR).select("series", "event", text("ts"), r("z"), text("end"))


@query("t06_silent_sources", """SELECT host_name FROM (SELECT host_name, max(received_at) AS m FROM arrivals GROUP BY 1) WHERE TIMESTAMP '2024-01-30 12:00:00' - m > INTERVAL 5 MINUTE""", "arrivals")
def _(t):
    led = t.arrivals.groupBy("host_name").agg(F.max("received_at").alias("last_seen"))
    return detect.silent(led, F.to_timestamp(F.lit("2024-01-30 12:00:00"))).select("host_name")


# ---------------------------------------------------------------- the roll-up cycle and the merging store
# three batches: the rows of a batch lie far apart in time, so two of them are late; batch 1 sends rows of batch 0 again with another value; some
# rows of batch 0 have a clock that is far ahead
_SENT = """SELECT metric, asset_id, slot, ts, CASE WHEN event_id % 12 = 0 THEN value + 1 ELSE value END AS value FROM points
  UNION ALL SELECT metric, asset_id, slot, ts + INTERVAL 27000 DAY, value FROM points WHERE event_id % 60 = 3"""


def _sent(t):
    """(batch, points) in the order they arrive."""
    at = lambda c, s: F.timestamp_seconds(F.lit(1_710_000_000 + s)).alias(c)
    i = F.col("event_id")
    p = t.points.select("event_id", "metric", "ts", "time_ns", "value", *TAGS, "dims")
    part = lambda b: p.where(i % 3 == b).withColumn("received_at", at("received_at", b * 60))
    again = p.where(i % 12 == 0).withColumn("value", F.col("value") + 1).withColumn("received_at", at("received_at", 60))
    far = p.where(i % 60 == 3).withColumn("ts", F.col("ts") + F.expr("interval 27000 days")).withColumn("time_ns", F.unix_micros("ts") * 1000).withColumn("received_at", at("received_at", 0))
    for b, rows in enumerate((part(0).unionByName(far), part(1).unionByName(again), part(2))):
        yield b, rows.drop("event_id").withColumn("date", F.to_date("ts"))


def _rolled(t):
    """The levels, in partitions of a day, after a cycle over the first batch and one over the others, with a merge between them."""
    paths = ingest.Paths(scratch(t.spark))
    levels = replace(paths.levels, unit="day")
    for b, rows in _sent(t):
        stores.write_run(rows, paths.store, b)
        rollup.note_changes(rows, levels, b)
        if b != 1:
            rollup.cycle(t.spark, paths.store, levels)
        else:
            ingest.run_merge(t.spark, paths, 2)
    return levels


_LEVEL = """SELECT metric, asset_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, slot, rnd(avg(value), 4) AS value_avg, min(value) AS value_min, max(value) AS value_max, count(*)::DOUBLE AS value_count
  FROM (SELECT *, date_trunc('{}', ts) AS b FROM ({})) GROUP BY metric, asset_id, b, slot"""


def _level(d):
    return d.select("metric", "asset_id", text("bucket"), F.get_json_object("dims_key", "$.slot").alias("slot"), r("value_avg"), "value_min", "value_max", "value_count")


@query("t01_minutes_of_all_rows", _LEVEL.format("minute", _SENT), "points")
def _(t):
    return _level(rollup.read_level(t.spark, _rolled(t).minutes, unit="day"))


@query("t03_hours_of_all_rows", _LEVEL.format("hour", _SENT), "points")
def _(t):
    return _level(rollup.read_level(t.spark, _rolled(t).hours, unit="day"))


@query("s05_merged_store", f"SELECT metric, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, rnd(sum(value), 2) AS total FROM ({_SENT}) GROUP BY 1, 2", "points")
def _(t):
    """Two batches are merged, the third is folded in by the reader."""
    paths = ingest.Paths(scratch(t.spark))
    for b, rows in _sent(t):
        stores.write_run(rows, paths.store, b)
        if b == 1:
            stores.merge(t.spark, paths.store, 2)
    d = stores.read(t.spark, paths.store)
    return d.groupBy("metric", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), r(F.sum("value"), 2, "total"))


@query("t02_touched_keys", "SELECT DISTINCT metric, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute FROM points", "points")
def _(t):
    return rollup.touched(t.points).select("metric", text("minute"))
