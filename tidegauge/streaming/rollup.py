"""Minute and hour summaries: a stream for the first view, and a cycle over change sets that loses no row.

Every batch notes the (metric, minute) keys it touched. A cycle recomputes the touched hours from the stored rows, minutes
first, hours from minutes, and notes for each level how far it came. A row counts whenever it comes, however late or far ahead
its time is; the clock only decides up to where a level is published.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import bucket
from ..operators import rollup
from ..operators.rollup import SERIES
from ..session import cut_lineage
from ..sources import store as stores
from ..sources import versions

# ---- fixed values
FINAL_AFTER = "30 seconds"
#: What the stream no longer takes is redone from the raw rows: the two limits are one, so no row falls between them.
LATE_AFTER = f"interval {FINAL_AFTER}"
#: An hour is published when its last minute is that old.
HOUR_AFTER = "interval 2 minutes"
# ---- end of fixed values


def minute_summaries(points: DataFrame, seconds: int = 60, delay: str = FINAL_AFTER) -> DataFrame:
    """Append mode; a minute comes out once, ``delay`` after it ends. Rows behind the watermark are not in it: the watermark
    follows the newest time of any sender, so a point far ahead makes all others late. :func:`cycle` counts them all."""
    p = rollup.with_series(points).withWatermark("ts", delay)
    return p.groupBy(*SERIES, F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.avg("value").alias("value_avg"), F.min("value").alias("value_min"), F.max("value").alias("value_max"),
        F.count("value").cast("double").alias("value_count")).select(*SERIES, F.col("w.start").alias("bucket"),
                                                                     "value_avg", "value_min", "value_max", "value_count")


def deduplicated(points: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """At-least-once input; a repeat inside the watermark is dropped, an older one is harmless downstream."""
    p = rollup.with_series(points).withWatermark("ts", delay)
    return p.dropDuplicatesWithinWatermark([*SERIES, "time_ns"])


def late_hours(batch: DataFrame) -> DataFrame:
    """(metric, hour) pairs that hold a row which came too late for the stream."""
    late = batch.where(F.col("received_at") - F.col("ts") > F.expr(LATE_AFTER))
    return late.select("metric", bucket(F.col("ts"), 3600).alias("hour")).distinct()


#: Partitions of a level whose unit of replacement is an hour or a day.
UNITS = {"hour": ["metric", "date", "hour"], "day": ["metric", "date"]}


def write_level(level: DataFrame, path: str, unit: str = "hour") -> None:
    """T4: partitions (metric, date, hour) are replaced as a whole, so a repeat changes nothing; (metric, date) where the unit is a day."""
    by, placed = UNITS[unit], level.withColumn("date", F.to_date("bucket"))
    placed = placed.withColumn("hour", F.hour("bucket")) if "hour" in by else placed
    (placed.hint("rebalance", *by).sortWithinPartitions("asset_id", "bucket")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def redo(spark: SparkSession, hours: DataFrame, raw: DataFrame, minute_path: str, hour_path: str, minute: int = 60, hour: int = 3600) -> None:
    """T2 + T4: recompute the listed (metric, hour) pairs from the raw rows, minutes and then hours.

    The list is a set of pairs, a few rows next to the points; the semi join
    prunes the partitions it does not name.
    """
    want = hours.select("metric", F.to_date("hour").alias("date"), F.col("hour").alias("_h")).distinct()
    rows = raw.withColumn("_h", bucket(F.col("ts"), 3600)).join(want, ["metric", "date", "_h"], "left_semi")
    minutes = rollup.summarise(rows, minute)
    write_level(minutes, minute_path)
    again = rollup.summarise_again(minutes, hour)
    write_level(again, hour_path)


def backfill(spark: SparkSession, raw_path: str, schema, checkpoint: str, handle, files_per_trigger: int = 1000):
    """T3 + T9: everything that is there now, in capped slices, resumed from the checkpoint."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(raw_path)
    return src.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- change sets
CHANGES = "metric string, minute timestamp, batch bigint"
#: ``metric`` null: how far the level came (batches, moves, and the time up to which it is published). Else an hour that it still has to do.
PROGRESS = "level string, upto bigint, moves bigint, published timestamp, metric string, hour timestamp"
LEVEL = ("asset_id string, host_name string, service_name string, cloud_provider string, cloud_region string, deployment_environment string, dims_key string, "
         "bucket timestamp, value_avg double, value_min double, value_max double, value_count double, metric string, date date")


@dataclass
class Levels:
    """Folders of the roll-up: change sets of the batches, progress, minute and hour summaries.

    ``unit`` is what a touched key makes new, and the partition of both levels: an hour for live data, where only the newest
    ones are touched; a day where rows come late or in bulk and files of an hour would be many and small.
    """
    changes: str
    progress: str
    minutes: str
    hours: str
    unit: str = "hour"


def touched(points: DataFrame) -> DataFrame:
    """The keys a batch touches; a set, so it is small next to the batch."""
    return points.select("metric", F.date_trunc("minute", "ts").alias("minute")).distinct()


def note_changes(points: DataFrame, levels: Levels, batch: int) -> None:
    """Written after the batch's points; writing it again replaces it."""
    touched(points).write.mode("overwrite").parquet(f"{levels.changes}/batch={batch}")


def progress(spark: SparkSession, levels: Levels) -> dict[str, tuple]:
    """(last batch, last move, published up to) of each level."""
    rows = versions.latest(spark, levels.progress, PROGRESS).where("metric is null").collect()
    return {"1m": (-1, -1, None), "1h": (-1, -1, None)} | {r["level"]: (r["upto"], r["moves"], r["published"]) for r in rows}


def _waiting(spark: SparkSession, levels: Levels, level: str) -> DataFrame:
    return versions.latest(spark, levels.progress, PROGRESS).where((F.col("level") == level) & F.col("metric").isNotNull()).select("metric", "hour")


def _note(spark: SparkSession, levels: Levels, done: dict[str, tuple], waiting: dict[str, DataFrame]) -> None:
    rows = spark.createDataFrame([(k, *v, None, None) for k, v in done.items()], PROGRESS)
    for level, hours in waiting.items():
        none = [F.lit(None).cast(t).alias(n) for n, t in (("upto", "bigint"), ("moves", "bigint"), ("published", "timestamp"))]
        rows = rows.unionByName(hours.select(F.lit(level).alias("level"), *none, "metric", "hour"))
    versions.publish(cut_lineage(rows), levels.progress, versions.next_version(spark, levels.progress))


def read_level(spark: SparkSession, path: str, units: DataFrame | None = None, unit: str = "hour") -> DataFrame:
    """A summary level, or only the partitions of some (metric, hour) pairs, ``hour`` being the start of the unit."""
    by = UNITS[unit]
    df = spark.read.schema(LEVEL + (", hour int" if "hour" in by else "")).parquet(path)
    if units is None:
        return df
    want = units.select("metric", F.to_date("hour").alias("date"), F.hour("hour").alias("hour")).select(*by).distinct()
    return stores.only(df, want).join(want, by, "left_semi")


def cycle(spark: SparkSession, store: stores.PointStore, levels: Levels, as_of: Column | None = None, most: int | None = None,
          minute: int = 60, hour: int = 3600) -> DataFrame:
    """One pass over what batches and moves have touched; returns the (metric, hour) pairs whose minutes it redid.

    Minutes of a touched hour (or day, see ``Levels.unit``) are computed anew from the stored rows and replace the partition (metric, date, hour); the
    scan is cut to the (metric, date) partitions of the pass. The hour level waits until its hour can be published, so it is
    written once if nothing comes late; without ``as_of`` it doesn't wait. With ``most`` a pass does the oldest ``most`` pairs and leaves
    the others to the next one. A pass that dies is repeated: progress is noted after the writes, which replace.
    """
    done = progress(spark, levels)
    batches = {n: p for n, p in versions.committed(spark, levels.changes, "batch").items() if n > done["1m"][0]}
    queue = _waiting(spark, levels, "1m")
    if batches:
        new = spark.read.schema(CHANGES).option("basePath", levels.changes).parquet(*batches.values())
        queue = queue.unionByName(new.select("metric", F.date_trunc(levels.unit, "minute").alias("hour")))
    moved = stores.moved_hours(spark, store, done["1m"][1])
    last_move = moved.agg(F.max("v")).first()[0]
    queue = cut_lineage(queue.unionByName(moved.select("metric", F.date_trunc(levels.unit, "hour").alias("hour"))).distinct())
    now, later = queue, queue.limit(0)
    if most is not None:
        now = cut_lineage(queue.orderBy("hour", "metric").limit(most))
        later = queue.join(now, ["metric", "hour"], "left_anti")
    if not now.isEmpty():
        rows = stores.read(spark, store, now.select("metric", F.to_date("hour").alias("date")))
        rows = rows.withColumn("_h", F.date_trunc(levels.unit, "ts")).join(now.withColumnRenamed("hour", "_h"), ["metric", "_h"], "left_semi")
        write_level(rollup.summarise(rows, minute), levels.minutes, levels.unit)
    until = {"1m": done["1m"][2], "1h": done["1h"][2]}
    if as_of is not None:
        clock = spark.range(1).select(F.date_trunc("minute", as_of - F.expr(LATE_AFTER)).alias("m")).select("m", F.date_trunc("hour", F.col("m") - F.expr(HOUR_AFTER)).alias("h")).first()
        until = {"1m": clock["m"], "1h": clock["h"]}
    done = {"1m": (max([done["1m"][0], *batches]), done["1m"][1] if last_move is None else last_move, until["1m"]), "1h": done["1h"]}
    due = cut_lineage(_waiting(spark, levels, "1h").unionByName(now).distinct())
    _note(spark, levels, done, {"1m": later, "1h": due})
    ready = due if as_of is None else due.where(F.col("hour") + F.expr(f"interval 1 {levels.unit}") <= F.lit(until["1h"]))
    if not ready.isEmpty():
        write_level(rollup.summarise_again(read_level(spark, levels.minutes, ready, levels.unit), hour), levels.hours, levels.unit)
    rest = due.limit(0) if as_of is None else due.join(ready, ["metric", "hour"], "left_anti")
    done["1h"] = (done["1m"][0], done["1m"][1], until["1h"])
    _note(spark, levels, done, {"1m": later, "1h": rest})
    for number, path in versions.committed(spark, levels.changes, "batch").items():
        if number <= done["1m"][0]:
            versions.drop(spark, path)
    return now


def published(spark: SparkSession, levels: Levels, level: str) -> DataFrame:
    """The buckets of a level that are final by the clock; what comes later still changes them."""
    path, width = (levels.minutes, "1 minute") if level == "1m" else (levels.hours, "1 hour")
    until = progress(spark, levels)[level][2]
    df = read_level(spark, path, unit=levels.unit)
    return df if until is None else df.where(F.col("bucket") + F.expr(f"interval {width}") <= F.lit(until))
