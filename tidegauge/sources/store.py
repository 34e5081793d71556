"""The point store: every batch is a run, a job merges runs, a manifest says what is merged.

Runs (``batch=<n>``) and merged folders (``v=<k>``) are partitioned by (metric, date) and sorted by series inside. Version k of
the manifest names, for each (metric, date), the merged folder and the last batch in it. Readers take merged rows of partitions without
newer runs as they are, and fold only where a newer run exists. A merge writes a new folder and swaps the manifest. What none of
the last three manifests needs is dropped after the swap, so a reader that has listed its files can finish while one swap happens, and
the number of files stays bounded however many batches there were.

A batch that is repeated after it was merged is ignored, as its number is not newer than the manifest's. A merge that dies
before the swap leaves a folder that no manifest names; the next one writes it anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import METRIC_POINTS
from ..session import cut_lineage
from . import sinks, versions

#: Rows without an hour are partitions; rows with one are hours that a move touched in version ``v``, until they are rolled up.
MANIFEST = "metric string, date date, v bigint, upto bigint, hour timestamp"
PART = ["metric", "date"]


@dataclass
class PointStore:
    """Folders of one store; ``runs`` is where batches write."""
    runs: str
    merged: str
    manifest: str


def write_run(points: DataFrame, store: PointStore, batch: int) -> None:
    """The run of one batch; writing it again replaces it."""
    sinks.write_points(points, f"{store.runs}/batch={batch}", "overwrite")


def _rows(spark: SparkSession, root: str, key: str) -> DataFrame:
    """All committed rows below ``root`` with the number of their folder."""
    schema = T.StructType([*METRIC_POINTS.fields, T.StructField(key, T.LongType())])
    folders = versions.committed(spark, root, key)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*folders.values())


def head(spark: SparkSession, store: PointStore, back: int = 0) -> DataFrame:
    return versions.latest(spark, store.manifest, MANIFEST, back).where("hour is null").drop("hour")


def moved_hours(spark: SparkSession, store: PointStore, after: int) -> DataFrame:
    """(metric, hour, v) that moves have touched in versions after ``after``."""
    return versions.latest(spark, store.manifest, MANIFEST).where(F.col("hour").isNotNull() & (F.col("v") > after)).select("metric", "hour", "v")


def only(df: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of some (metric, date) partitions. Their names, not their rows, come to the driver and become filters that
    prune the scan; the join makes the pairs exact."""
    named = parts.select(*PART).distinct().collect()
    near = F.col("metric").isin(sorted({r["metric"] for r in named})) & F.col("date").isin(sorted({r["date"] for r in named}))
    return df.where(near).join(parts.select(*PART).distinct(), PART, "left_semi")


def _unmerged(spark: SparkSession, store: PointStore) -> DataFrame:
    runs, known = _rows(spark, store.runs, "batch"), head(spark, store).select(*PART, "upto")
    return runs.join(known, PART, "left").where(F.col("batch") > F.coalesce("upto", F.lit(-1))).drop("upto")


def read(spark: SparkSession, store: PointStore, parts: DataFrame | None = None) -> DataFrame:
    """Of a series and nanosecond the latest arrival over all runs; with ``parts`` only those partitions are scanned."""
    cut = (lambda d: d) if parts is None else (lambda d: only(d, parts))
    fresh = cut(_unmerged(spark, store))
    if not versions.committed(spark, store.manifest, "v"):
        return sinks.last_write(fresh.drop("batch"))
    base = cut(_rows(spark, store.merged, "v")).join(head(spark, store).select(*PART, "v"), [*PART, "v"], "left_semi").drop("v")
    dirty = fresh.select(*PART).distinct()
    folded = sinks.last_write(base.join(dirty, PART, "left_semi").unionByName(fresh.drop("batch")))
    return base.join(dirty, PART, "left_anti").unionByName(folded)


def merge(spark: SparkSession, store: PointStore, least: int = 4, rolled: int = -1) -> int:
    """Merges the runs of every partition that has ``least`` unmerged ones; returns how many partitions it merged."""
    batches = versions.committed(spark, store.runs, "batch")
    if not batches:
        return 0
    due = _unmerged(spark, store).groupBy(*PART).agg(F.count_distinct("batch").alias("n")).where(F.col("n") >= least).select(*PART)
    return _swap(spark, store, due, lambda d: d, max(batches), None, rolled)


def move(spark: SparkSession, store: PointStore, parts: DataFrame, change, hours: DataFrame, rolled: int = -1) -> int:
    """Rewrites the partitions ``parts`` with ``change(rows)`` and queues ``hours`` (metric, hour) in the same swap."""
    batches = versions.committed(spark, store.runs, "batch")
    return _swap(spark, store, parts, change, max(batches, default=-1), hours, rolled)


def _swap(spark: SparkSession, store: PointStore, due: DataFrame, change, newest: int, hours: DataFrame | None, rolled: int) -> int:
    due = cut_lineage(due.select(*PART).distinct())
    n = due.count()
    if not n:
        return 0
    k = versions.next_version(spark, store.manifest)
    old = versions.latest(spark, store.manifest, MANIFEST)
    rows = change(read(spark, store, due))
    (rows.hint("rebalance", *PART).sortWithinPartitions(*PART, "asset_id", "ts")
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*PART).parquet(f"{store.merged}/v={k:012d}"))
    entry = due.select(*PART, F.lit(k).cast("bigint").alias("v"), F.lit(newest).cast("bigint").alias("upto"), F.lit(None).cast("timestamp").alias("hour"))
    new = old.where("hour is null").join(due, PART, "left_anti").unionByName(entry).unionByName(old.where(F.col("hour").isNotNull() & (F.col("v") > rolled)))
    if hours is not None:
        new = new.unionByName(hours.select("metric", F.lit(None).cast("date").alias("date"), F.lit(k).cast("bigint").alias("v"), F.lit(None).cast("bigint").alias("upto"), "hour").distinct())
    versions.publish(new, store.manifest, k)
    _drop_unneeded(spark, store)
    return n


def _drop_unneeded(spark: SparkSession, store: PointStore) -> None:
    """Partition folders that none of the last three manifests reads. Only their names come to the driver."""
    last = [head(spark, store, back).select(*PART, "v", "upto") for back in range(3)]
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")
    runs = _rows(spark, store.runs, "batch").select(*PART, "batch", folder).distinct().join(last[2], PART).where("batch <= upto").select("folder")
    newest = max(versions.committed(spark, store.manifest, "v"))
    merged = _rows(spark, store.merged, "v").where(F.col("v") < newest).select(*PART, "v", folder).distinct()
    for m in last:
        merged = merged.join(m.select(*PART, "v"), [*PART, "v"], "left_anti")
    merged = merged.select("folder")
    uri = spark.sparkContext._jvm.java.net.URI
    for r in runs.unionByName(merged).collect():
        versions.drop(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri(r["folder"])).toString())
    for root, key in ((store.runs, "batch"), (store.merged, "v")):
        for number, path in versions.committed(spark, root, key).items():
            if not versions.listed(spark, path, "metric=*") and number < max(versions.committed(spark, root, key)):
                versions.drop(spark, path)
