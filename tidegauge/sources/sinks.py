"""Where rows are written, and the export of a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import dims_text
from ..operators.evaluate import overlapping
from ..schema import METRIC_POINTS, TAGS


def last_write(points: DataFrame) -> DataFrame:
    """The same series at the same nanosecond is one row; the latest arrival wins (the larger value on equal arrival)."""
    keys = ["metric", "date", *TAGS, "time_ns"]
    rest = [c for c in points.columns if c not in keys]
    g = points.groupBy(*keys, dims_text(F.col("dims")).alias("_dims")).agg(F.max_by(F.struct(*rest), F.struct("received_at", "value")).alias("r"))
    return g.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in points.columns])


def write_points(points: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by (metric, date), sorted inside files, so a request reads few row groups.

    Rows are rebalanced: a metric that holds a third of all rows is split into
    partitions of the advisory size, small ones are not cut at all. An overwrite
    replaces the whole folder, which then carries the marker of a finished write.
    """
    out = last_write(points)
    (out.hint("rebalance", "metric", "date").sortWithinPartitions("metric", "asset_id", "ts")
        .write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("metric", "date").parquet(path))


def write_signal(rows: DataFrame, path: str, ts: str, mode: str = "append") -> None:
    """Day partitions, (asset, service, time) order, bloom filter on the trace id."""
    d = rows.withColumn("date", F.to_date(ts))
    (d.hint("rebalance", "date").sortWithinPartitions("asset_id", "service_name", ts)
        .write.mode(mode).option("parquet.bloom.filter.enabled#trace_id", "true").partitionBy("date").parquet(path))


def write_json_lines(rows: DataFrame, path: str, signal: str, ts: str, mode: str = "append") -> None:
    """One set of files per signal and day."""
    rows.withColumn("signal", F.lit(signal)).withColumn("date", F.to_date(ts)).write.mode(mode).partitionBy("signal", "date").json(path)


def write_rejects(rows: DataFrame, path: str, mode: str = "append") -> None:
    """``line, error`` with the day it came."""
    rows.select("line", "error", F.current_date().alias("date")).write.mode(mode).partitionBy("date").json(path)


def export_range(points: DataFrame, injections: DataFrame, gaps: DataFrame, start, end, path: str) -> None:
    """One Parquet folder per metric, injections and gaps as CSV, and a manifest with the rows per metric."""
    from ..functions.times import as_lit
    from ..operators.series import in_range
    rows = in_range(points, start, end)
    rows.drop("date").hint("rebalance", "metric").write.mode("overwrite").partitionBy("metric").parquet(f"{path}/metrics")
    flat = lambda d: d.select(*[F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in d.dtypes])
    flat(overlapping(injections, as_lit(start), as_lit(end))).write.mode("overwrite").csv(f"{path}/injections", header=True, escape='"')
    flat(gaps).write.mode("overwrite").csv(f"{path}/gaps", header=True)
    rows.groupBy("metric").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(f"{path}/manifest")


def read_export(spark: SparkSession, path: str, metric: str | None = None) -> DataFrame:
    """With the fixed schema, so a metric that is not there is empty."""
    schema = T.StructType([f for f in METRIC_POINTS.fields if f.name != "date"])
    df = spark.read.schema(schema).parquet(f"{path}/metrics")
    return df.where(F.col("metric") == metric) if metric else df


def drop_old(spark: SparkSession, path: str, days: int, today) -> list[str]:
    """Delete whole date partitions older than the limit; returns what was removed.

    Only folder names are read and removed, through the file system the path
    belongs to; no row is touched.
    """
    from datetime import timedelta
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    limit, removed = (today - timedelta(days=days)).isoformat(), []
    for pattern in ("date=*", "*/date=*"):
        for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, pattern)) or []:
            day = st.getPath().getName().split("=", 1)[1]
            if day < limit:
                fs.delete(st.getPath(), True)
                removed.append(day)
    return sorted(removed)
