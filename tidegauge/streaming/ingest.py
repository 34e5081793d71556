"""The ingest stream: one micro-batch is routed to points, rejects, ledgers and its change set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import catalog, evaluate, health
from ..schema import LOGS, SPANS
from ..session import cut_lineage
from ..sources import otlp, sinks, versions
from ..sources import store as stores
from . import rollup

KEYS = "key string, asset_id string, kind string, provider string"
SOURCES = "asset_id string, host_name string, signal string, provider string, first_seen timestamp, last_seen timestamp, received bigint, errors bigint"
ORPHANS = ("key string, key_type string, provider string, metrics bigint, logs bigint, traces bigint, first_seen timestamp, "
           "last_seen timestamp, associated_to string, associated_at timestamp")
INJECTIONS = ("uid string, type string, node string, asset_id string, start timestamp, end timestamp, intensity string, "
              "params map<string,string>, state string")


@dataclass
class Paths:
    """Folders of one deployment, all below one shared root."""
    root: str

    def __getattr__(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def store(self) -> stores.PointStore:
        return stores.PointStore(self.points_raw, self.points_merged, self.points_manifest)

    @property
    def levels(self) -> rollup.Levels:
        return rollup.Levels(self.changes, self.rolled, self.points_1m, self.points_1h)


METRICS = "job string, indicator string, value double, at timestamp, batch bigint"


def note_metrics(rows: DataFrame, paths: Paths, job: str, batch_id: int) -> None:
    """What a batch received and where it went, one row an indicator, as a table that A36 reads. Written again, it replaces."""
    counts = {"received": F.col("first")} | {v: (F.col("route") == v) & F.col("first") for v in ("valid", "no_value", "error")}
    one = rows.agg(*[F.count_if(c).cast("double").alias(n) for n, c in counts.items()], F.max("received_at").alias("at"))
    one.select(F.lit(job).alias("job"), F.explode(F.create_map(*[x for n in counts for x in (F.lit(n), F.col(n))])).alias("indicator", "value"), "at").write.mode(
        "overwrite").parquet(f"{paths.metrics}/{job}/batch={batch_id}")


def read_metrics(spark: SparkSession, paths: Paths, job: str) -> DataFrame:
    """The indicators of all batches; counters also as running ``total``, whose growth A36 reports."""
    root = f"{paths.metrics}/{job}"
    rows = spark.read.schema(METRICS).option("basePath", root).parquet(root)
    so_far = Window.partitionBy("indicator").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # a row for each batch and indicator
    return rows.withColumn("total", F.sum("value").over(so_far))


def observed(rows: DataFrame, name: str = "ingest") -> DataFrame:
    """Counts of every batch, read by :class:`ProgressLog`."""
    n = lambda v: F.count_if((F.col("route") == v) & F.col("first")).alias(v)
    return rows.observe(name, F.count_if("first").alias("received"), n("valid"), n("no_value"), n("error"))


class ProgressLog(StreamingQueryListener):
    """Keeps ``(query, batch, rows per second, duration, observed counts)`` of recent batches for ``platform_metrics``."""

    def __init__(self, keep: int = 1000):
        self.rows, self.keep = [], keep

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        seen = {k: v.asDict() for k, v in (p.observedMetrics or {}).items()}
        self.rows = [*self.rows, (p.name or str(p.id), p.batchId, p.timestamp, p.numInputRows, p.batchDuration, seen)][-self.keep:]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def metric_batch(paths: Paths):
    """The ``foreachBatch`` handler of OTLP/JSON metric batches.

    Everything it writes can be repeated for the same batch: points carry
    last-write-wins keys, state tables are versioned by the batch id, and the
    change set only names keys. It is written last: where it is, the points are.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = F.current_timestamp()
        keys = versions.last_good(spark, paths.keys, KEYS)
        broken = batch.where("_corrupt_record is not null").select(F.col("_corrupt_record").alias("line"), F.lit("not an OTLP/JSON batch").alias("error"))
        # rows are read by several writers below; the batch is bounded by the source's rate cap
        rows = observed(otlp.metric_rows(batch.where("_corrupt_record is null"), now)).persist()
        try:
            pts = otlp.points(rows, keys)
            folder = f"batch={batch_id}"
            sinks.write_rejects(broken.unionByName(rows.where("route = 'error'").select(
                F.to_json(F.struct("metric", "time_ns", "dims")).alias("line"), F.lit("time out of range").alias("error"))), f"{paths.rejects}/{folder}", "overwrite")
            stores.write_run(pts, paths.store, batch_id)
            ident = catalog.resolve(rows.where("first"), keys)
            _count(spark, ident, "metricas", paths.sources, paths.orphans, batch_id)
            note_metrics(rows, paths, "metrics", batch_id)
            rollup.note_changes(pts, paths.levels, batch_id)
        finally:
            rows.unpersist()
    return handle


def _count(spark: SparkSession, ident: DataFrame, signal: str, sources: str, orphans: str, batch_id: int) -> None:
    """Adds a batch of resolved rows (with ``route`` and ``received_at``) to the source and orphan ledgers of one signal."""
    arrivals = ident.groupBy("asset_id", "host_name", F.col("cloud_provider").alias("provider"), "received_at", "orphan", "key_name", "key_value").agg(
        F.count_if(F.col("route") == "valid").alias("received"), F.count_if(F.col("route") == "error").alias("errors")).withColumn("signal", F.lit(signal))
    old = _before(spark, sources, SOURCES, batch_id)
    versions.publish(health.merge_sources(old, health.source_deltas(arrivals).select(*old.columns)), sources, batch_id)
    found = arrivals.where("orphan and received > 0 and key_value is not null").select(
        F.col("key_value").alias("key"), F.col("key_name").alias("key_type"), "provider", "signal", "received_at", F.col("received").alias("n"))
    old = _before(spark, orphans, ORPHANS, batch_id)
    versions.publish(health.merge_orphans(old, health.orphan_deltas(found).select(*old.columns)), orphans, batch_id)


SIGNALS = {"logs": ("registros", otlp.log_rows, "ts", LOGS), "spans": ("trazas", otlp.span_rows, "start_ts", SPANS)}


def signal_batch(paths: Paths, kind: str):
    """The ``foreachBatch`` handler of log or span batches: rows, rejects, ledgers, and for logs the tee of fault events.

    Each signal keeps ledgers of its own, so the jobs never write one table;
    :func:`all_sources` and :func:`all_orphans` read them together.
    """
    signal, rows_of, ts, schema = SIGNALS[kind]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = F.current_timestamp()
        keys = versions.last_good(spark, paths.keys, KEYS)
        folder = f"batch={batch_id}"
        broken = batch.where("_corrupt_record is not null").select(F.col("_corrupt_record").alias("line"), F.lit("not an OTLP/JSON batch").alias("error"))
        sinks.write_rejects(broken, f"{paths.rejects}_{signal}/{folder}", "overwrite")
        # rows are read by several writers below; the batch is bounded by the source's rate cap
        rows = catalog.resolve(rows_of(batch.where("_corrupt_record is null"), now), keys).withColumn("route", F.lit("valid")).withColumn("received_at", now).persist()
        try:
            sinks.write_signal(rows.select(*[c for c in schema.names if c in rows.columns]), f"{paths.root}/{kind}/{folder}", ts, "overwrite")
            if kind == "logs":
                truth = rows.where(otlp.is_truth(F.col("attributes"), F.col("body"))).select(*[c for c in schema.names if c in rows.columns])
                sinks.write_signal(truth, f"{paths.truth}/{folder}", ts, "overwrite")
            _count(spark, rows, signal, f"{paths.sources}_{signal}", f"{paths.orphans}_{signal}", batch_id)
        finally:
            rows.unpersist()
    return handle


def start_signal(spark: SparkSession, inbox: str, paths: Paths, kind: str, files_per_trigger: int = 100, available_now: bool = False):
    """The job of one of the two signals, as :func:`start_metrics`."""
    src = otlp.read(spark, inbox, kind, stream=True, maxFilesPerTrigger=str(files_per_trigger))
    w = src.writeStream.foreachBatch(signal_batch(paths, kind)).option("checkpointLocation", f"{paths.root}/checkpoint_{kind}").queryName(kind)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def read_signal(spark: SparkSession, paths: Paths, kind: str, folder: str | None = None) -> DataFrame:
    """Logs, spans, or with ``folder`` = "truth" the teed fault events, of all batches."""
    root = f"{paths.root}/{folder or kind}"
    return spark.read.schema(SIGNALS[kind][3]).option("basePath", root).parquet(root)


def all_sources(spark: SparkSession, paths: Paths) -> DataFrame:
    """The source ledgers of the three signals."""
    parts = [versions.latest(spark, paths.sources + s, SOURCES) for s in ("", "_registros", "_trazas")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def all_orphans(spark: SparkSession, paths: Paths) -> DataFrame:
    """The orphan ledgers of the three signals, merged by key."""
    parts = [versions.latest(spark, paths.orphans + s, ORPHANS) for s in ("", "_registros", "_trazas")]
    return health.merge_orphans(parts[0], health.merge_orphans(parts[1], parts[2]))


def _before(spark: SparkSession, root: str, schema: str, batch_id: int) -> DataFrame:
    """The version a batch builds on: a repeated batch must not add to its own earlier result."""
    done = [f for f in versions._folders(spark, root) if int(f.rsplit("v=", 1)[1]) < batch_id]
    return spark.read.schema(schema).parquet(done[-1]) if done else spark.createDataFrame([], schema)


def read_points(spark: SparkSession, paths: Paths, parts: DataFrame | None = None) -> DataFrame:
    """Over all batches the latest arrival of a series and nanosecond counts; ``parts`` (metric, date) cuts the scan."""
    return stores.read(spark, paths.store, parts)


def run_redo(spark: SparkSession, paths: Paths, as_of=None, most: int | None = None) -> DataFrame:
    """T2 + T3: one cycle of the roll-up; returns the (metric, hour) pairs of this pass."""
    return rollup.cycle(spark, paths.store, paths.levels, as_of, most)


def run_merge(spark: SparkSession, paths: Paths, least: int = 4) -> int:
    """Merges the runs of partitions that have ``least`` of them; queued hours of moves stay until a cycle has taken them."""
    return stores.merge(spark, paths.store, least, rollup.progress(spark, paths.levels)["1m"][1])


def start_metrics(spark: SparkSession, inbox: str, paths: Paths, files_per_trigger: int = 100, available_now: bool = False):
    """The rate cap bounds a batch when the sinks lag."""
    src = otlp.read(spark, inbox, "metrics", stream=True, maxFilesPerTrigger=str(files_per_trigger))
    w = src.writeStream.foreachBatch(metric_batch(paths)).option("checkpointLocation", paths.checkpoint_metrics).queryName("metrics")
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def load_truth(spark: SparkSession, logs: DataFrame, keys: DataFrame, root: str) -> DataFrame:
    """J19 + J18 + U4 over all stored truth logs; the order of arrival does not matter, a repeat changes nothing."""
    rows, _ = evaluate.pair_events(otlp.truth_events(logs, F.col("time_ns")))
    state = versions.latest(spark, root, INJECTIONS)
    merged = evaluate.merge_injections(state, rows)
    out = evaluate.fill_assets(merged.drop("changed"), keys)
    versions.publish(out, root, versions.next_version(spark, root))
    return versions.latest(spark, root, INJECTIONS)


def due_moves(points: DataFrame, orphans: DataFrame, keys: DataFrame):
    """(moves: host_name, new_asset, since; touched hours; keys that only a person can associate)."""
    pending = catalog.resolvable(orphans, keys, pending_only=True)
    auto = pending.where("key_type = 'host.name'")
    moves = auto.select(F.col("key").alias("host_name"), F.col("resolves_to").alias("new_asset"), (F.col("first_seen") - F.expr("interval 2 hours")).alias("since"))
    hours = points.join(moves, "host_name").where((F.col("asset_id") == "sin_resolver") & (F.col("ts") >= F.col("since"))).select(
        "metric", F.date_trunc("hour", "ts").alias("hour")).distinct()
    return moves, hours, pending.where("key_type <> 'host.name'")


def _moved(points: DataFrame, moves: DataFrame) -> DataFrame:
    p = points if "reassigned" in points.columns else points.withColumn("reassigned", F.lit(False))
    return catalog.reassign(p, moves, ["metric", "time_ns", "value"], ts="ts")


def associate(points: DataFrame, orphans: DataFrame, keys: DataFrame):
    """What one pass moves. Returns ``(points after the move, hours to redo, keys that only a person can associate)``."""
    moves, hours, by_hand = due_moves(points, orphans, keys)
    return _moved(points, moves), hours, by_hand


def run_moves(spark: SparkSession, paths: Paths, keys: DataFrame) -> int:
    """Rows of orphan hosts that the catalogue now knows move to their asset. Returns the number of partitions rewritten.

    The (metric, date) partitions that hold such rows are swapped as a whole, and their hours are queued for the roll-up in
    the same manifest, so there is no state in which rows have moved and their summaries will not follow. The ledger is
    marked afterwards; a pass that dies before that finds nothing to move and marks it.
    """
    orphans = all_orphans(spark, paths)
    moves, hours, _ = due_moves(read_points(spark, paths), orphans, keys)
    moves, hours = cut_lineage(moves), cut_lineage(hours)
    parts = hours.select("metric", F.to_date("hour").alias("date")).distinct()
    n = stores.move(spark, paths.store, parts, lambda rows: sinks.last_write(_moved(rows, moves).drop("reassigned")), hours, rollup.progress(spark, paths.levels)["1m"][1])
    if not moves.isEmpty():
        done = moves.select(F.col("host_name").alias("key"), F.col("new_asset").alias("_to")).distinct()
        for signal in ("", "_registros", "_trazas"):
            root = paths.orphans + signal
            old = versions.latest(spark, root, ORPHANS)
            new = old.join(done, "key", "left").withColumn("associated_at", F.coalesce("associated_at", F.when(F.col("_to").isNotNull(), F.current_timestamp()))).withColumn(
                "associated_to", F.coalesce("associated_to", "_to")).select(*old.columns)
            if versions.committed(spark, root, "v"):
                versions.publish(cut_lineage(new), root, max(versions.committed(spark, root, "v")))
    return n
