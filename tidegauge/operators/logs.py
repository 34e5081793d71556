"""Log and trace queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from .ordered import shifted

#: Spans of a trace that one task may hold, and of the traces that are put in order together.
TRACE_SPANS, TOGETHER = 10000, 50000


def window(df: DataFrame, asset: str | None, start: Column | None, end: Column | None, ts: str) -> DataFrame:
    if asset is not None:
        df = df.where(F.col("asset_id") == asset)
    if start is not None:
        df = df.where(F.col(ts) >= start)
    if end is not None:
        df = df.where(F.col(ts) < end)
    return df


def search(logs: DataFrame, min_severity: int = 0, text: str | None = None, service: str | None = None) -> DataFrame:
    """The text is a plain substring, whatever its case."""
    df = logs.where(F.col("severity_num") >= min_severity)
    if text:
        df = df.where(F.contains(F.lower("body"), F.lit(text.lower())))
    if service:
        df = df.where(F.col("service_name") == service)
    return df


def newest(df: DataFrame, ts: str, n: int, *ties: str) -> DataFrame:
    """K2: top-n through TakeOrdered; the ties make the answer stable."""
    return df.orderBy(F.desc(ts), *ties).limit(n)


def trace_summary(spans: DataFrame, only_errors: bool = False) -> DataFrame:
    """A12, in one aggregation. The service set of a trace is bounded by the services there are, however long the trace is.

    The duration is whole microseconds times 1000.
    """
    root = F.col("parent_id") == ""
    out = spans.groupBy("trace_id").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.min_by(F.when(root, F.col("name")), F.when(root, F.struct("start_ts", "span_id"))).alias("root"),
        F.sort_array(F.collect_set("service_name")).alias("services")).withColumn(
        "duration_ns", (F.unix_micros("end_ts") - F.unix_micros("start_ts")) * 1000)
    return out.where("errors > 0") if only_errors else out


def correlated(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Logs with their span; both sides are cut to asset and window by the caller.

    Empty ids match nothing. Most logs have none, so they pass beside the join
    instead of meeting in one partition of it.
    """
    linked = (F.coalesce("trace_id", F.lit("")) != "") & (F.coalesce("span_id", F.lit("")) != "")
    s = spans.where("trace_id <> '' and span_id <> ''").select(
        "trace_id", "span_id", F.col("name").alias("operation"), "duration_ns", F.col("status").alias("span_status"))
    return logs.where(linked).join(s, ["trace_id", "span_id"], "left").unionByName(logs.where(~linked), allowMissingColumns=True)


def is_severe() -> Column:
    return F.upper("severity").rlike("^(ERROR|FATAL)")


def error_rows(pairs: DataFrame) -> DataFrame:
    """P23."""
    return pairs.where((F.col("span_status") == "error") | is_severe())


def window_counts(logs: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Four counts per key in one aggregation over both signals."""
    a = logs.select(*keys, F.lit("l").alias("_t"), (F.col("severity_num") >= 17).alias("_bad"))
    b = spans.select(*keys, F.lit("s").alias("_t"), (F.col("status") == "error").alias("_bad"))
    is_log = F.col("_t") == "l"
    u = a.unionByName(b)
    g = u.groupBy(*keys) if keys else u.groupBy()
    return g.agg(F.count_if(is_log).alias("logs"), F.count_if(is_log & F.col("_bad")).alias("error_logs"),
                 F.count_if(~is_log).alias("spans"), F.count_if(~is_log & F.col("_bad")).alias("error_spans"))


def spans_in_order(spans: DataFrame, trace_id: str, limit: int = 5000) -> DataFrame:
    """K3: by start, the root first on a tie."""
    return spans.where(F.col("trace_id") == trace_id).orderBy("start_ts", F.col("parent_id") != "", "span_id").limit(limit)


def _folded(spans: DataFrame) -> DataFrame:
    """One row for each span: its earliest start and the parent of that."""
    return spans.groupBy("trace_id", "span_id").agg(F.min(F.struct("start_ts", "parent_id")).alias("_m")).select("trace_id", "span_id", "_m.start_ts", "_m.parent_id")


def span_levels(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, start_ts, above, level) of every span that has a root, one row however often it was sent.

    Spans come at least once, so equal ids are folded first (the earliest start and its parent stay). A span whose parent is not in
    its trace is a root. Every span points to an ancestor and counts the steps to it; each round follows the
    ancestor's own pointer, so a tree of any depth d takes log2(d) rounds of one equi join on (trace, span), and a row stays
    two numbers. Traces are never gathered. Spans in a cycle of parents have no root and no row.
    """
    one = _folded(spans)
    ids = one.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"))
    above = F.when(F.col("_s").isNotNull(), F.col("parent_id"))
    tree = cut_lineage(one.join(ids, (one["trace_id"] == ids["_t"]) & (one["parent_id"] == ids["_s"]), "left").select(
        "trace_id", "span_id", "start_ts", above.alias("above"), above.alias("to"), F.when(above.isNotNull(), 1).otherwise(0).cast("bigint").alias("level")))
    left = tree.where("to is not null").count()
    while left:
        up = tree.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("to").alias("_to"), F.col("level").alias("_l"))
        j = tree.join(up, (tree["trace_id"] == up["_t"]) & (tree["to"] == up["_s"]), "left")
        tree = cut_lineage(j.select("trace_id", "span_id", "start_ts", "above", F.col("_to").alias("to"), (F.col("level") + F.coalesce("_l", F.lit(0))).alias("level")))
        was, left = left, tree.where("to is not null").count()
        if left == was:
            break
    return tree.where("to is null").drop("to")


def _by_ranking(spans: DataFrame, ordered: bool) -> DataFrame:
    """:func:`span_tree` of traces of any size, which are never gathered.

    The order is that of an Euler tour: each span is entered and left; entering leads to its first child, leaving to its next
    sibling (by start, then id) or out of its parent. Places are the ranks in this list, found by pointer doubling
    with two sums per element, in log2 of the length of the longest tour.
    """
    tree = span_levels(spans)
    if not ordered:
        return tree.select("trace_id", "span_id", F.col("level").cast("int").alias("level"))
    tree = tree.withColumn("under", F.coalesce("above", F.lit("\0"))).withColumn("start_ts", F.coalesce("start_ts", F.timestamp_seconds(F.lit(0))))
    first = tree.where("above is not null").groupBy("trace_id", "above").agg(F.min(F.struct("start_ts", "span_id")).alias("_f")).select("trace_id", F.col("above").alias("span_id"), F.col("_f.span_id").alias("child"))
    with_next = shifted(tree, ["trace_id", "under"], "start_ts", 60, {"sibling": ("span_id", -1)}, ties=["span_id"])
    nodes = with_next.join(first, ["trace_id", "span_id"], "left")
    element = lambda side, to, to_side, n: F.struct(F.lit(side).alias("side"), to.alias("to"), to_side.alias("to_side"), F.lit(n).cast("bigint").alias("n"))
    enter = element(0, F.coalesce("child", "span_id"), F.col("child").isNull().cast("int"), 1)
    leave = element(1, F.coalesce("sibling", "above"), F.col("sibling").isNull().cast("int"), 0)
    tour = written(nodes.select("trace_id", "span_id", F.explode(F.array(enter, leave)).alias("_e")).select("trace_id", "span_id", "_e.*"))
    while not tour.where("to is not null").isEmpty():
        up = tour.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("side").alias("_k"), F.col("to").alias("_to"), F.col("to_side").alias("_tk"), F.col("n").alias("_n"))
        j = tour.join(up, (tour["trace_id"] == up["_t"]) & (tour["to"] == up["_s"]) & (tour["to_side"] == up["_k"]), "left")
        tour = written(j.select("trace_id", "span_id", "side", F.col("_to").alias("to"), F.col("_tk").alias("to_side"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")))
    total = tree.groupBy("trace_id").agg(F.count("*").alias("_all"))
    place = tour.where("side = 0").join(total, "trace_id").select("trace_id", "span_id", (F.col("_all") - F.col("n")).alias("path"))
    return tree.join(place, ["trace_id", "span_id"]).select("trace_id", "span_id", F.col("level").cast("int").alias("level"), "path")


def _walked(t: pa.Table) -> pa.Table:
    """Levels and places of the spans of some whole traces, each span once."""
    n = len(t)
    trace = t["trace_id"].combine_chunks().dictionary_encode().indices.to_numpy().astype("int64")
    ids = pa.concat_arrays([t["span_id"].combine_chunks(), t["parent_id"].combine_chunks()]).dictionary_encode()
    order = np.empty(len(ids.dictionary), "int64")
    order[pc.sort_indices(ids.dictionary).to_numpy()] = np.arange(len(order))
    code = order[ids.indices.fill_null(0).to_numpy()]
    key = trace * len(order) + code[:n]
    asked = np.where(t["parent_id"].is_valid().to_numpy(), trace * len(order) + code[n:], -1)
    by_key = np.argsort(key)
    at = by_key[np.minimum(np.searchsorted(key[by_key], asked), n - 1)]
    up = np.where(key[at] == asked, at, -1)
    # every span follows its ancestors' own pointers; what never ends is in a cycle, or below one
    to, level = up.copy(), (up >= 0).astype("int64")
    for _ in range(n.bit_length()):
        more = np.flatnonzero(to >= 0)
        level[more], to[more] = level[more] + level[to[more]], to[to[more]]
    rows = np.flatnonzero(to < 0)
    start = t["_s"].to_numpy()
    group = np.where(up >= 0, up, n + trace)
    rows = rows[np.lexsort((code[:n][rows], start[rows], group[rows], level[rows]))]
    edges = np.flatnonzero(np.r_[True, np.diff(level[rows]) > 0, True]) if len(rows) else np.zeros(1, int)
    levels = [rows[i:j] for i, j in zip(edges, edges[1:])]
    size, place = np.ones(n, "int64"), np.zeros(n, "int64")
    for r in levels[:0:-1]:
        np.add.at(size, up[r], size[r])
    for k, r in enumerate(levels):
        before = np.cumsum(size[r]) - size[r]
        first = np.maximum.accumulate(np.where(np.r_[True, np.diff(group[r]) != 0], np.arange(len(r)), 0))
        place[r] = before - before[first] + (place[up[r]] + 1 if k else 0)
    out = t.select(["trace_id", "span_id"]).take(pa.array(rows))
    return out.append_column("level", pa.array(level[rows].astype("int32"))).append_column("path", pa.array(place[rows]))


def span_tree(spans: DataFrame, ordered: bool = True) -> DataFrame:
    """``level`` of every span and, if ``ordered``, its ``path``: the place in the depth-first order of its trace.

    Traces of at most ``TRACE_SPANS`` spans are walked some at a time, dealt by their id. Longer ones, and those with spans that have no
    id, are ranked by joins.
    """
    one = written(_folded(spans))
    far = one.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_n"), F.count("span_id").alias("_ids")).where(
        (F.col("_n") > TRACE_SPANS) | (F.col("_ids") < F.col("_n")) | F.col("trace_id").isNull()).select(F.col("trace_id").alias("_t"))
    same = F.col("trace_id").eqNullSafe(F.col("_t"))
    near = one.join(far, same, "left_anti")
    shares = one.count() // TOGETHER + 1
    start = F.unix_micros(F.coalesce("start_ts", F.timestamp_seconds(F.lit(0))))
    dealt = near.select("trace_id", "span_id", "parent_id", start.alias("_s"), F.pmod(F.xxhash64("trace_id"), F.lit(shares)).alias("_b"))
    walked = dealt.groupBy("_b").applyInArrow(_walked, "trace_id string, span_id string, level int, path bigint")
    if not ordered:
        walked = walked.drop("path")
    rest = one.join(far, same, "left_semi")
    return walked if rest.isEmpty() else walked.unionByName(_by_ranking(rest, ordered))


def gantt(spans: DataFrame) -> DataFrame:
    """offset and width in percent of the trace; at least 0.5 wide, total at least 1 ms."""
    ends = spans.groupBy("trace_id").agg(F.min("start_ts").alias("_a"), F.max("end_ts").alias("_z"))
    ms = lambda c: F.floor(F.unix_micros(c) / 1000)
    total = F.greatest(F.lit(1.0), (ms("_z") - ms("_a")).cast("double"))
    return spans.join(ends, "trace_id").select(
        "trace_id", "span_id", ((ms("start_ts") - ms("_a")) / total * 100).alias("offset_pct"),
        F.greatest(F.lit(0.5), F.col("duration_ns") / 1e6 / total * 100).alias("width_pct"))


def span_metrics(spans: DataFrame, step: int, bounds_ms=(5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)) -> DataFrame:
    """Call counter and latency histogram per window, service, operation, kind and status."""
    ms = F.col("duration_ns") / 1e6
    buckets = [F.count_if(ms <= b).alias(f"le_{b}") for b in bounds_ms]
    return spans.groupBy(F.window("start_ts", f"{step} seconds").alias("w"), "service_name", "name", "kind", "status").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("duration_ns").alias("duration_ns_sum"), *buckets).select(
        F.col("w.start").alias("bucket"), "service_name", "name", "kind", "status", "calls", "duration_ns_sum",
        *[f"le_{b}" for b in bounds_ms])


