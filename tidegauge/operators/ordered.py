"""Ordered operators that survive one series holding a third of all rows.

A window partitioned by series alone sends a hot series to one task. Here the
order is cut in two steps: rows are counted per (series, time bucket), the
counts are accumulated over the buckets (one small row per bucket), and every
row gets its position from its own bucket. Positions then cut the series into
chunks of equal size, and each chunk receives copies of the last ``halo`` rows
before it, so frames of up to ``halo`` rows are exact inside the chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_ROWS = 4096


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows by (keys, bucket), dealt once: the sums of the buckets and the rows themselves both read this exchange.

    Rows without a time have no place. They go here, on both branches alike; the
    join would drop them on one of them only.
    """
    return df.where("_b is not null").repartition(*keys, "_b")


def _seal(columns: list[str]) -> Column:
    """An aggregate over all columns. It keeps the optimizer from pruning the branch of the bucket sums, whose exchange would
    then differ from that of the rows, so that the input would be read twice in every layer."""
    return F.any_value(F.struct(*columns)).alias("_seal")


def _sealed(value: Column) -> Column:
    """``value``; the seal of a bucket is never null."""
    return F.when(F.col("_seal").isNotNull(), value)


def with_position(df: DataFrame, keys: list[str], ts: str, bucket_seconds: int, ties: list[str] | None = None,
                  bucket: Column | None = None) -> DataFrame:
    """Adds ``pos``: the 1-based place of the row in its series.

    ``bucket`` replaces the time bucket where the order is not by time; it
    must not fall as the order rises.
    """
    ties = ties or []
    cut = _dealt(df.withColumn("_b", F.floor(F.unix_seconds(F.col(ts)) / bucket_seconds) if bucket is None else bucket), keys)
    counts = cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), _seal(cut.columns))
    counts = counts.select(*keys, "_b", _sealed(F.col("_n")).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_b").orderBy(ts, *ties)
    ranked = cut.withColumn("_rn", F.row_number().over(inside))
    on = [ranked[k].eqNullSafe(counts[k]) for k in keys] + [ranked["_b"] == counts["_b"]]
    joined = ranked.join(counts, on)
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_before") + F.col("_rn")).alias("pos"))


def with_halo(df: DataFrame, halo: int, chunk_rows: int = CHUNK_ROWS, ahead: int = 0) -> DataFrame:
    """Copies rows near a chunk's edges into its neighbours.

    Adds ``chunk`` and ``own`` (false on copies). Needs ``pos``. ``halo`` rows
    before a chunk and ``ahead`` rows after it are visible inside it.
    """
    chunk_rows = max(chunk_rows, halo, ahead)
    home = F.floor((F.col("pos") - 1) / chunk_rows)
    place = F.pmod(F.col("pos") - 1, F.lit(chunk_rows))
    places = F.array(home, F.when(place >= chunk_rows - halo, home + 1), F.when(place < ahead, home - 1))
    out = df.withColumn("chunk", F.explode(F.array_compact(places)))
    return out.withColumn("own", F.col("chunk") == home)


def local_frames(df: DataFrame, keys: list[str], ts: str, bucket_seconds: int, halo: int, ahead: int = 0,
                 chunk_rows: int = CHUNK_ROWS, ties: list[str] | None = None):
    """``(df, window)``: compute over ``window`` (or a ``rowsBetween`` of it), then keep ``own`` rows."""
    cut = with_halo(with_position(df, keys, ts, bucket_seconds, ties), halo, chunk_rows, ahead)
    return cut, W.partitionBy(*keys, "chunk").orderBy("pos")


def shifted(df: DataFrame, keys: list[str], ts: str, bucket_seconds: int, columns: dict[str, tuple[str, int]],
            chunk_rows: int = CHUNK_ROWS, ties: list[str] | None = None) -> DataFrame:
    """``lag``/``lead`` columns: ``{new: (column, n)}``, n > 0 looks back, n < 0 looks ahead."""
    back = max([n for _, n in columns.values() if n > 0], default=0)
    ahead = max([-n for _, n in columns.values() if n < 0], default=0)
    cut, w = local_frames(df, keys, ts, bucket_seconds, back, ahead, chunk_rows, ties)
    # ahead-copies sit before the chunk in no other way than by position, so lag and lead see true neighbours
    for new, (col, n) in columns.items():
        cut = cut.withColumn(new, F.lag(col, n).over(w) if n > 0 else F.lead(col, -n).over(w))
    return cut.where("own").drop("chunk", "own")


def running_sum(df: DataFrame, keys: list[str], ts: str, bucket_seconds: int, value: str | Column, name: str,
                ties: list[str] | None = None) -> DataFrame:
    """Cumulative sum per series: bucket totals accumulate first, rows add inside their bucket."""
    value = F.col(value) if isinstance(value, str) else value
    cut = _dealt(df.withColumn("_v", value).withColumn("_b", F.floor(F.unix_seconds(F.col(ts)) / bucket_seconds)), keys)
    totals = cut.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"), _seal(cut.columns)).select(*keys, "_b", _sealed(F.col("_t")).alias("_t"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_b").orderBy(ts, *(ties or [])).rowsBetween(W.unboundedPreceding, 0)
    part = cut.withColumn("_in", F.sum("_v").over(inside))
    on = [part[k].eqNullSafe(totals[k]) for k in keys] + [part["_b"] == totals["_b"]]
    return part.join(totals, on).select(
        *[part[c] for c in df.columns], (F.coalesce(F.col("_in"), F.lit(0)) + F.col("_before")).alias(name))


def filled(df: DataFrame, keys: list[str], ts: str, bucket_seconds: int, columns: list[str]) -> DataFrame:
    """Forward fill, then backward fill, per series."""
    cut = _dealt(df.withColumn("_b", F.floor(F.unix_seconds(F.col(ts)) / bucket_seconds)), keys)
    known = {c: F.when(F.col(c).isNotNull(), F.col(ts)) for c in columns}
    edge = cut.groupBy(*keys, "_b").agg(
        *[F.max_by(c, known[c]).alias(f"_l_{c}") for c in columns],
        *[F.min_by(c, known[c]).alias(f"_f_{c}") for c in columns], _seal(cut.columns))
    edge = edge.select(*keys, "_b", *[_sealed(F.col(c)).alias(c) for c in edge.columns if c[:3] in ("_l_", "_f_")])
    past = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    future = W.partitionBy(*keys).orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    edge = edge.select(*keys, "_b",
                       *[F.last(f"_l_{c}", True).over(past).alias(f"_p_{c}") for c in columns],
                       *[F.first(f"_f_{c}", True).over(future).alias(f"_n_{c}") for c in columns])
    back = W.partitionBy(*keys, "_b").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    fwd = W.partitionBy(*keys, "_b").orderBy(ts).rowsBetween(0, W.unboundedFollowing)
    part = cut.select("*", *[F.last(c, True).over(back).alias(f"_i_{c}") for c in columns],
                      *[F.first(c, True).over(fwd).alias(f"_j_{c}") for c in columns])
    on = [part[k].eqNullSafe(edge[k]) for k in keys] + [part["_b"] == edge["_b"]]
    j = part.join(edge, on)
    pick = {c: F.coalesce(F.col(f"_i_{c}"), F.col(f"_p_{c}"), F.col(f"_j_{c}"), F.col(f"_n_{c}")).alias(c) for c in columns}
    return j.select(*[pick.get(c, part[c]) for c in df.columns])
