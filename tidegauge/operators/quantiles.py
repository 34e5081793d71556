"""Exact interpolated percentiles of groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.
That is right for frames and incidents, whose size is bounded, and wrong for
"all rows of an asset". Here a mergeable sketch first brackets the wanted rank;
its error bound is known, so the rank cannot lie outside. Only the values
inside the bracket are then counted and ordered; everything below it is one
number. Two rounds shrink a group by about six orders of magnitude.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 1000
ROUNDS = 2


def _with(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to a one-row-per-group table, null groups included."""
    other = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = F.col(k).eqNullSafe(F.col(f"_k{i}")) if i == 0 else on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(other, on).drop(*[f"_k{i}" for i in range(len(keys))])


def exact_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str, rounds: int = ROUNDS) -> DataFrame:
    """One row per group: ``keys, name``; null values are ignored, linear interpolation.

    ``rounds`` bracketing rounds, whatever the size of the groups; 0 is the
    built-in, for groups that are bounded by their meaning. No job runs here.

    The group table is small next to the rows, so the join of brackets is left
    to the planner (it broadcasts below the session's own size limit only).
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    group = lambda d: d.groupBy(*keys) if keys else d.groupBy()
    if rounds == 0:
        return group(rows).agg(F.percentile("_v", F.lit(p)).alias(name)).where(F.col(name).isNotNull())
    want = group(rows).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select(
        *keys, ((F.col("_n") - 1) * F.lit(p)).alias("_r"), F.lit(0).cast("bigint").alias("_below"))
    for _ in range(rounds):
        # positions of the wanted ranks inside the rows that are left, widened by twice the sketch error
        sketch = group(rows).agg(F.count(F.lit(1)).alias("_m"),
                                 F.percentile_approx("_v", [i / ACCURACY for i in range(ACCURACY + 1)], 20 * ACCURACY).alias("_q"))
        st = _with(sketch, want, keys)
        local = F.col("_r") - F.col("_below")
        lo_i = F.greatest(F.lit(0), F.floor(local / F.col("_m") * ACCURACY) - 2).cast("int")
        hi_i = F.least(F.lit(ACCURACY), F.ceil((local + 1) / F.col("_m") * ACCURACY) + 2).cast("int")
        bracket = st.select(*keys, F.try_element_at("_q", lo_i + 1).alias("_lo"),
                            F.try_element_at("_q", hi_i + 1).alias("_hi"), "_r", "_below")
        j = _with(rows, bracket, keys)
        low = group(j).agg(F.first("_r").alias("_r"), (F.first("_below") + F.count_if(F.col("_v") < F.col("_lo"))).alias("_below"))
        rows = j.where("_v >= _lo and _v <= _hi").select(*keys, "_v")
        want = low
    vals = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*(keys or [F.lit(1)])).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    vals = vals.withColumn("_cum", F.sum("_c").over(w))
    f = _with(vals, want, keys)
    upto = F.col("_below") + F.col("_cum")
    out = group(f).agg(F.min(F.when(upto > F.floor("_r"), F.col("_v"))).alias("_a"),
                       F.min(F.when(upto > F.ceil("_r"), F.col("_v"))).alias("_z"), F.first("_r").alias("_r"))
    frac = F.col("_r") - F.floor("_r")
    return out.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * frac).alias(name))
