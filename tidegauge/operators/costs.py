"""Charges: attribution to assets, reports, under-use, token use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import money
from ..schema import UNRESOLVED

# ---- fixed values
CPU_MEAN_MAX, CPU_PEAK_MAX, MEMORY_MEAN_MAX, LEAST_HOURS = 0.10, 0.40, 0.40, 24
UNASSIGNED, NO_ENV = "sin asignar", "desconocido"
WORD = "[a-z0-9][a-z0-9._-]*"
# ---- end of fixed values


def attribute(lines: DataFrame, keys: DataFrame, line_id: str, texts: list[str]) -> DataFrame:
    """Whole-word match of keys and asset ids; exactly one asset, else none with the reason.

    Words become rows and meet the keys in one equi join, so the cost follows
    the words, not words times keys.
    """
    names = keys.select(F.lower("key").alias("word"), "asset_id").unionByName(
        keys.select(F.lower("asset_id").alias("word"), "asset_id")).distinct()
    # an asset id hides a key of the same spelling
    ids = keys.select(F.lower("asset_id").alias("word"), F.lit(True).alias("_id")).distinct()
    names = names.join(ids, "word", "left").where(F.col("_id").isNull() | (F.lower("asset_id") == F.col("word"))).drop("_id")
    words = lines.select(line_id, F.explode(F.array_distinct(F.flatten(F.array(*[
        F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(f"({WORD})"), F.lit(1)) for t in texts])))).alias("word"))
    hits = words.join(names, "word").select(line_id, "asset_id").distinct().groupBy(line_id).agg(
        F.count(F.lit(1)).alias("_n"), F.array_join(F.sort_array(F.collect_list("asset_id")), ", ").alias("_all"))
    j = lines.join(hits, line_id, "left")
    one = F.coalesce(F.col("_n"), F.lit(0)) == 1
    return j.withColumn("asset_id", F.when(one, F.col("_all"))).withColumn("reason", F.when(one, "").when(
        F.col("_n") > 1, F.concat(F.lit("coincide con varios activos: "), "_all")).otherwise(
        "ningun recurso del catalogo aparece en la linea")).drop("_n", "_all")


def in_period(charges: DataFrame, start: Column, end: Column) -> DataFrame:
    """A charge belongs to the period in which it starts; both ends count."""
    return charges.where((F.col("start") >= start) & (F.col("start") <= end))


def report(charges: DataFrame) -> DataFrame:
    """Per (asset, provider), decimal sums rounded half to even, with the sources."""
    c = charges.where("asset_id is not null")
    g = c.groupBy("asset_id", "provider").agg(
        money(F.sum("amount")).alias("cost"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("source") != "", F.col("source")))), ", ").alias("sources"))
    return g.orderBy(F.desc("cost"), "asset_id")


def unassigned(charges: DataFrame) -> DataFrame:
    return charges.where("asset_id is null").agg(money(F.coalesce(F.sum("amount"), F.lit(0))).alias("unassigned"))


def import_summary(charges: DataFrame, file: str) -> DataFrame:
    """Lines, assigned, unassigned and total per file; the modal month (first seen on a tie) names the source."""
    month = F.date_format("start", "yyyy-MM")
    months = charges.where("start is not null").groupBy(file, month.alias("_m")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("line").alias("_first"))
    mode = months.groupBy(file).agg(F.max_by("_m", F.struct("_n", -F.col("_first"))).alias("month"))
    g = charges.groupBy(file).agg(F.count(F.lit(1)).alias("lines"), F.count("asset_id").alias("assigned"),
                                  F.count_if(F.col("asset_id").isNull()).alias("unassigned"), money(F.sum("amount")).alias("total"))
    return g.join(mode, file, "left").withColumn("source", F.when(F.col("month").isNull(), "factura exportada").otherwise(
        F.concat(F.lit("factura exportada "), "month"))).drop("month")


def default_period(charges: DataFrame, today: Column) -> DataFrame:
    """All dates of the charges, else the current month."""
    g = charges.agg(F.least(F.min("start"), F.min("end")).alias("a"), F.greatest(F.max("start"), F.max("end")).alias("z"))
    return g.select(F.coalesce("a", F.trunc(today, "month")).alias("period_start"), F.coalesce("z", F.last_day(today)).alias("period_end"))


def trend(charges: DataFrame, envs: DataFrame, by: str) -> DataFrame:
    """Spend per month, zero where a name has none in a month that exists, with the change to the month before.

    ``by``: ``env`` or ``asset_id``. The report prints every month for every
    name; the months (as many as the calendar has) travel as one array.
    """
    c = charges.join(envs.select("asset_id", F.col("env").alias("_env")), "asset_id", "left")
    env = F.when(F.col("asset_id").isNull(), UNASSIGNED).otherwise(F.coalesce("_env", F.lit(NO_ENV)))
    c = c.withColumn("env", env).withColumn("month", F.date_format("start", "yyyy-MM"))
    if by == "asset_id":
        c = c.where("asset_id is not null")
    spent = c.groupBy(by, "month").agg(F.sum("amount").alias("_s"))
    months = charges.agg(F.collect_set(F.date_format("start", "yyyy-MM")).alias("_ms"))
    grid = spent.select(by).distinct().join(months, F.lit(True)).select(by, F.explode("_ms").alias("month"))
    full = grid.join(spent, [by, "month"], "left").select(by, "month", money(F.coalesce("_s", F.lit(0))).alias("amount"))
    # a name has one row per month, so this window is as small as the calendar
    previous = F.lag("amount").over(W.partitionBy(by).orderBy("month"))
    return full.withColumn("previous", previous).withColumn("change", F.try_divide(
        (F.col("amount") - F.col("previous")).cast("double"), F.nullif(F.col("previous").cast("double"), F.lit(0.0))))


def percent(x: Column) -> Column:
    """Whole percent, half to even."""
    return F.concat(F.bround(x * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def under_used(cost: DataFrame, use: DataFrame) -> DataFrame:
    """J12 + A24: ``cost``: asset_id, provider, amount; ``use``: asset_id, kind (cpu / memoria), bucket, busy.

    Verdict true / false / null and the reason. The orphan pseudo-asset is not
    an asset.
    """
    is_cpu, v = F.col("kind") == "cpu", F.col("busy")
    mem = F.when(F.col("kind") == "memoria", v)
    u = use.groupBy("asset_id").agg(
        F.count_if(is_cpu).alias("_nc"), F.count(mem).alias("_nm"), F.bround(F.avg(F.when(is_cpu, v)), 4).alias("cpu_mean"),
        F.max(F.when(is_cpu, v)).alias("cpu_peak"), F.bround(F.avg(mem), 4).alias("memory_mean"))
    money_side = cost.groupBy("asset_id").agg(money(F.sum("amount")).alias("cost"), F.max("provider").alias("provider"))
    j = money_side.join(u, "asset_id", "full").where(F.col("asset_id") != UNRESOLVED)
    nc, nm = F.coalesce("_nc", F.lit(0)), F.coalesce("_nm", F.lit(0))
    hours = F.when(nm > 0, F.least(nc, nm)).otherwise(nc)
    paid = F.coalesce("cost", F.lit(0).cast("decimal(18,2)"))
    busy = F.concat_ws(", ", F.when(F.col("cpu_mean") >= CPU_MEAN_MAX, F.concat(F.lit("CPU promedio "), percent(F.col("cpu_mean")))),
                       F.when(F.col("cpu_peak") >= CPU_PEAK_MAX, F.concat(F.lit("pico de CPU "), percent(F.col("cpu_peak")))),
                       F.when(F.col("memory_mean") >= MEMORY_MEAN_MAX, F.concat(F.lit("memoria promedio "), percent(F.col("memory_mean")))))
    unknown = (F.when(paid <= 0, "sin costo en el periodo")
               .when(hours < LEAST_HOURS, F.concat(F.lit("solo "), hours.cast("string"),
                                                   F.lit(f" h de uso medidas; hacen falta {LEAST_HOURS}")))
               .when(F.col("memory_mean").isNull(), "sin datos de memoria"))
    fine = F.concat(F.lit("CPU promedio "), percent(F.col("cpu_mean")), F.lit(" y pico "), percent(F.col("cpu_peak")),
                    F.lit(", memoria promedio "), percent(F.col("memory_mean")), F.lit(", en "), hours.cast("string"), F.lit(" h medidas"))
    return j.select("asset_id", "provider", paid.alias("cost"), hours.alias("hours"), "cpu_mean", "cpu_peak", "memory_mean",
                    F.when(unknown.isNotNull(), F.lit(None)).otherwise(busy == "").alias("under_used"),
                    F.coalesce(unknown, F.when(busy == "", fine).otherwise(F.concat(F.lit("usa recursos: "), busy))).alias("reason")).orderBy(
        F.coalesce("under_used", F.lit(False)).cast("int").desc(), F.desc("cost"), "asset_id")


def totals(charges: DataFrame, envs: DataFrame) -> DataFrame:
    """A25 + J22: by provider, by environment and over all, in one pass."""
    c = charges.join(envs.select("asset_id", F.col("env").alias("_env")), "asset_id", "left").withColumn(
        "env", F.when(F.col("asset_id").isNull(), UNASSIGNED).otherwise(F.coalesce("_env", F.lit(NO_ENV))))
    return c.groupingSets([["provider"], ["env"], []], "provider", "env").agg(
        F.grouping_id().alias("level"), money(F.sum("amount")).alias("amount"), F.count(F.lit(1)).alias("charges"))


def tokens(use: DataFrame) -> DataFrame:
    """Per (UTC day, model) and per model; missing counts are 0."""
    d = use.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return d.groupingSets([["day", "model"], ["model"]], "day", "model").agg(F.count(F.lit(1)).alias("n"), s("tokens_in"), s("tokens_out"))
