"""Configuration findings from the latest snapshot of every node.

``snapshots``: node, env, asset_id, taken_at, seq, agent_version, interval_s,
ports array<struct>, containers array<struct>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values
SENSITIVE_PORTS = (5432, 8000, 8080, 8181)
EXPECTED_PORTS = [("*", 22), ("plataforma", 443), ("plataforma", 4317)]
ROOT_ALLOWED = ("agente", "inyector")
ROOT_USERS = ("", "root", "0")
# ---- end of fixed values


def latest(snapshots: DataFrame) -> DataFrame:
    """Per node; the later insert wins a tie."""
    cols = [c for c in snapshots.columns if c != "node"]
    return snapshots.groupBy("node").agg(F.max_by(F.struct(*cols), F.struct("taken_at", "seq")).alias("s")).select("node", "s.*")


def most_common(df: DataFrame, col: str, order: str) -> DataFrame:
    """K8: one row ``common``; the value seen first wins a tie."""
    n = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_f"))
    return n.agg(F.max_by(col, F.struct("_n", -F.col("_f"))).alias("common"), F.count(F.lit(1)).alias("kinds"))


def _who() -> Column:
    return F.coalesce("asset_id", "node")


def _list(c: Column) -> Column:
    """Sorted distinct texts of a group as one text; the set is merged on the map side."""
    return F.array_join(F.sort_array(F.collect_set(c)), ", ")


def exposed_ports(snapshots: DataFrame, expected: DataFrame, sensitive=SENSITIVE_PORTS) -> DataFrame:
    """A47."""
    p = snapshots.select("node", "env", "taken_at", _who().alias("asset"), F.explode("ports").alias("p")).select(
        "node", "env", "taken_at", "asset", "p.puerto", "p.protocolo", "p.direccion", "p.proceso").distinct()
    p = p.where(~F.col("direccion").rlike(r"^(127\.|::1|localhost)"))
    anywhere = expected.where("env = '*'").select(F.col("port").alias("puerto")).distinct()
    own = expected.where("env <> '*'").select("env", F.col("port").alias("puerto")).distinct()
    p = p.join(anywhere, "puerto", "left_anti").join(own, ["env", "puerto"], "left_anti")
    hot = F.col("puerto").isin(*sensitive)
    detail = F.concat(F.lit("El puerto "), F.col("puerto").cast("string"), F.lit("/"), "protocolo", F.lit(" escucha en "), "direccion",
                      F.lit(" en "), "node", F.when(F.col("proceso") != "", F.concat(F.lit(" ("), "proceso", F.lit(")"))).otherwise(""),
                      F.lit(" y no esta entre los esperados del entorno "), "env", F.lit("."),
                      F.when(hot, " Es uno de los que nunca deben quedar expuestos.").otherwise(""))
    return p.select(F.lit("puerto-expuesto-no-esperado").alias("rule"), F.when(hot, "alta").otherwise("media").alias("severity"),
                    F.col("asset").alias("assets"), F.col("env").alias("envs"), detail.alias("detail"), F.col("taken_at").alias("detected"))


def agent_versions(snapshots: DataFrame, wanted: str = "") -> DataFrame:
    """Nodes whose version is not the wanted one, else not the most common one."""
    v = snapshots.withColumn("_v", F.nullif("agent_version", F.lit("")))
    ref = snapshots.sparkSession.createDataFrame([(wanted,)], "common string") if wanted else most_common(v, "_v", "seq").where(
        "common is not null").select("common")
    # the reference version is one row
    odd = v.join(F.broadcast(ref), F.lit(True)).where(F.coalesce("_v", F.lit("")) != F.col("common")).withColumn(
        "_ver", F.coalesce("_v", F.lit("desconocida")))
    g = odd.groupBy("_ver", "common").agg(_list(_who()).alias("assets"), _list(F.col("env")).alias("envs"), _list(F.col("node")).alias("nodes"),
                                          F.max("taken_at").alias("detected"))
    detail = F.concat("nodes", F.lit(" corre el agente "), "_ver", F.lit(" y el resto "), "common",
                      F.lit(". La comparacion entre entornos solo vale si todos miden con la misma version."))
    return g.select(F.lit("version-agente-distinta").alias("rule"), F.lit("media").alias("severity"), "assets", "envs", detail.alias("detail"), "detected")


def sampling_intervals(snapshots: DataFrame) -> DataFrame:
    """One finding with every node that does not sample at the common interval."""
    ref = most_common(snapshots, "interval_s", "seq").where("kinds > 1").select("common")
    odd = snapshots.join(F.broadcast(ref), F.lit(True)).where("interval_s <> common")
    said = F.concat("node", F.lit(" cada "), F.col("interval_s").cast("string"), F.lit(" s"))
    g = odd.groupBy("common").agg(_list(_who()).alias("assets"), _list(F.col("env")).alias("envs"), F.max("taken_at").alias("detected"),
                                  F.transform(F.sort_array(F.collect_list(F.struct("seq", said.alias("t")))), lambda x: x["t"]).alias("_l"))
    detail = F.concat(F.lit("Muestrean distinto del comun ("), F.col("common").cast("string"), F.lit(" s): "), F.array_join("_l", "; "), F.lit("."))
    return g.select(F.lit("intervalo-muestreo-distinto").alias("rule"), F.lit("media").alias("severity"), "assets", "envs", detail.alias("detail"), "detected")


def root_containers(snapshots: DataFrame, allowed=ROOT_ALLOWED) -> DataFrame:
    """A50."""
    c = snapshots.select("node", "env", "taken_at", _who().alias("asset"), F.explode("containers").alias("c"))
    root = F.trim(F.split("c.usuario", ":")[0]).isin(*ROOT_USERS)
    version = F.when(F.coalesce("c.version", F.lit("")) == "", "?").otherwise(F.col("c.version"))
    detail = F.concat(F.lit("El contenedor "), "c.nombre", F.lit(" ("), "c.imagen", F.lit(":"), version, F.lit(") corre como root en "), "node", F.lit("."))
    return c.where(root & ~F.col("c.nombre").isin(*allowed)).select(
        F.lit("contenedor-como-root").alias("rule"), F.lit("alta").alias("severity"), F.col("asset").alias("assets"),
        F.col("env").alias("envs"), detail.alias("detail"), F.col("taken_at").alias("detected"))


def image_versions(snapshots: DataFrame) -> DataFrame:
    """The same image in at least two versions."""
    c = snapshots.select("node", "env", "taken_at", _who().alias("asset"), F.explode("containers").alias("c")).select(
        "node", "env", "taken_at", "asset", F.col("c.imagen").alias("image"), F.coalesce("c.version", F.lit("")).alias("version"))
    by_version = c.groupBy("image", "version").agg(F.collect_set("node").alias("ns"), F.collect_set("asset").alias("as"), F.collect_set("env").alias("es"),
                                                   F.max("taken_at").alias("at"))
    said = F.concat(F.when(F.col("version") == "", "?").otherwise(F.col("version")), F.lit(" en "), F.array_join(F.sort_array("ns"), ", "))
    g = by_version.groupBy("image").agg(
        F.count(F.lit(1)).alias("n"), F.max("at").alias("detected"), F.sort_array(F.collect_list(F.struct("version", said.alias("t")))).alias("vs"),
        F.collect_list("as").alias("as"), F.collect_list("es").alias("es")).where("n >= 2")
    flat = lambda x: F.array_join(F.sort_array(F.array_distinct(F.flatten(x))), ", ")
    detail = F.concat("image", F.lit(" corre en "), F.col("n").cast("string"), F.lit(" versiones: "), F.array_join(F.transform("vs", lambda v: v["t"]), "; "), F.lit("."))
    return g.select(F.lit("imagen-version-distinta").alias("rule"), F.lit("baja").alias("severity"), flat("as").alias("assets"), flat("es").alias("envs"),
                    detail.alias("detail"), "detected")


def expected_ports(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or EXPECTED_PORTS, "env string, port int")


def findings(snapshots: DataFrame, expected: DataFrame | None = None, wanted_agent: str = "") -> DataFrame:
    """All five rules over the latest snapshots, worst first (K5)."""
    s = latest(snapshots)
    parts = [exposed_ports(s, expected if expected is not None else expected_ports(snapshots.sparkSession)), agent_versions(s, wanted_agent),
             sampling_intervals(s), root_containers(s), image_versions(s)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(F.col("severity") == "alta", 0).when(F.col("severity") == "media", 1).otherwise(2)
    return out.orderBy(rank, "rule", "detail")


def with_assets(findings_: DataFrame, keys: DataFrame, node: str = "node") -> DataFrame:
    """A snapshot that came before its node was known takes the asset now."""
    k = keys.select(F.col("key").alias(node), F.col("asset_id").alias("_a"))
    return findings_.join(k, node, "left").withColumn("asset_id", F.coalesce("asset_id", "_a", node)).drop("_a")
