"""Other inputs: labelled and evaluation CSV, invoices, provider listings, key files, configuration snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import parse_instant, parse_invoice_date
from ..operators.catalog import provider_of

# ---- fixed values
LABELLED = ("time string, activo string, cpu_user double, cpu_system double, cpu_wait double, carga_1m double, memoria_used double, "
            "disco_used_frac double, disco_bytes_s double, red_bytes_s double, paginacion_s double, procesos_running double, "
            "tasa_llamadas_pedidos double, tasa_llamadas_catalogo double, tasa_errores_pedidos double, ref_fase string, ref_uid string, ref_tipo_eval string")
AMOUNT_NAMES = ("usd", "amount", "cost")
MAX_BYTES, MAX_LINES = 2_000_000, 20_000
ALIVE = ("pending", "running", "stopping", "stopped")
# ---- end of fixed values


def labelled_rows(spark: SparkSession, path: str) -> DataFrame:
    """S11."""
    return spark.read.schema(LABELLED).csv(path, header=True).withColumn("time", parse_instant(F.col("time"))).withColumnRenamed("activo", "asset_id")


def fault_kind(kind: Column, params: Column) -> Column:
    """Disk faults are split by their mode, gradual by default; bad JSON is an empty object."""
    return F.when(kind == "disco", F.concat(F.lit("disco_"), F.coalesce(F.nullif(F.get_json_object(params, "$.modo"), F.lit("")), F.lit("gradual")))).otherwise(kind)


def injections_csv(spark: SparkSession, path: str) -> DataFrame:
    cols = "uid string, tipo string, nodo string, activo string, inicio string, fin string, intensidad string, parametros string, estado string"
    r = spark.read.schema(cols).csv(path, header=True, escape='"', enforceSchema=False)
    return r.select("uid", fault_kind(F.col("tipo"), F.col("parametros")).alias("type"), F.nullif("activo", F.lit("")).alias("asset_id"),
                    parse_instant(F.col("inicio")).alias("start"), parse_instant(F.col("fin")).alias("end"), F.col("estado").alias("state"))


def anomalies_csv(spark: SparkSession, path: str) -> DataFrame:
    cols = "id string, activo string, metrica string, dimensiones string, inicio string, fin string, estado string, severidad string, puntaje double, evidencia string, version_modelo string"
    r = spark.read.schema(cols).csv(path, header=True, escape='"', enforceSchema=False)
    return r.select(F.col("id").alias("anomaly_id"), F.col("activo").alias("asset_id"), F.col("metrica").alias("metric"),
                    F.from_json("dimensiones", "map<string,string>").alias("dims"), parse_instant(F.col("inicio")).alias("start"),
                    parse_instant(F.col("fin")).alias("end"), F.coalesce("estado", F.lit("")).alias("state"),
                    F.coalesce("version_modelo", F.lit("")).alias("model_version"))


# ---------------------------------------------------------------- invoices
def invoice_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, content, digest, bytes``. Files over 2 MB are refused, so one row stays small."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", F.sha2("content", 256).alias("digest"),
                                                             F.col("length").alias("bytes"))


def new_files(files: DataFrame, imported: DataFrame) -> DataFrame:
    """The same bytes are imported once, also when two files of one run are equal."""
    return files.join(imported.select("digest").distinct(), "digest", "left_anti").dropDuplicates(["digest"])


#: Stand-ins, from the private-use area, for a comma between cells and for a line end inside quotes.
CELL, BREAK = "\ue001", "\ue000"


def _marked(text):
    """A CSV text without its quotes. Cut at the quotes, every other piece was quoted; an empty piece between two of those is a
    doubled quote. A line end is put behind the text, so the last piece is never empty."""
    piece = lambda x, i: (F.when(i % 2 == 1, F.regexp_replace(x, "\r?\n", BREAK)).when((x == "") & (i > 0), F.lit('"'))
                          .otherwise(F.replace(x, F.lit(","), F.lit(CELL))))
    return F.array_join(F.transform(F.split(F.concat(text, F.lit("\n")), '"', -1), piece), "")


def invoice_charges(files: DataFrame, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> tuple[DataFrame, DataFrame]:
    """``(charges, refused)``. One bad amount refuses its whole file.

    The header is looked up by lower-case name; the amount column may be called
    usd, amount or cost. Cells are cut at commas outside quotes and lines at
    line ends outside quotes, so any number of columns in any order will do.
    """
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    lines = files.select("file", "digest", "bytes", F.when(F.col("bytes") <= max_bytes, F.split(_marked(text), "\r?\n")).alias("ls"))
    parse = lambda c: F.transform(F.split(c, CELL, -1), lambda x: F.replace(x, F.lit(BREAK), F.lit("\n")))
    head = lines.withColumn("head", F.transform(parse(F.try_element_at("ls", F.lit(1))), lambda x: F.lower(F.trim(x))))
    spot = lambda *names: F.coalesce(*[F.nullif(F.array_position("head", n), F.lit(0).cast("bigint")) for n in names])
    head = head.select("file", "digest", "bytes", "ls", spot(*AMOUNT_NAMES).alias("i_amount"), spot("description").alias("i_desc"),
                       spot("product").alias("i_prod"), spot("group_description").alias("i_group"), spot("start").alias("i_start"), spot("end").alias("i_end"))
    body = head.select("*", F.posexplode_outer(F.slice("ls", 2, F.greatest(F.lit(1), F.size("ls") - 1))).alias("n", "line_text")).drop("ls")
    body = body.withColumn("cells", parse(F.col("line_text")))
    cell = lambda i: F.trim(F.coalesce(F.try_element_at("cells", F.col(i).cast("int")), F.lit("")))
    full = F.exists("cells", lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    raw = F.regexp_replace(cell("i_amount"), "[$,]", "")
    body = body.where(full | F.col("line_text").isNull()).select(
        "file", "digest", "bytes", "i_amount", "i_desc", (F.col("n") + 2).alias("line"), raw.alias("raw"), full.alias("full"),
        F.expr("1").alias("one"), cell("i_prod").alias("product"), cell("i_group").alias("grp"), cell("i_desc").alias("descr"),
        parse_invoice_date(cell("i_start")).alias("start"), parse_invoice_date(cell("i_end")).alias("end")).withColumn(
        "amount", F.expr("try_cast(raw as decimal(14,4))"))
    why = body.groupBy("file", "digest").agg(
        F.max("bytes").alias("b"), F.count_if("full").alias("n"), F.bool_or(F.col("i_amount").isNull() | F.col("i_desc").isNull()).alias("no_cols"),
        F.min(F.when(F.col("full") & F.col("amount").isNull(), F.struct("line", "raw"))).alias("bad"))
    reason = (F.when(F.col("b") > max_bytes, "file over 2 MB").when(F.col("no_cols"), "missing columns")
              .when(F.col("n") > max_lines, "too many lines")
              .when(F.col("bad").isNotNull(), F.concat(F.lit("line "), F.col("bad.line").cast("string"), F.lit(": not a number"))))
    why = why.select("file", "digest", reason.alias("reason"))
    concept = F.coalesce(F.nullif(F.concat_ws(" · ", F.nullif("grp", F.lit("")), F.nullif("descr", F.lit(""))), F.lit("")), F.nullif("product", F.lit("")),
                         F.concat(F.lit("linea "), F.col("line").cast("string")))
    charges = body.where("full").join(why.where("reason is null").select("file"), "file", "left_semi").select(
        "file", "digest", "line", F.lit("digitalocean").alias("provider"), "product", F.col("grp").alias("group_text"), F.col("descr").alias("description"),
        concept.alias("concept"), "amount", F.lit("USD").alias("currency"), "start", "end")
    return charges, why.where("reason is not null")


# ---------------------------------------------------------------- provider listings
RESOURCE = ["provider", "native_id", "name", "region", "env"]


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Listing dumps, one JSON document per file, as ``value``."""
    return spark.read.text(path, wholetext=True)


def droplets(raw: DataFrame, text: str = "value", env: str | None = "lab", tag: str | None = None) -> DataFrame:
    """Pages of the droplet listing."""
    s = "struct<droplets:array<struct<id:bigint,name:string,status:string,size_slug:string,region:struct<slug:string>,tags:array<string>>>>"
    d = raw.select(F.explode(F.from_json(text, s)["droplets"]).alias("d"))
    if tag:
        d = d.where(F.array_contains("d.tags", tag))
    return d.select(F.lit("digitalocean").alias("provider"), F.concat(F.lit("droplet/"), F.col("d.id").cast("string")).alias("native_id"),
                    F.col("d.name").alias("name"), F.col("d.region.slug").alias("region"), F.lit(env).alias("env"))


def proxmox_vms(raw: DataFrame, text: str = "value", region: str = "local", env: str | None = "lab", tag: str | None = None) -> DataFrame:
    s = "struct<data:array<struct<id:string,name:string,status:string,node:string,vmid:bigint,template:int,tags:string>>>"
    d = raw.select(F.explode(F.from_json(text, s)["data"]).alias("d")).where("coalesce(d.template, 0) = 0")
    if tag:
        d = d.where(F.array_contains(F.split(F.coalesce("d.tags", F.lit("")), "[;,]"), tag))
    return d.select(F.lit("proxmox").alias("provider"), F.col("d.id").alias("native_id"),
                    F.coalesce(F.nullif("d.name", F.lit("")), F.col("d.id")).alias("name"), F.lit(region).alias("region"), F.lit(env).alias("env"))


def ec2_instances(raw: DataFrame, text: str = "value", region: str = "us-east-1", env: str | None = "lab", tag: tuple[str, str] | None = None) -> DataFrame:
    s = "struct<Reservations:array<struct<Instances:array<struct<InstanceId:string,InstanceType:string,State:struct<Name:string>,Tags:array<struct<Key:string,Value:string>>>>>>>"
    d = raw.select(F.explode(F.from_json(text, s)["Reservations"]).alias("r")).select(F.explode("r.Instances").alias("d"))
    d = d.where(F.col("d.State.Name").isin(*ALIVE))
    if tag:
        d = d.where(F.exists("d.Tags", lambda t: (t["Key"] == tag[0]) & (t["Value"] == tag[1])))
    name = F.try_element_at(F.filter("d.Tags", lambda t: (t["Key"] == "Name") & (t["Value"] != "")), F.lit(1))["Value"]
    return d.select(F.lit("aws").alias("provider"), F.concat(F.lit("instancia/"), "d.InstanceId").alias("native_id"),
                    F.coalesce(name, "d.InstanceId").alias("name"), F.lit(region).alias("region"), F.lit(env).alias("env"))


def azure_vms(raw: DataFrame, text: str = "value", env: str | None = "lab", tag: tuple[str, str] | None = None) -> DataFrame:
    s = "struct<value:array<struct<id:string,name:string,location:string,tags:map<string,string>,properties:struct<vmId:string,hardwareProfile:struct<vmSize:string>>>>>"
    d = raw.select(F.explode(F.from_json(text, s)["value"]).alias("d"))
    if tag:
        d = d.where(F.col("d.tags")[tag[0]] == tag[1])
    return d.select(F.lit("azure").alias("provider"), F.concat(F.lit("vm/"), F.coalesce("d.properties.vmId", "d.id")).alias("native_id"),
                    F.col("d.name").alias("name"), F.col("d.location").alias("region"), F.lit(env).alias("env"))


def key_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object key -> asset, as rows for a manual admission."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "asset_id")).select(
        "key", "asset_id", provider_of(F.col("asset_id")).alias("provider"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("env"))


# ---------------------------------------------------------------- configuration snapshots
SNAPSHOT = ("nodo string, entorno string, tomada_en string, version_agente string, intervalo_muestreo_s string, "
            "puertos array<struct<puerto:string,protocolo:string,direccion:string,proceso:string>>, "
            "contenedores array<struct<nombre:string,imagen:string,version:string,usuario:string>>")


def snapshots(raw: DataFrame, text: str, keys: DataFrame, seq: Column) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` from JSON texts; the rules of type, length and range are one boolean."""
    d = raw.withColumn("_seq", seq).withColumn("s", F.explode(F.array(F.from_json(text, SNAPSHOT, {"mode": "PERMISSIVE"}))))
    fit = lambda c, n, need=True: (F.length(F.coalesce(c, F.lit(""))) <= n) & ((F.coalesce(c, F.lit("")) != "") if need else F.lit(True))
    secs = F.expr("try_cast(s.intervalo_muestreo_s as int)")
    # the JSON type matters: a quoted number or a boolean is not an integer
    whole = F.regexp_like(F.get_json_object(text, "$.intervalo_muestreo_s"), F.lit(r"^-?\d+$")) & ~F.regexp_like(
        F.col(text), F.lit(r'"intervalo_muestreo_s"\s*:\s*"'))
    ports, conts = F.coalesce("s.puertos", F.array().cast("array<struct<puerto:string,protocolo:string,direccion:string,proceso:string>>")), \
        F.coalesce("s.contenedores", F.array().cast("array<struct<nombre:string,imagen:string,version:string,usuario:string>>"))
    is_list = lambda f: F.coalesce(F.startswith(F.get_json_object(text, f"$.{f}"), F.lit("[")), F.lit(True))
    port_no = lambda p: F.try_to_number(p["puerto"], F.lit("999999")).cast("int")
    ok_port = F.forall(ports, lambda p: F.coalesce(port_no(p).between(1, 65535), F.lit(False)) & fit(p["protocolo"], 8) & fit(p["direccion"], 64) & fit(p["proceso"], 120, False))
    ok_cont = F.forall(conts, lambda c: fit(c["nombre"], 200) & fit(c["imagen"], 300) & fit(c["version"], 128, False) & fit(c["usuario"], 64, False))
    taken = parse_instant(F.col("s.tomada_en"))
    ok = (F.col("s").isNotNull() & fit(F.col("s.nodo"), 120) & fit(F.col("s.entorno"), 60) & taken.isNotNull() & fit(F.col("s.version_agente"), 60, False)
          & secs.between(1, 3600) & whole & (F.size(ports) <= 2000) & (F.size(conts) <= 500) & is_list("puertos") & is_list("contenedores") & ok_port & ok_cont)
    d = d.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    k = keys.select(F.col("key").alias("node"), "asset_id")
    good = d.where("_ok").select(
        F.col("s.nodo").alias("node"), F.col("s.entorno").alias("env"), taken.alias("taken_at"), F.col("_seq").alias("seq"),
        F.coalesce("s.version_agente", F.lit("")).alias("agent_version"), secs.alias("interval_s"),
        F.transform(ports, lambda p: F.struct(port_no(p).alias("puerto"), p["protocolo"].alias("protocolo"), p["direccion"].alias("direccion"),
                                              F.coalesce(p["proceso"], F.lit("")).alias("proceso"))).alias("ports"),
        F.transform(conts, lambda c: F.struct(c["nombre"].alias("nombre"), c["imagen"].alias("imagen"), F.coalesce(c["version"], F.lit("")).alias("version"),
                                              F.coalesce(c["usuario"], F.lit("")).alias("usuario"))).alias("containers"))
    return good.join(k, "node", "left"), d.where("not _ok").select(F.col(text).alias("line"), F.lit("invalid snapshot").alias("error"))
