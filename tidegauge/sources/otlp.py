"""OTLP/JSON batches to points, logs and spans.

The schemas are fixed, so nothing is inferred, and the same functions serve
batch and stream frames (they only select and explode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import canonical_name, clean_dimensions, last_of_each
from ..functions.times import time_or_arrival
from ..functions.values import finite
from ..operators.catalog import resolve
from ..schema import SPAN_KINDS, SPAN_STATES, TAGS, TRUTH_FILE, UNRESOLVED

# array and kvlist values stay as the JSON text of the file, so nesting of any depth is kept
ANY = "struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,bytesValue:string,arrayValue:string,kvlistValue:string>"
ATTRS = f"array<struct<key:string,value:{ANY}>>"
_NUM = f"struct<attributes:{ATTRS},timeUnixNano:string,asDouble:string,asInt:string,flags:bigint,count:string,sum:string>"
_DATA = f"struct<dataPoints:array<{_NUM}>>"
_METRIC = (f"struct<name:string,gauge:{_DATA},sum:{_DATA},histogram:{_DATA},exponentialHistogram:{_DATA},summary:{_DATA}>")
_RESOURCE = f"resource:struct<attributes:{ATTRS}>"
METRICS = f"resourceMetrics array<struct<{_RESOURCE},scopeMetrics:array<struct<metrics:array<{_METRIC}>>>>>"
_LOG = (f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityText:string,severityNumber:int,body:{ANY},attributes:{ATTRS},"
        "traceId:string,spanId:string>")
LOGS = f"resourceLogs array<struct<{_RESOURCE},scopeLogs:array<struct<logRecords:array<{_LOG}>>>>>"
_SPAN = (f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,"
         f"attributes:{ATTRS},status:struct<code:int,message:string>>")
SPANS = f"resourceSpans array<struct<{_RESOURCE},scopeSpans:array<struct<spans:array<{_SPAN}>>>>>"


def read(spark: SparkSession, path: str, signal: str, stream: bool = False, **options) -> DataFrame:
    """One batch per line of text files, parsed by :func:`parsed`."""
    r = (spark.readStream if stream else spark.read).options(**options)
    return parsed(r.text(path), signal)


def parsed(lines: DataFrame, signal: str, text: str = "value") -> DataFrame:
    """Batches with the fixed schema; a line that does not parse keeps its text in ``_corrupt_record``."""
    name, rest = {"metrics": METRICS, "logs": LOGS, "spans": SPANS}[signal].split(" ", 1)
    schema = f"struct<{name}:{rest},_corrupt_record:string>"
    # inline() is a barrier: as plain columns the parse would be repeated for every field that is read
    b = lines.select(F.col(text).alias("_line"), F.inline(F.array(
        F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))))
    return b.select(name, F.when(F.col(name).isNull() | F.col("_corrupt_record").isNotNull(), F.col("_line")).alias("_corrupt_record"))


def _plain(j: Column, variant: str) -> Column:
    """JSON of nested AnyValues to plain JSON: the wrappers are removed, bytes go to hex."""
    # a list of scalars and a list of pairs are what senders produce; deeper nesting keeps the wrapper of the inner level
    if variant == "list":
        items = F.from_json(j, f"struct<values:array<{ANY}>>")["values"]
        return F.concat(F.lit("["), F.array_join(F.transform(items, _json_scalar), ", "), F.lit("]"))
    pairs = F.from_json(j, f"struct<values:array<struct<key:string,value:{ANY}>>>")["values"]
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(
        _quoted(p["key"]), F.lit(": "), _json_scalar(p["value"]))), ", "), F.lit("}"))


def _quoted(s: Column) -> Column:
    j = F.to_json(F.array(s))
    return F.when(s.isNotNull(), F.substr(j, F.lit(2), F.length(j) - 2))


def _json_scalar(v: Column) -> Column:
    return F.coalesce(_quoted(v["stringValue"]), v["boolValue"], v["intValue"], v["doubleValue"], _quoted(_hex(v["bytesValue"])),
                      v["arrayValue"], v["kvlistValue"], F.lit("null"))


def _hex(b: Column) -> Column:
    return F.lower(F.hex(F.try_to_binary(b, F.lit("base64"))))


def text_of(v: Column, python_words: bool = False) -> Column:
    """AnyValue to text. Booleans are ``true`` in JSON texts and ``True`` as dimension values."""
    flag = F.initcap(v["boolValue"]) if python_words else v["boolValue"]
    return F.coalesce(v["stringValue"], flag, v["intValue"], v["doubleValue"], _hex(v["bytesValue"]),
                      F.when(v["arrayValue"].isNotNull(), _plain(v["arrayValue"], "list")),
                      F.when(v["kvlistValue"].isNotNull(), _plain(v["kvlistValue"], "pairs")))


def attributes(a: Column, missing_as_empty: bool = False, python_words: bool = False) -> Column:
    """Attribute list to map; of a repeated key the last one stays."""
    def value(e):
        t = text_of(e["value"], python_words)
        return F.coalesce(t, F.lit("")) if missing_as_empty else t
    return last_of_each(F.transform(F.coalesce(a, F.array().cast(ATTRS)), lambda e: F.struct(e["key"].alias("key"), value(e).alias("value"))))


def metric_rows(batches: DataFrame, arrival: Column) -> DataFrame:
    """S1 + P4: one row per stored value, and one per point that stores none, with ``route``.

    valid / no_value (flag bit, missing, NaN, infinite, unknown kind) / error
    (time outside signed 64 bit). A histogram gives ``_count`` and, when the
    sum was sent, ``_sum``. If any value of a point is not finite the point is
    no_value. ``first`` marks one row per point, for counting.
    """
    m = batches.select(F.explode("resourceMetrics").alias("r")).select(
        attributes(F.col("r.resource.attributes")).alias("attrs"), F.explode("r.scopeMetrics").alias("s")).select(
        "attrs", F.explode("s.metrics").alias("m"))
    kinds = {"gauge": 0, "sum": 0, "histogram": 1, "exponentialHistogram": 1, "summary": 2}
    group = F.coalesce(*[F.when(F.col(f"m.{k}").isNotNull(), F.lit(v)) for k, v in kinds.items()], F.lit(-1))
    pts = F.coalesce(*[F.col(f"m.{k}.dataPoints") for k in kinds])
    one = F.array(F.lit(None).cast(_NUM))
    p = m.select("attrs", F.col("m.name").alias("name"), group.alias("g"),
                 F.explode(F.when(group == -1, one).otherwise(F.coalesce(pts, F.array().cast(f"array<{_NUM}>")))).alias("p"))
    num = lambda c: F.expr(f"try_cast(p.{c} as double)")
    plain = F.struct(F.lit("").alias("suffix"), F.coalesce(num("asDouble"), num("asInt")).alias("value"))
    count = F.struct(F.lit("_count").alias("suffix"), F.coalesce(num("count"), F.lit(0.0)).alias("value"))
    total = F.struct(F.lit("_sum").alias("suffix"), F.when(F.col("g") == 2, F.coalesce(num("sum"), F.lit(0.0))).otherwise(num("sum")).alias("value"))
    has_sum = (F.col("g") == 2) | F.col("p.sum").isNotNull()
    vals = F.when(F.col("g") == 0, F.array(plain)).when(has_sum, F.array(count, total)).otherwise(F.array(count))
    flagged = F.coalesce(F.col("p.flags").bitwiseAND(1) == 1, F.lit(False))
    wide = F.expr("try_cast(p.timeUnixNano as decimal(38,0))")
    bad_time = (wide < 0) | (wide >= F.lit(str(2 ** 63)).cast("decimal(38,0)"))
    void = flagged | (F.col("g") == -1) | F.exists(vals, lambda v: ~finite(v["value"]))
    # an integer beyond 64 bit fails try_cast to bigint and is an error, not an arrival time
    route = F.when(flagged | (F.col("g") == -1) | ((F.col("g") == 0) & vals[0]["value"].isNull()), "no_value").when(
        F.coalesce(bad_time, F.lit(False)), "error").when(void, "no_value").otherwise("valid")
    r = p.withColumn("route", route).withColumn("vals", F.when(route == "valid", vals).otherwise(F.array(F.struct(
        F.lit("").alias("suffix"), F.lit(None).cast("double").alias("value")))))
    ns = time_or_arrival(F.expr("try_cast(p.timeUnixNano as bigint)"), arrival)
    out = r.select("attrs", "name", "route", ns.alias("time_ns"), attributes(F.col("p.attributes"), python_words=True).alias("dims"),
                   F.posexplode("vals").alias("i", "v"))
    return out.select("attrs", "route", (F.col("i") == 0).alias("first"), F.concat(canonical_name("name"), "v.suffix").alias("metric"),
                      "time_ns", F.timestamp_micros(F.expr("time_ns div 1000")).alias("ts"), clean_dimensions(F.col("dims")).alias("dims"),
                      F.col("v.value").alias("value"), arrival.alias("received_at"))


def points(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Valid rows with their identity, in the stored schema."""
    r = resolve(rows.where("route = 'valid'"), keys)
    return r.select("metric", "ts", "time_ns", "value", *TAGS, "dims", "received_at", F.to_date("ts").alias("date"))


def log_rows(batches: DataFrame, arrival: Column) -> DataFrame:
    """Time is event time, else observed time, else arrival; ids in lower case."""
    r = batches.select(F.explode("resourceLogs").alias("r")).select(attributes(F.col("r.resource.attributes")).alias("attrs"),
                                                                    F.explode("r.scopeLogs").alias("s")).select("attrs", F.explode("s.logRecords").alias("l"))
    ns = lambda c: F.nullif(F.expr(f"try_cast(l.{c} as bigint)"), F.lit(0).cast("bigint"))
    t = time_or_arrival(F.coalesce(ns("timeUnixNano"), ns("observedTimeUnixNano")), arrival)
    text = lambda c: F.coalesce(c, F.lit(""))
    return r.withColumn("time_ns", t).select(
        "attrs", "time_ns", F.timestamp_micros(F.expr("time_ns div 1000")).alias("ts"), text(F.col("l.severityText")).alias("severity"),
        F.coalesce("l.severityNumber", F.lit(0)).cast("smallint").alias("severity_num"), text(text_of(F.col("l.body"))).alias("body"),
        F.lower(text(F.col("l.traceId"))).alias("trace_id"), F.lower(text(F.col("l.spanId"))).alias("span_id"),
        attributes(F.col("l.attributes"), True).alias("attributes"), F.lit(False).alias("reassigned"))


def span_rows(batches: DataFrame, arrival: Column) -> DataFrame:
    """S3: names for kind and status, duration at least 0 (0 when a time is missing), end defaults to start."""
    r = batches.select(F.explode("resourceSpans").alias("r")).select(attributes(F.col("r.resource.attributes")).alias("attrs"),
                                                                     F.explode("r.scopeSpans").alias("s")).select("attrs", F.explode("s.spans").alias("x"))
    ns = lambda c: F.coalesce(F.expr(f"try_cast(x.{c} as bigint)"), F.lit(0).cast("bigint"))
    name_of = lambda d, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in d.items() for y in kv]), c), F.lit(d[0]))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    a, z = ns("startTimeUnixNano"), ns("endTimeUnixNano")
    r = r.withColumn("_a", a).withColumn("_z", z)
    start = time_or_arrival(F.col("_a"), arrival)
    end = F.when(F.col("_z") != 0, F.col("_z")).otherwise(start)
    both = (F.col("_a") != 0) & (F.col("_z") != 0)
    return r.withColumn("_s", start).withColumn("_e", end).select(
        "attrs", F.timestamp_micros(F.expr("_s div 1000")).alias("start_ts"), F.timestamp_micros(F.expr("_e div 1000")).alias("end_ts"),
        F.when(both, F.greatest(F.lit(0).cast("bigint"), F.col("_z") - F.col("_a"))).otherwise(0).cast("bigint").alias("duration_ns"),
        F.lower(text("x.traceId")).alias("trace_id"), F.lower(text("x.spanId")).alias("span_id"), F.lower(text("x.parentSpanId")).alias("parent_id"),
        text("x.name").alias("name"), name_of(SPAN_KINDS, F.coalesce("x.kind", F.lit(0))).alias("kind"),
        name_of(SPAN_STATES, F.coalesce("x.status.code", F.lit(0))).alias("status"), text("x.status.message").alias("status_message"),
        attributes(F.col("x.attributes"), True).alias("attributes"), F.lit(False).alias("reassigned"))


def is_truth(attrs: Column, body: Column) -> Column:
    """S18."""
    shaped = F.startswith(body, F.lit("{")) & body.contains('"uid"') & body.contains('"evento"')
    return F.coalesce(attrs["log.file.name"] == TRUTH_FILE, F.lit(False)) | F.coalesce(shaped, F.lit(False))


TRUTH_BODY = ("struct<uid:string,evento:string,tipo:string,nodo:string,inicio:string,fin:string,estado:string,intensidad:string,"
              "parametros:map<string,string>,motivo:string,cierre:string>")


def truth_events(logs: DataFrame, seq: Column) -> DataFrame:
    """Fault events inside log bodies; other bodies are skipped, an unresolved asset is null."""
    b = logs.withColumn("b", F.explode(F.array(F.from_json("body", TRUTH_BODY, {"mode": "PERMISSIVE"})))).where(
        "b.uid is not null and b.evento in ('inicio', 'fin')")
    asset = F.when(F.col("asset_id").isin("", UNRESOLVED), None).otherwise(F.col("asset_id"))
    return b.select(F.col("b.uid").alias("uid"), F.col("b.evento").alias("event"), seq.alias("seq"), asset.alias("asset_id"),
                    F.col("b.tipo").alias("type"), F.col("b.nodo").alias("node"), F.col("b.inicio").alias("start_text"),
                    F.col("b.fin").alias("end_text"), F.col("b.estado").alias("end_state"), F.col("b.intensidad").alias("intensity"),
                    F.col("b.parametros").alias("params"), F.col("b.motivo").alias("reason"), F.col("b.cierre").alias("closing"))
