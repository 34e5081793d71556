"""Column names, fixed values and schemas every module shares."""

from pyspark.sql import types as T

# ---- fixed values: these texts are stored in the data, so they stay as they are
TAGS = ("asset_id", "host_name", "service_name", "cloud_provider", "cloud_region", "deployment_environment")
TAG_ATTRIBUTE = {
    "host_name": "host.name",
    "service_name": "service.name",
    "cloud_provider": "cloud.provider",
    "cloud_region": "cloud.region",
    "deployment_environment": "deployment.environment",
}
NATIVE_KEYS = ("host.id", "host.name", "container.id", "service.instance.id")
UNKNOWN = "desconocido"
UNRESOLVED = "sin_resolver"
DEFAULT_SERVICE = "host"
UNNAMED = "sin_nombre"
RESERVED_WORDS = (
    "all and as asc between by case cast create delete desc distinct drop else end exists false from full group "
    "having in inner insert interval is join left like limit not null offset on or order outer right select set "
    "table then time timestamp true union update using value values when where with"
).split()
SPAN_KINDS = {0: "sin_definir", 1: "interno", 2: "servidor", 3: "cliente", 4: "productor", 5: "consumidor"}
SPAN_STATES = {0: "sin_definir", 1: "ok", 2: "error"}
TRUTH_FILE = "verdad.jsonl"
FAULT_TYPES = ("cpu", "memoria", "disco", "caida", "latencia")
TERMINAL_STATES = ("cerrada", "falso_positivo")
PROVIDER_PREFIX = {"digitalocean": "do", "aws": "aws", "azure": "azure", "proxmox": "onprem"}
# ---- end of fixed values

_s, _d, _l, _ts = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()
_map = T.MapType(_s, _s)


def _fields(*pairs):
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


_tags = [(t, _s) for t in TAGS]

METRIC_POINTS = _fields(("metric", _s), ("ts", _ts), ("time_ns", _l), ("value", _d), *_tags, ("dims", _map),
                        ("received_at", _ts), ("date", T.DateType()))
LOGS = _fields(("ts", _ts), ("time_ns", _l), *_tags, ("severity", _s), ("severity_num", T.ShortType()), ("body", _s),
               ("trace_id", _s), ("span_id", _s), ("attributes", _map), ("reassigned", T.BooleanType()))
SPANS = _fields(("start_ts", _ts), ("end_ts", _ts), ("duration_ns", _l), ("trace_id", _s), ("span_id", _s),
                ("parent_id", _s), ("name", _s), ("kind", _s), ("status", _s), ("status_message", _s), *_tags,
                ("attributes", _map), ("reassigned", T.BooleanType()))
PORT = _fields(("puerto", T.IntegerType()), ("protocolo", _s), ("direccion", _s), ("proceso", _s))
CONTAINER = _fields(("nombre", _s), ("imagen", _s), ("version", _s), ("usuario", _s))
EOF_DATE = "9999-12-31"
