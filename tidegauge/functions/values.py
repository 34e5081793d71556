"""Number formatting, severity names, address and image parsing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values
BYTE_METRICS = ("system_disk_io", "system_network_io", "system_filesystem_usage", "system_memory_usage",
                "system_paging_usage")
COUNTER_METRICS = ("system_disk_io", "system_network_io", "system_paging_operations", "traces_span_metrics_calls")
UNIT_OF = {"system_paging_operations": "op", "system_disk_operations": "op", "traces_span_metrics_calls": "llamadas"}
# ---- end of fixed values


def significant(x: Column, digits: int = 4) -> Column:
    """Round to significant digits; 0 stays 0."""
    exp = F.floor(F.log10(F.abs(x))).cast("int")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - exp)
    return F.when((x == 0) | x.isNull(), x).otherwise(F.round(x * scale) / scale)


def money(x: Column) -> Column:
    """Two decimals, half to even, on a decimal (never on a double)."""
    return F.bround(x, 2).cast("decimal(18,2)")


def _number(x: Column, places: int) -> Column:
    """Plain number text without trailing zeros."""
    text = F.format_string(f"%.{places}f", F.round(x, places))
    return F.regexp_replace(text, r"\.?0+$", "") if places else text


def value_text(metric: Column, value: Column, kind: Column) -> Column:
    """A value with its unit: percent for ``*_utilization``, bytes, or a count, per second for counters."""
    rate = F.when(kind.isin("acumulada", "medida"), kind == "acumulada").otherwise(metric.isin(*COUNTER_METRICS))
    tail = F.when(rate, F.lit("/s")).otherwise(F.lit(""))
    size = F.abs(value)
    g, m, k = 1024.0 ** 3, 1024.0 ** 2, 1024.0
    in_bytes = (F.when(size >= g, F.concat(_number(value / g, 2), F.lit(" GB")))
                .when(size >= m, F.concat(_number(value / m, 2), F.lit(" MB")))
                .when(size >= k, F.concat(_number(value / k, 2), F.lit(" KB")))
                .otherwise(F.concat(_number(value, 0), F.lit(" B"))))
    unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNIT_OF.items() for x in kv]), metric)
    return (F.when(value.isNull() | F.isnan(value), F.lit("sin dato"))
            .when(F.endswith(metric, F.lit("_utilization")),
                  F.concat(F.format_string("%.2f", F.round(value * 100, 2)), F.lit(" %")))
            .when(metric.isin(*BYTE_METRICS), F.concat(in_bytes, tail))
            .when(unit.isNotNull(), F.concat(_number(value, 2), F.lit(" "), unit, tail))
            .otherwise(F.concat(_number(value, 2), tail)))


def level_name(n: Column) -> Column:
    return (F.when(n >= 21, "Fatal").when(n >= 17, "Error").when(n >= 13, "Aviso").when(n >= 9, "Info")
            .when(n > 0, "Depuración").otherwise("Sin nivel"))


def image_parts(image: Column) -> Column:
    """``struct(base, version)``; only a colon after the last slash starts a version."""
    tagged = image.rlike(r":[^/]*$")
    return F.struct(F.when(tagged, F.regexp_replace(image, r":[^:/]*$", "")).otherwise(image).alias("base"),
                    F.when(tagged, F.regexp_extract(image, r":([^:/]*)$", 1)).otherwise("latest").alias("version"))


def address_parts(addr: Column) -> Column:
    """``0.0.0.0:22``, ``[::]:22``, ``*:22``, ``127.0.0.53%lo:53`` to ``struct(address, port)``."""
    host = F.regexp_replace(F.regexp_extract(addr, r"^(.*):\d+$", 1), r"^\[+|\]+$", "")
    host = F.regexp_replace(host, "%.*$", "")
    port = F.try_element_at(F.regexp_extract_all(addr, F.lit(r":(\d+)$"), F.lit(1)), F.lit(1)).cast("int")
    return F.struct(F.when(host.isin("*", ""), "0.0.0.0").otherwise(host).alias("address"), port.alias("port"))


def json_field(text: Column, path: str) -> Column:
    """Invalid JSON and missing fields are null."""
    return F.get_json_object(text, path)


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
