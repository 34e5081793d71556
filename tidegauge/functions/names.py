"""Name canonicalisation: metric, dimension, identifier and slug rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RESERVED_WORDS, TAGS, UNKNOWN, UNNAMED


def bound(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once.

    A column that is used several times inside nested conditions or lambdas is
    otherwise evaluated at every place it stands.
    """
    return F.try_element_at(F.transform(F.array(value), fn), F.lit(1))


def canonical_name(col) -> Column:
    """Metric name to table name. The cut to 63 comes before the reserved-word test.

    Replacing bad characters, collapsing and stripping underscores (and outer
    white space) come to one replacement of runs and one trim.
    """
    raw = F.lower(F.col(col) if isinstance(col, str) else col)

    def named(x):
        return bound(F.substring(F.when(F.substring(x, 1, 1) < "a", F.concat(F.lit("m_"), x)).otherwise(x), 1, 63),
                     lambda c: F.when(x == "", F.lit(UNNAMED)).when(c.isin(*RESERVED_WORDS), F.concat(c, F.lit("_x"))).otherwise(c))
    return bound(F.btrim(F.regexp_replace(raw, "[^a-z0-9]+", "_"), F.lit("_")), named)


def canonical_dimension(col) -> Column:
    """As :func:`canonical_name`; a name that clashes with a fixed column gets ``_dim``."""
    return bound(canonical_name(col), lambda x: F.when(x.isin("time", "value", *TAGS), F.concat(x, F.lit("_dim"))).otherwise(x))


def is_identifier(col) -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).rlike("^[a-z][a-z0-9_]{0,62}$"), F.lit(False))


def clean_value(v: Column) -> Column:
    """Dimension value: control characters to space, 1024 characters, no trailing backslash, trimmed."""
    x = F.substring(F.regexp_replace(v, r"[\x00-\x1f\x7f]", " "), 1, 1024)
    return bound(F.trim(F.regexp_replace(x, r"\\+$", "")), lambda y: F.when(y == "", F.lit(UNKNOWN)).otherwise(y))


def last_of_each(pairs: Column) -> Column:
    """Entries to a map; of a repeated key the last one stays (``map_from_entries`` alone fails on repeats)."""
    return bound(pairs, lambda ps: F.map_from_entries(F.filter(ps, lambda e, i: ~F.exists(
        F.slice(ps, i + 2, F.size(ps)), lambda o: o["key"] == e["key"]))))


def clean_dimensions(m: Column) -> Column:
    """Drop null and empty dimensions, canonicalise the names, clean the values; of equal names the last one stays."""
    kept = F.map_entries(F.map_filter(m, lambda k, v: v.isNotNull() & (v != "")))
    return last_of_each(F.transform(kept, lambda e: F.struct(canonical_dimension(e["key"]).alias("key"), clean_value(e["value"]).alias("value"))))


def dims_text(m: Column) -> Column:
    """Order-free text of a map: what groups and joins use, as maps cannot be keys."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(m))))


def series_key(metric="metric", dims="dims") -> Column:
    return F.xxhash64(F.col(metric), *[F.col(t) for t in TAGS], dims_text(F.col(dims)))


def fill_tag(col: Column, default: str = UNKNOWN) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def slug(col) -> Column:
    x = F.regexp_replace(F.lower(F.col(col) if isinstance(col, str) else col), "[^a-z0-9]+", "-")
    x = F.substring(F.regexp_replace(x, "^-|-$", ""), 1, 40)
    return F.when(x == "", F.lit("sin-nombre")).otherwise(x)


def key_kind(col: Column) -> Column:
    return F.when(F.instr(col, ":") > 0, F.lit("nativo")).otherwise(F.lit("host.name"))


def signal_key(metric: Column, filters: Column, group: Column) -> Column:
    """``metric[k=v, por d]`` with the filters in key order."""
    parts = F.transform(F.sort_array(F.map_entries(filters)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    parts = F.concat(parts, F.when(group.isNull(), F.array().cast("array<string>"))
                     .otherwise(F.array(F.concat(F.lit("por "), group))))
    return F.when(F.size(parts) == 0, metric).otherwise(
        F.concat(metric, F.lit("["), F.array_join(parts, ", "), F.lit("]")))


def model_version(window=60, z=3.5, run=3, floor=0.0) -> str:
    text = f"mad-v2 W={window} z={z} m={run}"
    return f"{text} piso={floor:.0%}" if floor else text
