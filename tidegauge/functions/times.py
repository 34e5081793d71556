"""Time parsing, alignment and texts. Everything is UTC."""

from datetime import datetime, timedelta, timezone
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd HH:mm:ss"


def bucket(ts: Column, seconds: int) -> Column:
    """Epoch-aligned start of the bucket that holds ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * F.lit(seconds))


def bucket_ceil(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.ceil(F.unix_micros(ts) / F.lit(1000000 * seconds)) * F.lit(seconds))


def floor_py(t: datetime, seconds: int) -> datetime:
    return datetime.fromtimestamp(int(t.timestamp()) // seconds * seconds, timezone.utc)


def ceil_py(t: datetime, seconds: int) -> datetime:
    return datetime.fromtimestamp(-(-int(t.timestamp()) // seconds) * seconds, timezone.utc)


def as_lit(t: datetime) -> Column:
    """A literal that does not depend on the machine's zone."""
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    micros = (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def nano_text(ns: Column) -> Column:
    """``YYYY-MM-DD hh:mm:ss.nnnnnnnnn``; no nanosecond is lost."""
    secs = F.floor(ns / F.lit(10 ** 9)).cast("bigint")
    # the double division above may round near a second, so the remainder decides
    rem = F.pmod(ns, F.lit(10 ** 9))
    secs = ((ns - rem) / F.lit(10 ** 9)).cast("bigint")
    return F.concat(F.date_format(F.timestamp_seconds(secs), ISO), F.lit("."), F.lpad(rem.cast("string"), 9, "0"))


def time_or_arrival(ns: Column, arrival: Column) -> Column:
    """0 or absent event time means the arrival time."""
    return F.coalesce(F.nullif(ns, F.lit(0).cast("bigint")), F.unix_micros(arrival) * 1000)


def parse_instant(col: Column, require_zone: bool = False) -> Column:
    """ISO text with ``Z``, a space, ``+00`` or ``+00:00``; null when it does not parse.

    Without a zone the text is UTC, unless ``require_zone``: then it is null.
    """
    x = F.trim(col)
    x = F.regexp_replace(F.regexp_replace(x, "Z$", "+00:00"), "^(\\S+) ", "$1T")
    x = F.regexp_replace(x, r"(T.*[+-]\d{2})$", "$1:00")
    x = F.when(x.rlike(r"T.*[+-]\d{2}:\d{2}$"), x).otherwise(
        F.lit(None) if require_zone else F.concat(F.when(x.contains("T"), x).otherwise(F.concat(x, F.lit("T00:00:00"))),
                                                  F.lit("+00:00")))
    return F.try_to_timestamp(x)


def parse_invoice_date(col: Column) -> Column:
    """The four invoice formats, else ISO; null when none fits."""
    x = F.nullif(F.trim(col), F.lit(""))
    fits = x.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?( ?[+-]\d{2}:?\d{2}|Z)?)?$")
    return F.when(fits, F.try_to_timestamp(F.substring(x, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def duration_seconds(col: Column) -> Column:
    """``30d`` and ``12h`` to seconds; any other text is null."""
    x = F.lower(F.trim(col))
    n = F.try_element_at(F.regexp_extract_all(x, F.lit(r"^(\d+)[dh]$"), F.lit(1)), F.lit(1)).cast("bigint")
    return n * F.when(F.endswith(x, F.lit("d")), 86400).otherwise(3600)


def interval_seconds(col: Column) -> Column:
    """Sampling interval text (``10s``, ``1m``, ``500ms``) to whole seconds, at least 1; unreadable is 10."""
    x = F.trim(col)
    n = F.try_element_at(F.regexp_extract_all(x, F.lit(r"^(\d+)\s*(?:ms|s|m|h)?$"), F.lit(1)), F.lit(1)).cast("bigint")
    unit = F.regexp_extract(x, r"(ms|s|m|h)?$", 1)
    secs = F.when(unit == "ms", F.floor(n / 1000)).when(unit == "m", n * 60).when(unit == "h", n * 3600).otherwise(n)
    return F.when(n.isNull(), F.lit(10)).otherwise(F.greatest(F.lit(1), secs)).cast("bigint")


def hours_minutes(seconds: Column) -> Column:
    """``2 h 05 min`` or ``7 min``; minutes round half to even."""
    m = F.bround(seconds / 60).cast("bigint")
    h, rest = F.floor(m / 60).cast("string"), F.pmod(m, F.lit(60)).cast("string")
    return F.when(m >= 60, F.concat(h, F.lit(" h "), F.lpad(rest, 2, "0"), F.lit(" min"))).otherwise(
        F.concat(m.cast("string"), F.lit(" min")))


def relative_text(ts: Column, now: Column) -> Column:
    """``hace 5 min``; whole units, rounded half up."""
    s = F.round((F.unix_micros(now) - F.unix_micros(ts)) / 1000000).cast("bigint")
    say = lambda unit, d: F.concat(F.lit("hace "), F.round(s / d).cast("bigint").cast("string"), F.lit(unit))
    return (F.when(ts.isNull(), "nunca").when(s < 0, "ahora").when(s < 60, say(" s", 1)).when(s < 3600, say(" min", 60))
            .when(s < 86400, say(" h", 3600)).otherwise(say(" d", 86400)))


def range_fault(start: Column, end: Column, max_days: int, limit: Column | None = None, max_limit: int = 2000) -> Column:
    """P10 over a table of requests: why :func:`check_range` refuses one; null if it doesn't."""
    out = F.when(end <= start, "empty range").when(end - start > F.expr(f"interval {max_days} days"), f"range longer than {max_days} days")
    return out if limit is None else out.when(limit.isNotNull() & ~limit.between(1, max_limit), f"limit must be between 1 and {max_limit}")


def check_range(start: datetime, end: datetime, max_days: int, limit: int | None = None, max_limit: int = 2000) -> None:
    """Empty, too long and out-of-limit requests are refused before any job starts."""
    if end <= start:
        raise ValueError("empty range")
    if end - start > timedelta(days=max_days):
        raise ValueError(f"range longer than {max_days} days")
    if limit is not None and not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be between 1 and {max_limit}")


def check_trace_id(trace_id: str) -> None:
    if not re.fullmatch("[0-9a-f]{32}", trace_id):
        raise ValueError("a trace id is 32 lower-case hexadecimal characters")
