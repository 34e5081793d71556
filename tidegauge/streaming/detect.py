"""The detection cycle as keyed state (T5) and the silence timer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import MAD_SCALE, RUN, WINDOW, Z_CRITICAL
from ..operators.incidents import CALM_POINTS, CLOSING_FLOOR

STATE = "ring array<double>, run int, last bigint, med double, scale double, start bigint, calm array<bigint>, calm_from bigint"
OUT = "series string, event string, ts timestamp, z double, med double, scale double, end timestamp"


def frozen(history: list[float], floor: float) -> tuple[float, float | None]:
    """The baseline of a full window: median, and 1.4826 MAD, else population deviation, not below the floor."""
    x = np.asarray(history)
    med = float(np.median(x))
    mad = float(np.median(np.abs(x - med))) * MAD_SCALE
    scale = max(mad if mad > 0 else float(x.std()), floor)
    return med, scale if scale > 0 else None


class Cycle(StatefulProcessor):
    """Per series: the last 60 values, the critical run, and the open anomaly with its frozen baseline.

    The state is a fixed number of values per series. Each point first tries
    to close, then to open; while one is open no other opens. It closes when the
    last ``calm`` points are normal and lie within ``calm`` steps. A point that is
    not newer than the series' last one comes out as a ``late`` event, so none
    is lost unseen; the batch operators take it in.
    """

    def __init__(self, window: int = WINDOW, run: int = RUN, calm: int = CALM_POINTS, step: int = 60, ttl_days: int | None = None):
        self.window, self.need, self.calm_need, self.step_us, self.ttl_days = window, run, calm, step * 1_000_000, ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.ttl_days * 86_400_000} if self.ttl_days else {}
        self.state = handle.getValueState("series", STATE, **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("ts")
        s = self.state.get() if self.state.exists() else None
        ring, run, last, med, scale, start, calm, calm_from = (list(s[0]), *s[1:6], list(s[6]), s[7]) if s else ([], 0, None, None, None, None, [], None)
        out = []
        for ts, v, floor in zip(pdf["ts"], pdf["value"], pdf["floor"]):
            us = ts.value // 1000
            if last is not None and us <= last:
                out.append((key[0], "late", ts, None, None, None, None))
                continue
            if start is not None:
                wide = max(scale, CLOSING_FLOOR * abs(med))
                if (v - med) / wide < Z_CRITICAL:
                    fresh = not calm or us - last > 2 * self.step_us
                    calm, calm_from = ([us], us) if fresh else ([*calm, us][-self.calm_need:], calm_from)
                else:
                    calm = []
                if len(calm) >= self.calm_need and us - calm[0] <= self.calm_need * self.step_us:
                    out.append((key[0], "close", pd.Timestamp(start, unit="us"), None, med, scale, pd.Timestamp(calm_from, unit="us")))
                    start, calm = None, []
            crit = False
            if len(ring) == self.window:
                m, sc = frozen(ring, floor)
                z = 0.0 if sc is None else (v - m) / sc
                crit = z >= Z_CRITICAL
            run = run + 1 if crit else 0
            if run == self.need and start is None:
                start, med, scale, calm = us, m, sc, []
                out.append((key[0], "open", ts, z, m, sc, None))
            ring = [*ring, float(v)][-self.window:]
            last = us
        self.state.update((ring, run, last, med, scale, start, calm, calm_from))
        cols = ["series", "event", "ts", "z", "med", "scale", "end"]
        yield pd.DataFrame(out, columns=cols).astype({"z": "float64", "med": "float64", "scale": "float64", "ts": "datetime64[ns]", "end": "datetime64[ns]"})

    def close(self) -> None:
        pass


def cycle(points: DataFrame, series: str = "series", floor: float = 0.0, **settings) -> DataFrame:
    """``points``: series, ts, value, one per ``step``, and where signals differ a ``floor`` of their own. A stream with the
    RocksDB state store, or a batch frame. With ``ttl_days`` the state of a series that went silent is dropped.

    State stores report to a coordinator that a session only starts with its manager of streaming queries. A batch frame starts
    no such query, so the manager is asked for here.
    """
    points.sparkSession.streams.active  # noqa: B018
    own = F.coalesce(F.col("floor").cast("double"), F.lit(floor)) if "floor" in points.columns else F.lit(floor)
    return points.select(series, "ts", "value", own.alias("floor")).groupBy(series).transformWithStateInPandas(
        statefulProcessor=Cycle(**settings), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if settings.get("ttl_days") else "None")


def silent(ledger: DataFrame, as_of=None) -> DataFrame:
    """The one-minute batch form of the heart-beat: sources whose last ARRIVAL is over five minutes old."""
    from ..operators.health import SILENT_AFTER
    now = as_of if as_of is not None else F.current_timestamp()
    return ledger.where(now - F.col("last_seen") > F.expr(SILENT_AFTER))
