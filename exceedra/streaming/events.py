"""Events of a stream of daily exceedances: runs of days, closed by a gap or by the watermark."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
EVENT = "cell_id int, first date, last date, days int, middle date, em double"
_STATE = "first int, last int, em double, waiting array<int>, amounts array<double>"
_EPOCH = dt.date(1970, 1, 1)


def _date(n: int) -> dt.date:
    return _EPOCH + dt.timedelta(days=n)


def step(held: tuple, rows: list[tuple[int, float]], final: int) -> tuple[list[tuple[int, int, float]], tuple]:
    """Runs that end, and what stays open.

    ``held``: first and last day of the open run or None, its magnitude, and days that wait.
    ``rows``: exceedance days with their magnitudes; a day that comes again counts once, with
    the greater one.  Days before ``final`` can no longer arrive.
    """
    first, last, em, waiting = held
    waiting = dict(waiting)
    for day, m in rows:
        if last is None or day > last:
            waiting[day] = max(m, waiting.get(day, m))
    closed = []
    for day in sorted(d for d in waiting if d < final):
        m = waiting.pop(day)
        if first is not None and day == last + 1:
            last, em = day, em + m
            continue
        if first is not None:
            closed.append((first, last, em))
        first, last, em = day, day, m
    if first is not None and last + 1 < final:
        closed.append((first, last, em))
        first, last, em = None, None, 0.0
    return closed, (first, last, em, waiting)


def _update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    watermark = state.getCurrentWatermarkMs()
    final = max(-(-watermark // DAY_MS), 0) if watermark > 0 else -(10**9)  # days that begin before the watermark
    held: tuple = (None, None, 0.0, {})
    if state.exists:
        first, last, em, waiting, amounts = state.get
        held = (first, last, em, dict(zip(waiting, amounts, strict=True)))
    rows = []
    if not state.hasTimedOut:
        for f in frames:
            f = f[f["dtec"] == 1]
            rows += [(int(d), float(m)) for d, m in zip(f["day"], f["dtem"].fillna(0.0), strict=True)]
    closed, (first, last, em, waiting) = step(held, rows, final)
    if first is None and not waiting:
        if state.exists:
            state.remove()
    else:
        state.update((first, last, em, list(waiting), list(waiting.values())))
        wake = min([*waiting, *([] if last is None else [last + 1])])
        state.setTimeoutTimestamp(max(wake * DAY_MS + 1, watermark + 1))
    if closed:
        cell = None if pd.isna(key[0]) else int(key[0])
        yield pd.DataFrame([(cell, _date(a), _date(b), b - a + 1, _date((a + b) // 2), m) for a, b, m in closed], columns=["cell_id", "first", "last", "days", "middle", "em"])


def events(days: DataFrame, late: str = "3 days") -> DataFrame:
    """Events of a stream ``days (cell_id, ts, dtec, dtem)``, ``ts`` a day's midnight.

    A row for each run of exceedance days, when the day behind it can no longer arrive: its
    first, last and middle day and the magnitude in all.  Rows may be out of order by ``late``;
    later ones are dropped by the watermark.  A cell's state is its open run and the days
    within the delay, however long the stream is.
    """
    day = F.unix_date(F.to_date("ts")).alias("day")
    rows = days.withWatermark("ts", late).select("cell_id", "ts", day, F.col("dtec").cast("int").alias("dtec"), F.col("dtem").cast("double").alias("dtem"))
    return rows.groupBy("cell_id").applyInPandasWithState(_update, EVENT, _STATE, "append", "EventTimeTimeout")
