"""Period labels. W, M and Q periods are named by their last day; weeks end on Sunday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCIES = ("D", "W", "M", "Q")


def period_end(ts: Column, freq: str) -> Column:
    day = ts.cast("date")
    if freq == "D":
        return day
    if freq == "W":
        return F.date_add(F.trunc(day, "week"), 6)
    if freq == "M":
        return F.last_day(day)
    if freq == "Q":
        return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    raise ValueError(f"freq must be one of {FREQUENCIES}, not {freq!r}")


def period_sequence(first: Column, last: Column, freq: str) -> Column:
    """Every period label from ``first`` to ``last`` (both already labels of this frequency)."""
    if freq == "D":
        return F.sequence(first, last, F.expr("interval 1 day"))
    if freq == "W":
        return F.sequence(first, last, F.expr("interval 7 day"))
    unit, step = {"M": ("month", 1), "Q": ("quarter", 3)}[freq]
    starts = F.sequence(F.trunc(first, unit), F.trunc(last, unit), F.expr(f"interval {step} month"))
    return F.transform(starts, lambda d: F.last_day(F.add_months(d, step - 1)))


def period_name(ts: Column, period: str) -> Column:
    """``2024-05`` for M, ``2024Q2`` for Q, ``2024`` for Y."""
    if period == "M":
        return F.date_format(ts, "yyyy-MM")
    if period == "Q":
        return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))
    if period == "Y":
        return F.year(ts).cast("string")
    raise ValueError(f"period must be M, Q or Y, not {period!r}")
