"""Calendar resampling and the series operations on its result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import period_end, period_sequence

AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min, "std": F.stddev_samp}


def aggregate(c: str | Column, fn: str) -> Column:
    """Named aggregate as a pandas user expects it: the sum of nothing is 0."""
    x = F.col(c) if isinstance(c, str) else c
    if fn not in AGGREGATES:
        raise ValueError(f"fn must be one of {sorted(AGGREGATES)}, not {fn!r}")
    return F.coalesce(F.sum(x), F.lit(0)) if fn == "sum" else AGGREGATES[fn](x)


def ts_raw(df: DataFrame, date: str, cols: Sequence[str]) -> DataFrame:
    return df.select(date, *cols).filter(F.col(date).isNotNull()).orderBy(date)


def resample(df: DataFrame, date: str, cols: Sequence[str], freq: str, agg: str = "sum") -> DataFrame:
    """One row per calendar period from the first to the last, named by the period's last day.

    Empty periods sum (and count) to 0 and are null for the other aggregates.
    """
    dated = df.filter(F.col(date).isNotNull()).withColumn("period", period_end(F.col(date), freq))
    sums = dated.groupBy("period").agg(*[aggregate(c, agg).alias(c) for c in cols])
    span = sums.agg(F.min("period").alias("a"), F.max("period").alias("z")).filter("a IS NOT NULL")
    periods = span.select(F.explode(period_sequence(F.col("a"), F.col("z"), freq)).alias("period"))
    filled = periods.join(sums, "period", "left")
    if agg in ("sum", "count"):
        filled = filled.select("period", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])
    return filled.orderBy("period")


#: Periods a series may have. Its windows run in one task, which suits one row per period but not raw rows.
MOST_PERIODS = 1_000_000


def one_row_per_period(series: DataFrame, date: str) -> DataFrame:
    if series.select(date).limit(MOST_PERIODS + 1).count() > MOST_PERIODS:
        raise ValueError(f"a series has at most {MOST_PERIODS} periods; resample first, or use rolling_column for rows")
    return series


def rolling_average(series: DataFrame, cols: Sequence[str], windows: Sequence[int] = (3, 7), date: str = "period") -> DataFrame:
    """Trailing means over periods, null until the window is full. ``series`` is one row per period."""
    out = {}
    for c in cols:
        for size in windows:
            w = Window.orderBy(date).rowsBetween(1 - size, 0)
            out[f"{c}_{size}_period"] = F.when(F.count(c).over(w) == size, F.avg(c).over(w))
    return one_row_per_period(series, date).withColumns(out)


def pct_change(series: DataFrame, col: str, periods: int = 1, date: str = "period") -> DataFrame:
    """Change in percent against ``periods`` rows earlier; 12 on a monthly series is year over year."""
    before = F.lag(col, periods).over(Window.orderBy(date))
    change = (F.try_divide(F.col(col).cast("double"), before.cast("double")) - 1) * 100
    return one_row_per_period(series, date).withColumn(f"{col}_pct_change", F.round(change, 1))


def ohlc(df: DataFrame, ts: str, value: str, freq: str, id_cols: Sequence[str] = ()) -> DataFrame:
    """First, highest, lowest and last value of each period; of equal times, ``id_cols`` and then the value decide."""
    rows = df.filter(F.col(ts).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(period_end(F.col(ts), freq).alias("period")).agg(
        F.min_by(value, F.struct(ts, *id_cols, value)).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, F.struct(ts, *id_cols, value)).alias("close"),
    )


def ohlc_rows(df: DataFrame, date: str, open_: str, high: str, low: str, close: str) -> DataFrame:
    return df.select(date, open_, high, low, close).dropna().orderBy(date)
