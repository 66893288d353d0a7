"""Automatic overview: leading totals, the clearest category, a breakdown and a trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charts import top_categories
from .profile import distinct_stats, per_column
from .roles import column_roles, looks_like_key
from .timeseries import resample, ts_raw


def kpi_cards(df: DataFrame, n: int = 5, cols: Sequence[str] | None = None) -> DataFrame:
    """The ``n`` numeric columns, of all or of ``cols``, with the largest totals."""
    fields = {}
    for c in column_roles(df).numeric if cols is None else cols:
        x = F.col(f"`{c}`").cast("double")
        fields[c] = {"total": F.coalesce(F.sum(x), F.lit(0.0)), "mean": F.avg(x), "records": F.count(x)}
    return per_column(df, fields).orderBy(F.desc("total"), "column").limit(n)


def leading_measure(df: DataFrame) -> str:
    """The numeric column with the largest total. Keys, whose totals grow with the square of the rows, count only where nothing else is numeric."""
    numeric = column_roles(df).numeric
    return kpi_cards(df, 1, [c for c in numeric if not looks_like_key(c)] or numeric).first()["column"]


def auto_top_categories(df: DataFrame, n: int = 15) -> DataFrame:
    """Total of the leading measure by the category with the fewest (but at least two) values."""
    roles = column_roles(df)
    kpi = leading_measure(df)
    order = F.array_position(F.lit(roles.categorical), F.col("column"))
    chosen = distinct_stats(df, roles.categorical).orderBy(F.col("distinct") <= 1, "distinct", order).first()["column"]
    return top_categories(df, chosen, kpi, n).select(
        F.lit(chosen).alias("category"), F.col(chosen).cast("string").alias("label"), F.lit(kpi).alias("measure"), "total"
    )


def auto_trend(df: DataFrame, freq: str | None = "W") -> DataFrame:
    """Sums of the leading measure per period of the first date column, or with ``freq=None`` its single values."""
    roles = column_roles(df)
    date, kpi = roles.date[0], leading_measure(df)
    rows = df.select(date, kpi).dropna()
    return ts_raw(rows, date, [kpi]) if freq is None else resample(rows, date, [kpi], freq)
