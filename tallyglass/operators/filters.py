"""Combined filters, their metrics, and quick aggregates over the filtered rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.positions import Order, order_pairs, sort_columns
from .profile import per_column
from .roles import column_roles
from .timeseries import aggregate

# Above this many chosen values a semi join replaces the IN list.
IN_LIST_LIMIT = 1000


@dataclass(frozen=True)
class Filter:
    """A condition on one column with a readable label. Null cells never pass."""

    label: str
    column: str
    condition: Column | None = None
    members: tuple | None = None

    @staticmethod
    def num(col: str, low: float | None = None, high: float | None = None) -> Filter:
        tests = [F.col(col).isNotNull()]
        if low is not None:
            tests.append(F.col(col) >= low)
            if high is None:
                # NaN sorts above every number; an upper bound already shuts it out.
                tests.append(~F.isnan(F.col(col)))
        if high is not None:
            tests.append(F.col(col) <= high)
        return Filter(f"{col}: {low} to {high}", col, _all(tests))

    @staticmethod
    def isin(col: str, values: Sequence) -> Filter:
        chosen = tuple(dict.fromkeys(values))
        label = f"{col}: {len(chosen)} selected"
        if len(chosen) > IN_LIST_LIMIT:
            return Filter(label, col, members=chosen)
        return Filter(label, col, F.col(col).isin(*chosen))

    @staticmethod
    def date(col: str, first: dt.date | str, last: dt.date | str, inclusive_day: bool = True) -> Filter:
        """From ``first`` to ``last``; the whole last day, or only its midnight without ``inclusive_day``."""
        c, end = F.col(col), F.lit(str(last)).cast("date")
        upper = c < F.date_add(end, 1) if inclusive_day else c <= end
        return Filter(f"{col}: {first} to {last}", col, (c >= F.lit(str(first)).cast("date")) & upper)

    @staticmethod
    def contains(col: str, term: str, regex: bool = False) -> Filter:
        """Case-insensitive; plain text, or with ``regex`` a Java regular expression."""
        text = F.col(col).cast("string")
        hit = text.rlike(f"(?i){term}") if regex else F.contains(F.lower(text), F.lit(term.lower()))
        return Filter(f"{col} contains {term!r}", col, hit)


def _all(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    for f in filters:
        if f.members is None:
            df = df.filter(f.condition)
        else:
            chosen = df.sparkSession.createDataFrame([(m,) for m in f.members], [f.column])
            chosen = chosen.select(F.col(f.column).cast(df.schema[f.column].dataType))
            df = df.join(chosen, f.column, "left_semi")
    return df


def active_labels(filters: Sequence[Filter]) -> list[str]:
    return [f.label for f in filters]


def filter_metrics(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Matching rows, their share, rows removed, columns, and the first numeric column's filtered sum."""
    numeric = column_roles(df).numeric
    measure = F.col(numeric[0]) if numeric else F.lit(None).cast("double")
    if all(f.members is None for f in filters):
        passes = F.coalesce(_all([f.condition for f in filters]), F.lit(False)) if filters else F.lit(True)
        found = df.agg(
            F.count("*").alias("total"), F.count_if(passes).alias("matching"), F.sum(F.when(passes, measure)).alias("total_measure")
        )
    else:
        kept = apply_filters(df, filters).agg(F.count("*").alias("matching"), F.sum(measure).alias("total_measure"))
        found = kept.withColumn("total", df.agg(F.count("*")).scalar())
    share = F.col("matching") * 100.0 / F.greatest(F.col("total"), F.lit(1))
    return found.select(
        "matching",
        F.round(share, 1).alias("pct"),
        (F.col("total") - F.col("matching")).alias("filtered_out"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.coalesce("total_measure", F.lit(0)).cast("double").alias("total_measure"),
    )


def quick_agg(df: DataFrame, col: str, fn: str, by: str | None = None) -> DataFrame:
    """One aggregate over the rows, or per category with the largest first (null category left out)."""
    value = aggregate(col, fn).alias("value")
    if by is None:
        return df.agg(value)
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(value).orderBy(F.desc("value"), by)


def project_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def preview(df: DataFrame, order_by: str | Order | None = None, n: int = 500) -> DataFrame:
    """First ``n`` rows: by key, or whichever Spark reads first."""
    rows = df.orderBy(*sort_columns(order_pairs(order_by))) if order_by is not None else df
    return rows.limit(n)


def category_options(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def range_options(df: DataFrame) -> DataFrame:
    """Smallest and largest value of every numeric and date column, as text."""
    roles = column_roles(df)
    cols = [*roles.numeric, *roles.date]
    return per_column(
        df, {c: {"min": F.min(F.col(c)).cast("string"), "max": F.max(F.col(c)).cast("string")} for c in cols}
    )

