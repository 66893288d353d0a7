"""Computed columns: formulas, bins, ranks, scaling, rolling windows, shares and lags."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import edges_below, right_closed_bin
from ..plans.joins import salted_join, with_summary
from ..plans.positions import ROWS_PER_TASK, Order, join_null_safe, order_pairs, split_by_order, window_column
from ..plans.quantiles import exact_quantiles
from ..plans.sampling import sample_rows
from .distributions import histogram


def formula(df: DataFrame, name: str, expression: str) -> DataFrame:
    """A Spark SQL expression over the columns; use ``try_divide`` where a divisor may be zero."""
    return df.withColumn(name, F.expr(expression))


def bin_equal_width(df: DataFrame, col: str, n: int, name: str | None = None) -> DataFrame:
    """Right-closed bins 0..n-1 of equal width between the finite values, the first edge lowered by a thousandth of the range.

    Missing and infinite values are in no bin.
    """
    x = F.col(col).cast("double")
    finite = F.when(F.abs(x) < math.inf, x)
    low, high = (F.lit(v).cast("double") for v in df.agg(F.min(finite), F.max(finite)).first())
    flat = low == high
    # Widening of the outer edges, relative to the range or to a constant's size.
    pad = F.when(low == 0, F.lit(0.001)).otherwise(F.abs(low) * 0.001)
    start, stop = F.when(flat, low - pad).otherwise(low), F.when(flat, high + pad).otherwise(high)
    step = (stop - start) / n
    first = F.when(flat, start).otherwise(low - (high - low) * 0.001)
    edges = [first, *[F.lit(float(i)) * step + start for i in range(1, n)], stop]
    return df.withColumn(name or f"{col}_bin", right_closed_bin(finite, edges))


def quantile_edges(df: DataFrame, col: str, probabilities: Sequence[float]) -> list[float]:
    found = exact_quantiles(df, {col: probabilities})[col]
    return sorted({v for v in found if v is not None})


def bin_quantile(df: DataFrame, col: str, q: int, name: str | None = None) -> DataFrame:
    """Right-closed bins between the q-quantiles, lowest value included, repeated edges dropped."""
    edges = quantile_edges(df, col, [i / q for i in range(q + 1)])
    x = F.col(col).cast("double")
    index = F.lit(None).cast("long") if len(edges) < 2 else F.when(x.isNotNull(), F.greatest(edges_below(x, edges[:-1]) - 1, F.lit(0)))
    return df.withColumn(name or f"{col}_bin", index.cast("long"))


def bin_custom(df: DataFrame, col: str, edges: Sequence[float], name: str | None = None) -> DataFrame:
    """Right-closed bins between given edges; null outside them."""
    return df.withColumn(name or f"{col}_bin", right_closed_bin(F.col(col).cast("double"), [float(e) for e in edges]))


def bin_preview(df: DataFrame, bin_col: str) -> DataFrame:
    return df.filter(F.col(bin_col).isNotNull()).groupBy(bin_col).agg(F.count("*").alias("count")).orderBy(bin_col)


RANK_METHODS = ("average", "min", "max", "dense", "ordinal")


def rank_column(
    df: DataFrame,
    col: str,
    method: str = "average",
    ascending: bool = False,
    partition_by: Sequence[str] = (),
    id_cols: Sequence[str] = (),
    name: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rank of ``col``, null for null. ``ordinal`` breaks ties by ``id_cols``, which should be unique.

    Where a group is too large for one task, ordinal ranks are taken in ordered buckets (see ``plans.positions``). The
    others then follow from the number of rows of each value, so that no rows are sorted, and are joined back by value.
    """
    if method not in RANK_METHODS:
        raise ValueError(f"method must be one of {RANK_METHODS}, not {method!r}")
    if method == "ordinal" and not id_cols:
        raise ValueError("ordinal ranks need id_cols to break ties")
    name, parts = name or f"{col}_rank", list(partition_by)
    known = df.filter(F.col(col).isNotNull())
    lead = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    if method == "ordinal":
        split = split_by_order(known, [(col, ascending), *[(c, True) for c in id_cols]], parts, rows_per_task)
        divided = split.divided
    else:
        sizes = known.groupBy(*parts).agg(F.count("*").alias("_n"))
        divided = (sizes.agg(F.max("_n")).first()[0] or 0) > rows_per_task
    if not divided:
        by_value = Window.partitionBy(*parts).orderBy(lead)
        by_row = Window.partitionBy(*parts).orderBy(lead, *id_cols)
        peers = F.count(col).over(by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        value = _rank(method, F.rank().over(by_value), peers, F.dense_rank().over(by_value), F.row_number().over(by_row))
        return df.withColumn(name, F.when(F.col(col).isNotNull(), value))
    if method == "ordinal":
        rows = split.attach(split.rows, split.offsets(F.count("*")))
        rank = (F.col("_start") + F.row_number().over(split.window())).cast("long")
        ranked = rows.withColumn(name, rank).select(*df.columns, name)
    else:
        frame = _ranks_by_value(known, col, method, ascending, parts, rows_per_task).withColumnRenamed("_rank", name)
        ranked = join_null_safe(known.drop(name), frame, [*parts, col]).select(*[c for c in df.columns if c != name], name)
    kind = ranked.schema[name].dataType
    return ranked.unionByName(df.filter(F.col(col).isNull()).withColumn(name, F.lit(None).cast(kind)))


def _ranks_by_value(known: DataFrame, col: str, method: str, ascending: bool, parts: Sequence[str], rows_per_task: int) -> DataFrame:
    """One row per group and value with its rank, from running totals of the rows per value."""
    counts = known.groupBy(*parts, col).agg(F.count("*").alias("_n"))
    split = split_by_order(counts, [(col, ascending)], parts, rows_per_task)
    rows, before = split.rows, F.lit(0)
    if split.divided:
        rows, before = split.attach(rows, split.offsets(F.count("*") if method == "dense" else F.sum("_n"))), F.col("_start")
    upto = before + F.sum("_n").over(split.window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dense = before + F.row_number().over(split.window())
    return rows.select(*parts, col, _rank(method, upto - F.col("_n") + 1, upto, dense, dense).alias("_rank"))


def _rank(method: str, lowest: Column, highest: Column, dense: Column, ordinal: Column) -> Column:
    if method == "average":
        return (lowest + highest) / 2.0
    return {"min": lowest, "max": highest, "dense": dense, "ordinal": ordinal}[method].cast("long")


def scale(df: DataFrame, col: str, method: str, name: str | None = None) -> DataFrame:
    x, rows = F.col(col).cast("double"), df
    if method == "minmax":
        rows = with_summary(df, "_s", df.agg(F.struct(F.min(x).alias("a"), F.max(x).alias("b"))))
        value = F.try_divide(x - F.col("_s.a"), F.col("_s.b") - F.col("_s.a"))
    elif method == "zscore":
        rows = with_summary(df, "_s", df.agg(F.struct(F.avg(x).alias("a"), F.stddev_samp(x).alias("b"))))
        value = F.try_divide(x - F.col("_s.a"), F.col("_s.b"))
    elif method == "log":
        value = F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))
    elif method == "sqrt":
        value = F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))
    else:
        raise ValueError("method must be minmax, zscore, log or sqrt")
    return rows.withColumn(name or f"{col}_norm", value).drop("_s")


def before_after(df: DataFrame, before: str, after: str, bins: int = 30) -> DataFrame:
    first = histogram(df, before, bins).withColumn("side", F.lit("before"))
    return first.unionByName(histogram(df, after, bins).withColumn("side", F.lit("after")))


ROLLING = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}


def rolling_column(
    df: DataFrame,
    col: str,
    window: int,
    fn: str,
    order_by: str | Order,
    partition_by: Sequence[str] = (),
    name: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Trailing window of ``window`` rows, null until it holds that many non-null values."""
    if fn not in ROLLING:
        raise ValueError(f"fn must be one of {sorted(ROLLING)}, not {fn!r}")

    def build(w):
        frame = w.rowsBetween(1 - window, 0)
        return F.when(F.count(col).over(frame) == window, ROLLING[fn](col).over(frame))

    return window_column(
        df, name or f"{col}_rolling_{fn}", build, order_by, partition_by, window - 1, [col], rows_per_task
    )


def lag_column(
    df: DataFrame,
    col: str,
    k: int,
    order_by: str | Order,
    partition_by: Sequence[str] = (),
    name: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Value ``k`` rows earlier in the order."""
    return window_column(
        df, name or f"{col}_lag{k}", lambda w: F.lag(col, k).over(w), order_by, partition_by, k, [col], rows_per_task
    )


def pct_of_total(
    df: DataFrame,
    col: str,
    by: str | None = None,
    id_cols: Sequence[str] = (),
    name: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Share of the column total, or of the group total (null in a null group).

    Group totals are pre-aggregated and joined back with hot groups salted over ``id_cols``.
    """
    name, x = name or f"{col}_pct", F.col(col).cast("double")
    if by is None:
        return df.withColumn(name, F.try_divide(x, df.agg(F.sum(x)).scalar()) * 100)
    totals = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.sum(x).alias("_total"))
    joined = salted_join(df.filter(F.col(by).isNotNull()), totals, [by], list(id_cols) or df.columns, rows_per_task)
    shares = joined.select(*df.columns, (F.try_divide(x, F.col("_total")) * 100).alias(name))
    return shares.unionByName(df.filter(F.col(by).isNull()).withColumn(name, F.lit(None).cast("double")))


def computed_preview(df: DataFrame, computed: Sequence[str], order_by: str | Order, n: int = 20) -> DataFrame:
    keys = [c for c, _ in order_pairs(order_by)]
    return sample_rows(df.select(*dict.fromkeys([*keys, *computed])), n, order_by)


def clear_computed(df: DataFrame, computed: Sequence[str]) -> DataFrame:
    return df.drop(*computed)
