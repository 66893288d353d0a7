"""The aggregated data behind each chart type."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import equal_width_bin
from ..functions.calendar import period_end, period_name
from ..plans.joins import with_summary
from ..plans.positions import Order, order_pairs, sort_columns
from ..plans.sampling import sample_rows
from .timeseries import aggregate


def value_counts(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; equal counts by label."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), col).limit(n)


def frequent_only(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose ``col`` is one of its ``n`` most frequent values. The right side has at most ``n`` rows."""
    return df.join(F.broadcast(value_counts(df, col, n).select(col)), col, "left_semi")


def top_categories(df: DataFrame, cat: str, val: str, n: int = 20) -> DataFrame:
    totals = df.filter(F.col(cat).isNotNull()).groupBy(cat).agg(aggregate(val, "sum").alias("total"))
    return totals.orderBy(F.desc("total"), cat).limit(n)


def hierarchy(df: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """Totals at every prefix of ``path`` with the value-weighted mean value as colour."""
    path = list(path)
    leaves = (
        df.dropna(subset=path)
        .groupBy(*path)
        .agg(aggregate(value, "sum").alias("_v"), F.sum(F.col(value).cast("double") * F.col(value)).alias("_vv"))
    )
    depth = sum((1 - F.grouping(c) for c in path[1:]), 1 - F.grouping(path[0]))
    levels = leaves.rollup(*path).agg(depth.cast("long").alias("depth"), F.sum("_v").alias("value"), F.sum("_vv").alias("_vv"))
    return levels.filter("depth > 0").select(*path, "depth", "value", F.try_divide("_vv", "value").alias("colour"))


def funnel(df: DataFrame, stage: str, value: str) -> DataFrame:
    totals = df.filter(F.col(stage).isNotNull()).groupBy(stage).agg(aggregate(value, "sum").alias("total"))
    return totals.orderBy(F.desc("total"), stage)


def waterfall(
    df: DataFrame, value: str, label: str | None = None, n: int = 10, order_by: str | Order | None = None
) -> DataFrame:
    """``n`` steps with their running total, closed by a Total row.

    Steps are the largest label sums, or without a label the first rows by ``order_by``.
    """
    if label is not None:
        steps = top_categories(df, label, value, n).select(F.col(label).cast("string").alias("label"), F.col("total").alias("value"))
        order = [F.desc("value"), F.col("label")]
        ranked = steps.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        if order_by is None:
            raise ValueError("without a label, order_by says which rows come first")
        sorting = sort_columns(order_pairs(order_by))
        rows = df.orderBy(*sorting).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*sorting)).cast("long"))
        ranked = rows.select((F.col("position") - 1).cast("string").alias("label"), F.col(value).alias("value"), "position")
    upto = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    steps = ranked.select(
        "position", "label", F.lit("relative").alias("measure"), "value", F.sum("value").over(upto).alias("running")
    )
    total = ranked.agg(
        (F.count("*") + 1).alias("position"),
        F.lit("Total").alias("label"),
        F.lit("total").alias("measure"),
        F.sum("value").alias("value"),
        F.sum("value").alias("running"),
    )
    return steps.unionByName(total)


def radar_means(df: DataFrame, axes: Sequence[str], by: str | None = None, n: int = 5) -> DataFrame:
    """Mean of every axis, overall or for each of the ``n`` most frequent groups."""
    means = [F.avg(a).alias(a) for a in axes]
    pairs = f"stack({len(axes)}, " + ", ".join(f"'{a}', `{a}`" for a in axes) + ") AS (axis, mean)"
    if by is None:
        return df.agg(*means).selectExpr(pairs)
    return frequent_only(df, by, n).groupBy(by).agg(*means).selectExpr(f"`{by}`", pairs)


def project_sample(df: DataFrame, cols: Sequence[str], order_by: str | Order, n: int | None = None, mode: str = "head") -> DataFrame:
    """Chosen columns of all rows, or of an ``n``-row sample (the key columns come along)."""
    keys = [c for c, _ in order_pairs(order_by)]
    return sample_rows(df.select(*dict.fromkeys([*keys, *cols])), n, order_by, mode)


def sankey_links(df: DataFrame, source: str, target: str, value: str, n: int = 30) -> DataFrame:
    flows = (
        df.dropna(subset=[source, target])
        .groupBy(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target"))
        .agg(aggregate(value, "sum").alias("value"))
    )
    return flows.orderBy(F.desc("value"), "source", "target").limit(n)


def sankey(df: DataFrame, source: str, target: str, value: str, n: int = 30) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): links carry the integer index of both ends, nodes being numbered by name.

    The at most ``n`` links are folded into one row to number their ends, so the flows are computed once.
    """
    links = sankey_links(df, source, target, value, n)
    ends = F.flatten(F.collect_list(F.array("source", "target")))
    folded = links.agg(
        F.collect_list(F.struct("source", "target", "value")).alias("links"), F.array_sort(F.array_distinct(ends)).alias("names")
    )
    nodes = folded.select(F.posexplode("names").alias("index", "node")).select("node", F.col("index").cast("long").alias("index"))
    each = folded.select("names", F.explode("links").alias("l")).select("names", "l.*")
    numbered = {f"{e}_index": F.array_position("names", F.col(e)) - 1 for e in ("source", "target")}
    return nodes, each.withColumns(numbered).drop("names")


def value_matrix(
    df: DataFrame, rows: str, cols: str, val: str, agg: str = "sum", values: Sequence | None = None, wide: bool = True
) -> DataFrame:
    """``rows`` x ``cols`` table of an aggregate, missing combinations 0. ``wide=False`` gives the observed cells.

    The wide form has a column per value of ``cols``, for which Spark allows 10,000; :func:`value_map` has no such limit.
    """
    known = df.dropna(subset=[rows, cols])
    if not wide:
        return known.groupBy(rows, cols).agg(aggregate(val, agg).alias("value"))
    return known.groupBy(rows).pivot(cols, values).agg(aggregate(val, agg)).fillna(0)


def value_map(df: DataFrame, rows: str, cols: str, val: str, agg: str = "sum") -> DataFrame:
    """The wide table with a map instead of columns: per value of ``rows`` its observed ``cols``, in order, with their aggregates."""
    cells = value_matrix(df, rows, cols, val, agg, wide=False)
    return as_map(cells, rows, cols, "value")


def as_map(cells: DataFrame, rows: str, cols: str, value: str) -> DataFrame:
    """Cells (rows, cols, value), each once, as a row with the map ``cells`` per value of ``rows``.

    A map is as large as ``cols`` has values, however many input rows there are.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(cols).alias("k"), F.col(value).alias("v"))))
    return cells.groupBy(rows).agg(F.map_from_entries(entries).alias("cells"))


def stacked_area(df: DataFrame, date: str, cat: str, val: str, freq: str = "M", n: int = 8) -> DataFrame:
    """Sum per period and category for the ``n`` most frequent categories, observed combinations only."""
    rows = frequent_only(df, cat, n).filter(F.col(date).isNotNull())
    return rows.groupBy(period_end(F.col(date), freq).alias("period"), cat).agg(aggregate(val, "sum").alias("total"))


def histogram2d(df: DataFrame, x: str, y: str, x_bins: int = 30, y_bins: int = 30) -> DataFrame:
    """Non-empty cells of an equal-width grid over the rows finite in both; :func:`marginals` sums them over either axis."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.filter((F.abs("x") < math.inf) & (F.abs("y") < math.inf))
    box = rows.agg(F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    cells = with_summary(rows, "_b", box).select(
        equal_width_bin(F.col("x"), F.col("_b.x0"), F.col("_b.x1"), x_bins).alias("x_bin"),
        equal_width_bin(F.col("y"), F.col("_b.y0"), F.col("_b.y1"), y_bins).alias("y_bin"),
    )
    return cells.groupBy("x_bin", "y_bin").agg(F.count("*").alias("count"))


def marginals(cells: DataFrame) -> DataFrame:
    """Rows per bin of either axis of :func:`histogram2d`, as (axis, bin, count)."""
    each = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x_bin").alias("bin")), F.struct(F.lit("y").alias("axis"), F.col("y_bin").alias("bin"))))
    return cells.select(each.alias("m"), "count").groupBy("m.axis", "m.bin").agg(F.sum("count").alias("count"))


def bar_race(df: DataFrame, date: str, cat: str, val: str, n: int = 10) -> DataFrame:
    """Monthly totals of the ``n`` largest categories with their rank in the month."""
    monthly = (
        df.select(date, cat, val)
        .dropna()
        .groupBy(period_name(F.col(date), "M").alias("period"), cat)
        .agg(F.sum(val).alias("total"))
    )
    largest = monthly.groupBy(cat).agg(F.sum("total").alias("_all")).orderBy(F.desc("_all"), cat).limit(n).select(cat)
    kept = monthly.join(F.broadcast(largest), cat, "left_semi")
    frame = Window.partitionBy("period").orderBy(F.desc("total"), cat)
    # Fixed value: head room of the axis above the longest bar.
    axis = kept.agg(F.max("total") * 1.1).scalar()
    return kept.select("period", cat, "total", F.row_number().over(frame).cast("long").alias("rank"), axis.alias("axis_max"))
