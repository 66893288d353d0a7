"""Distributions of single columns: histograms, breakdowns, boxes, densities and Q-Q points."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import equal_width_bin
from ..functions.numeric import percent_of
from ..functions.probability import normal_ppf
from ..plans.joins import salted_join, with_summary
from ..plans.positions import ROWS_PER_TASK
from ..plans.quantiles import exact_quantiles, grouped_quantiles
from .charts import value_counts
from .roles import column_roles


def histogram(df: DataFrame, col: str, bins: int = 40, by: str | None = None) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest finite value; others are left out.

    All bins are listed, empty ones with 0; with ``by`` only the occupied (bin, group) cells. The range is found
    first and enters the plan as literals.
    """
    rows = df.select(F.col(col).cast("double").alias("_x"), *([by] if by else [])).filter(F.abs("_x") < math.inf)
    low, high = (F.lit(v).cast("double") for v in rows.agg(F.min("_x"), F.max("_x")).first())
    binned = rows.withColumn("bin", equal_width_bin(F.col("_x"), low, high, bins))
    counts = binned.groupBy("bin", *([by] if by else [])).agg(F.count("*").alias("count"))
    if by is None:
        every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
        counts = every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0).cast("long")).alias("count"))
    width = (high - low) / bins
    edges = {"low": low + F.col("bin") * width, "high": low + (F.col("bin") + 1) * width}
    return counts.withColumns(edges)


def histogram_grid(df: DataFrame, bins: int = 25, cols: Sequence[str] | None = None) -> DataFrame:
    """Occupied bins of every numeric column, from one pass for all ranges and one for all counts."""
    cols = list(cols if cols is not None else column_roles(df).numeric)
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    x = {c: F.when(F.abs(v) < math.inf, v) for c, v in x.items()}
    ends = df.agg(
        F.struct(*[e for i, c in enumerate(cols) for e in (F.min(x[c]).alias(f"low{i}"), F.max(x[c]).alias(f"high{i}"))])
    )
    cells = []
    for i, c in enumerate(cols):
        cells += [F.lit(c), equal_width_bin(x[c], F.col(f"_e.low{i}"), F.col(f"_e.high{i}"), bins)]
    long = with_summary(df, "_e", ends).select(F.stack(F.lit(len(cols)), *cells).alias("column", "bin")).filter("bin IS NOT NULL")
    return long.groupBy("column", "bin").agg(F.count("*").alias("count"))


def value_breakdown(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    """Top values with their share of all rows, missing rows included."""
    total = df.agg(F.count("*")).scalar()
    return value_counts(df, col, n).withColumn("pct", F.round(percent_of(F.col("count"), total), 1))


def _quartiles(df: DataFrame, col: str, by: str | None, rows_per_task: int) -> DataFrame:
    """Rows of ``df`` (value as ``_x``) with the quartiles of their group."""
    names = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    rows = df.filter(F.col(col).isNotNull()).withColumn("_x", F.col(col).cast("double"))
    if by is None:
        found = exact_quantiles(rows, {"_x": list(names.values())})["_x"]
        return rows.withColumns({n: F.lit(v).cast("double") for n, v in zip(names, found)})
    rows = rows.filter(F.col(by).isNotNull())
    quartiles = grouped_quantiles(rows, [by], "_x", names, rows_per_task).drop("n")
    return salted_join(rows, quartiles, [by], df.columns, rows_per_task)


def box_stats(df: DataFrame, col: str, by: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR of the box) and outlier count per group."""
    rows = _quartiles(df, col, by, rows_per_task)
    inside = F.col("_x").between(*_fences())
    return rows.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("n"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("_x"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_x"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outliers"),
    )


def box_outliers(df: DataFrame, col: str, by: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows outside the whiskers of their group."""
    rows = _quartiles(df, col, by, rows_per_task)
    return rows.filter(~F.col("_x").between(*_fences())).select(*df.columns)


def _fences():
    # Fixed value: box-plot fence of 1.5 times the quartile distance.
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return F.col("q1") - reach, F.col("q3") + reach


def kde(
    df: DataFrame, col: str, by: str, grid: int = 100, cells: int = 512, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Gaussian density per group at ``grid`` points, two bandwidths beyond the data.

    Values are first counted in ``cells`` equal-width cells per group, so the kernel sums run over at
    most ``cells`` x ``grid`` terms per group whatever the number of rows.
    """
    rows = df.select(by, F.col(col).cast("double").alias("_x")).dropna()
    quartiles = grouped_quantiles(rows, [by], "_x", {"q1": 0.25, "q3": 0.75}, rows_per_task)
    moments = rows.groupBy(by).agg(F.min("_x").alias("low"), F.max("_x").alias("high"), F.stddev_samp("_x").alias("sd"))
    shape = quartiles.join(moments, by)
    # Silverman's rule with the quartile distance of a unit normal.
    spread = F.least(F.col("sd"), F.nullif(F.col("q3") - F.col("q1"), F.lit(0.0)) / 1.349)
    shape = shape.withColumn("h", 1.059 * spread * F.pow(F.col("n"), F.lit(-0.2))).filter("h > 0")
    shape = shape.select(by, "n", "low", "high", "h")
    cell = equal_width_bin(F.col("_x"), F.col("low"), F.col("high"), cells)
    shaped = salted_join(rows, shape, [by], ["_x"], rows_per_task)
    kept = [F.max(c).alias(c) for c in ("n", "low", "high", "h")]
    counted = shaped.groupBy(by, cell.alias("cell")).agg(F.count("*").alias("w"), *kept)
    width = (F.col("high") - F.col("low")) / cells
    centre = F.col("low") + (F.col("cell") + 0.5) * width
    start, step = F.col("low") - 2 * F.col("h"), (F.col("high") - F.col("low") + 4 * F.col("h")) / (grid - 1)
    points = counted.select(
        by, "w", "n", "h", centre.alias("c"), start.alias("s"), step.alias("d"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point")
    )
    x = F.col("s") + F.col("point") * F.col("d")
    z = (x - F.col("c")) / F.col("h")
    term = F.col("w") * F.exp(-z * z / 2) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return points.groupBy(by, F.col("point").cast("long").alias("point")).agg(F.max(x).alias("x"), F.sum(term).alias("density"))


def qq_plot(df: DataFrame, col: str, m: int = 99) -> DataFrame:
    """``m`` observed quantiles (at most 10,000) of all rows between 1 % and 99 % against a normal with the same mean and spread."""
    if not 2 <= m <= 10_000:
        raise ValueError("m must be between 2 and 10,000")
    probabilities = [0.01 + 0.98 * i / (m - 1) for i in range(m)]
    observed = exact_quantiles(df, {col: probabilities})[col]
    points = [(i, p, normal_ppf(p), o) for i, (p, o) in enumerate(zip(probabilities, observed))]
    frame = df.sparkSession.createDataFrame(points, "point long, p double, theoretical double, observed double")
    fit = df.agg(F.struct(F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"))).scalar()
    return frame.withColumn("line", F.col("theoretical") * fit["sd"] + fit["mean"])
