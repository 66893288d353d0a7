"""Relationships between columns: correlation, regression, group differences."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pearson
from ..functions.probability import f_upper, pearson_p
from ..plans.positions import ROWS_PER_TASK, join_null_safe
from ..plans.quantiles import grouped_quantiles
from ..session import ship_package
from .charts import frequent_only
from .distributions import histogram
from .roles import column_roles

SIGNIFICANT = 0.05  # Fixed value: significance level.


def _doubles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Unrounded r of every column pair (a before b), each over the rows where both are present.

    One pass adds up products of values, shifted by the mean of some rows lest large numbers cancel. Each task
    multiplies its Arrow batches as matrices and emits one row per pair, so cost and output follow the number of
    columns squared and never the number of rows. r is null where either side is constant.
    """
    cols = list(cols if cols is not None else column_roles(df).numeric)
    pairs = _pair_table(df, cols).filter("i < j")
    return pairs.select("i", "j", "a", "b", "r", "n")


SHIFT_ROWS = 1000


def _pair_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, a, b, r, n) of every pair i <= j; a column with itself has r = 1 if it varies."""
    numbers = _doubles(df, cols)
    means = numbers.limit(SHIFT_ROWS).agg(*[F.avg(F.when(F.abs(f"`{c}`") < math.inf, F.col(f"`{c}`"))) for c in cols]).first()
    ship_package(df.sparkSession)
    centre = np.array([0.0 if m is None else float(m) for m in means])
    parts = numbers.mapInArrow(_pair_sums(centre), f"i int, j int, {', '.join(f'{s} double' for s in PAIR_SUMS)}, {', '.join(f'{e} double' for e in PAIR_ENDS)}")
    sums = parts.groupBy("i", "j").agg(
        *[F.sum(s).alias(s) for s in PAIR_SUMS],
        *[(F.min(e) if e.endswith("min") else F.max(e)).alias(e) for e in PAIR_ENDS],
    )
    pairs = [(i, j, cols[i], cols[j]) for i, j in combinations_with_replacement(range(len(cols)), 2)]
    listed = df.sparkSession.createDataFrame(pairs, "i int, j int, a string, b string")
    n = F.nullif(F.col("n"), F.lit(0.0))
    xx, yy = F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n
    r = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / n, F.sqrt(xx) * F.sqrt(yy))
    varied = (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax"))
    joined = listed.join(sums, ["i", "j"], "left")
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(r)
    return joined.select("i", "j", "a", "b", F.when(varied, r).alias("r"), F.coalesce("n", F.lit(0.0)).cast("long").alias("n"))


PAIR_SUMS = ("n", "x", "y", "xx", "yy", "xy")
PAIR_ENDS = ("xmin", "xmax", "ymin", "ymax")


def _pair_sums(centre: np.ndarray):
    """Per task: sums over the rows where both columns of a pair are present, for every pair."""

    def add_up(batches):
        m = len(centre)
        total = {s: np.zeros((m, m)) for s in ("n", "x", "xx", "xy")}
        # low[a, b] and high[a, b]: range of column a over the rows where b is present too.
        low, high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - centre
            present = ~np.isnan(v)
            v = np.where(present, v, 0.0)
            mask = present.astype(float)
            total["n"] += mask.T @ mask
            total["x"] += v.T @ mask
            total["xx"] += (v * v).T @ mask
            total["xy"] += v.T @ v
            for b in range(m):
                both = present[:, b][:, None] & present
                low[:, b] = np.minimum(low[:, b], np.where(both, v, np.inf).min(axis=0))
                high[:, b] = np.maximum(high[:, b], np.where(both, v, -np.inf).max(axis=0))
        i, j = np.triu_indices(m)
        if not total["n"].any():
            return
        found = {
            "i": i.astype("int32"), "j": j.astype("int32"), "n": total["n"][i, j], "x": total["x"][i, j], "y": total["x"][j, i],
            "xx": total["xx"][i, j], "yy": total["xx"][j, i], "xy": total["xy"][i, j],
            "xmin": low[i, j], "xmax": high[i, j], "ymin": low[j, i], "ymax": high[j, i],
        }
        yield pa.RecordBatch.from_pydict(found)

    return add_up


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long form of the full symmetric matrix, rounded to two digits."""
    cols = list(cols if cols is not None else column_roles(df).numeric)
    cell, mirrored = F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    # One row per pair becomes two cells, so the pairs are computed once.
    cells = F.when(F.col("i") == F.col("j"), F.array(cell)).otherwise(F.array(cell, mirrored))
    return _pair_table(df, cols).select(F.inline(cells)).select("a", "b", F.round("r", 2).alias("r"))


def top_correlations(df: DataFrame, n: int = 6, cols: Sequence[str] | None = None) -> DataFrame:
    pairs = correlation_pairs(df, cols).select("i", "j", "a", "b", F.round("r", 2).alias("r")).filter("r IS NOT NULL")
    return pairs.orderBy(F.desc(F.abs("r")), "i", "j").limit(n).select("a", "b", "r")


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x over all complete rows."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    slope = F.try_divide(F.regr_sxy(a, b), F.regr_sxx(a, b))
    return df.agg(
        F.regr_count(a, b).alias("n"),
        slope.alias("slope"),
        (F.regr_avgy(a, b) - slope * F.regr_avgx(a, b)).alias("intercept"),
        (pearson(a, b) * pearson(a, b)).alias("r2"),
    )


def pearson_test(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    n, r = df.agg(F.regr_count(a, b), pearson(a, b)).first()
    p = pearson_p(r, n - 2) if n > 2 else None
    verdict = None if p is None else p < SIGNIFICANT
    return df.sparkSession.createDataFrame([(n, r, p, verdict)], "n long, r double, p double, significant boolean")


def fit_linear(df: DataFrame, y: str, xs: Sequence[str]):
    """(model, complete rows with the feature vector) of an ordinary least-squares fit."""
    rows = df.dropna(subset=[y, *xs]).withColumn("_y", F.col(y).cast("double"))
    rows = VectorAssembler(inputCols=list(xs), outputCol="_x").transform(rows)
    fit = LinearRegression(featuresCol="_x", labelCol="_y", predictionCol="predicted", solver="normal", regParam=0.0)
    return fit.fit(rows), rows


def linear_regression(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """One row: coefficients by feature, intercept, R2, RMSE, MAE and rows used."""
    model, _ = fit_linear(df, y, xs)
    s = model.summary
    row = [round(float(c), 4) for c in model.coefficients] + [
        float(model.intercept), float(s.r2), float(s.rootMeanSquaredError), float(s.meanAbsoluteError), int(s.numInstances)
    ]
    names = [f"coef_{x}" for x in xs]
    schema = ", ".join([*(f"`{n}` double" for n in names), "intercept double, r2 double, rmse double, mae double, n long"])
    return df.sparkSession.createDataFrame([tuple(row)], schema)


def regression_predictions(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Complete rows with actual, predicted and residual."""
    model, rows = fit_linear(df, y, xs)
    scored = model.transform(rows).withColumn("actual", F.col("_y"))
    return scored.withColumn("residual", F.col("actual") - F.col("predicted")).drop("_x", "_y")


def residual_histogram(df: DataFrame, y: str, xs: Sequence[str], bins: int = 30) -> DataFrame:
    return histogram(regression_predictions(df, y, xs), "residual", bins)


def feature_importance(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Share of each absolute coefficient in their sum, largest first."""
    model, _ = fit_linear(df, y, xs)
    size = [abs(float(c)) for c in model.coefficients]
    total = sum(size)
    rows = [(x, float(c), 100.0 * s / total if total else None) for x, c, s in zip(xs, model.coefficients, size)]
    rows.sort(key=lambda r: -(r[2] or 0.0))
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, importance_pct double")


def group_stats(df: DataFrame, num: str, cat: str, n: int = 8, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Mean, median, spread and count for the ``n`` most frequent categories."""
    rows = frequent_only(df.select(cat, F.col(num).cast("double").alias("_x")), cat, n)
    moments = rows.groupBy(cat).agg(
        F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.count("_x").alias("count")
    )
    medians = grouped_quantiles(rows, [cat], "_x", {"median": 0.5}, rows_per_task).select(cat, "median")
    joined = join_null_safe(moments, medians, [cat], "left")
    return joined.select(
        cat, F.round("mean", 2).alias("mean"), F.round("median", 2).alias("median"), F.round("std", 2).alias("std"), "count"
    )


def anova(df: DataFrame, num: str, cat: str, n: int = 8) -> DataFrame:
    """One-way F test over the ``n`` most frequent categories, from per-group counts, means and variances."""
    rows = frequent_only(df.select(cat, F.col(num).cast("double").alias("_x")), cat, n).filter("_x IS NOT NULL")
    groups = rows.groupBy(cat).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.var_pop("_x").alias("var")).collect()
    k, total = len(groups), sum(g.n for g in groups)
    d1, d2, f, p = k - 1, total - k, None, None
    if k > 1 and d2 > 0:
        grand = math.fsum(g.n * g.mean for g in groups) / total
        between = math.fsum(g.n * (g.mean - grand) ** 2 for g in groups)
        within = math.fsum(g.n * g.var for g in groups)
        if within > 0:
            f = (between / d1) / (within / d2)
            p = f_upper(f, d1, d2)
    verdict = None if p is None else p < SIGNIFICANT
    return df.sparkSession.createDataFrame(
        [(f, p, d1, d2, verdict)], "f double, p double, df_between long, df_within long, significant boolean"
    )


def partial_correlation(df: DataFrame, x: str, y: str, controls: Sequence[str]) -> DataFrame:
    """Correlation of x and y with the linear effect of ``controls`` removed.

    ``p_ref`` uses n - 2 degrees of freedom, ``p_adj`` n - 2 - (number of controls). One aggregate
    yields the covariance matrix; only that matrix (a row per column) is inverted on the driver.
    """
    cols = [x, y, *controls]
    rows = _doubles(df, cols).dropna()
    cells = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
    row = rows.agg(
        F.count("*"), *[F.covar_pop(F.col(f"`{cols[a]}`"), F.col(f"`{cols[b]}`")) for a, b in cells]
    ).first()
    n, cov = row[0], np.zeros((len(cols), len(cols)))
    for (a, b), v in zip(cells, row[1:]):
        cov[a, b] = cov[b, a] = math.nan if v is None else v
    raw = partial = None
    if n > 2 and (np.diag(cov) > 0).all():
        scale = np.sqrt(np.diag(cov))
        inverse = np.linalg.pinv(cov / np.outer(scale, scale), hermitian=True)
        raw = float(cov[0, 1] / (scale[0] * scale[1]))
        partial = float(-inverse[0, 1] / math.sqrt(inverse[0, 0] * inverse[1, 1]))
    out = (n, raw, pearson_p(raw, n - 2), partial, pearson_p(partial, n - 2), pearson_p(partial, n - 2 - len(controls)))
    return df.sparkSession.createDataFrame(
        [out], "n long, raw_r double, raw_p double, partial_r double, p_ref double, p_adj double"
    )
