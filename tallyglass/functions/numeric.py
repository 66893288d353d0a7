"""Column expressions for statistics whose Spark built-in differs from the usual sample definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating-point column, so that both mean "missing"."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floats})


def sample_skewness(c: str | Column) -> Column:
    """Bias-corrected skewness G1; 0 for a constant column, null below three values."""
    x = as_column(c)
    n = F.count(x).cast("double")
    return (
        F.when(F.count(x) < 3, F.lit(None))
        .when(F.min(x) == F.max(x), F.lit(0.0))
        .otherwise(F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))
    )


def sample_kurtosis(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis G2; 0 for a constant column, null below four values."""
    x = as_column(c)
    n = F.count(x).cast("double")
    return (
        F.when(F.count(x) < 4, F.lit(None))
        .when(F.min(x) == F.max(x), F.lit(0.0))
        .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))
    )


def pearson(y: str | Column, x: str | Column) -> Column:
    """Pairwise-complete correlation, null where either side is constant (``corr`` raises there under ANSI)."""
    a, b = as_column(y), as_column(x)
    return F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b)) * F.sqrt(F.regr_syy(a, b)))


def percent_of(part: Column, whole: Column) -> Column:
    """100 * part / whole, with a zero whole counted as one."""
    return part * 100.0 / F.greatest(whole, F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; null if either has zero length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(diff)
