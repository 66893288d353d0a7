"""Data profile and quality audit. Column statistics come from one aggregate over all columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import percent_of
from ..plans.quantiles import summarize
from ..plans.sampling import sample_rows
from .roles import column_roles


def per_column(df: DataFrame, fields: dict[str, dict[str, Column]]) -> DataFrame:
    """Aggregate every column in a single pass and return one row per column."""
    rows = [F.struct(F.lit(c).alias("column"), *[e.alias(n) for n, e in f.items()]) for c, f in fields.items()]
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def long_form(df: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    """Rows (column, value), all values cast to ``kind``."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS {kind})" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, value)")


def pinned(summary: DataFrame) -> DataFrame:
    """Evaluate a summary once (at most a row per column or column pair), so that several rules can read it."""
    return summary.sparkSession.createDataFrame(summary.collect(), summary.schema)


def column_list(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "position long, column string")


def null_stats(df: DataFrame) -> DataFrame:
    stats = per_column(
        df, {c: {"nulls": F.count("*") - F.count(F.col(f"`{c}`")), "rows": F.count("*")} for c in df.columns}
    )
    return stats.select("column", "nulls", F.round(percent_of(F.col("nulls"), F.col("rows")), 1).alias("null_pct"))


def distinct_stats(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Non-null distinct values per column, exact or by HyperLogLog."""
    cols = list(cols or df.columns)
    if approx:
        return per_column(df, {c: {"distinct": F.approx_count_distinct(F.col(f"`{c}`"))} for c in cols})
    families: dict[str, list[str]] = {}
    for c in cols:
        families.setdefault(_family(df.schema[c].dataType), []).append(c)
    counts = None
    for kind, names in families.items():
        values = long_form(df, names, kind).filter("value IS NOT NULL").distinct()
        part = values.groupBy("column").agg(F.count("*").alias("distinct"))
        counts = part if counts is None else counts.unionByName(part)
    listed = column_list(df, cols).join(counts, "column", "left")
    return listed.select("column", F.coalesce("distinct", F.lit(0).cast("long")).alias("distinct"))


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "BIGINT"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "DOUBLE"
    return "STRING"


def row_hashes(df: DataFrame) -> list[Column]:
    """Four hashes of 64 bits that stand for a whole row. A hash passes over nulls, so which columns are null is hashed too."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    masks = []
    for first in range(0, len(cols), 62):
        bits = [F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(cols[first : first + 62])]
        masks.append(reduce(lambda a, b: a + b, bits))
    return [F.xxhash64(F.lit(seed), *cols, *masks).alias(f"_h{seed}") for seed in range(4)]


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (nulls equal).

    Only hashes are shuffled, once: rows are equal where four of them, 256 bits, agree.
    """
    sizes = df.select(*row_hashes(df)).groupBy("_h0", "_h1", "_h2", "_h3").agg(F.count("*").alias("_n"))
    totals = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    return totals.select("rows", "duplicates", percent_of(F.col("duplicates"), F.col("rows")).alias("duplicate_pct"))


def quality_score(df: DataFrame) -> DataFrame:
    """100 less the null share of all cells and less 20 x the duplicate share, at least 0."""
    nulls = null_stats(df).agg(F.sum("nulls").alias("null_cells"))
    base = duplicate_count(df).select("rows", "duplicates", nulls.scalar().alias("null_cells"))
    cells = F.greatest(F.col("rows") * len(df.columns), F.lit(1))
    # Full marks, and the largest deduction for duplicates.
    penalty = F.least(F.col("duplicates") / F.greatest(F.col("rows"), F.lit(1)) * 20.0, F.lit(20.0))
    score = F.greatest(F.lit(0.0), 100.0 - F.col("null_cells") / cells * 100.0 - penalty)
    return base.select("rows", "null_cells", "duplicates", F.round(score, 1).alias("score"))


PROFILE_QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def numeric_stats(
    df: DataFrame, cols: Sequence[str] | None = None, fences: Sequence[float] = (1.5,)
) -> DataFrame:
    """Unrounded statistics per numeric column with values outside each IQR fence counted, from two scans as a rule.

    The first scan takes moments and a quantile sketch of all columns, the second counts the values near the quartiles and
    fences: see ``plans.quantiles``.
    """
    cols = list(cols if cols is not None else column_roles(df).numeric)
    found = summarize(df, {c: list(PROFILE_QUANTILES.values()) for c in cols}, fences) if cols else {}
    outliers = ["outliers" if i == 0 else f"outliers_{i}" for i in range(len(fences))]
    rows = []
    for c in cols:
        s = found[c]
        own = s.moments | dict(zip(PROFILE_QUANTILES, s.quantiles))
        rows.append((c, s.n, *[own[k] for k in ("min", "max", "mean", "median", "std", "sum", "skew", "kurt", "p25", "p75", "p95")], *s.outside))
    doubles = ", ".join(f"{k} double" for k in ("min", "max", "mean", "median", "std", "sum", "skew", "kurt", "p25", "p75", "p95"))
    counts = "".join(f", {o} long" for o in outliers)
    return df.sparkSession.createDataFrame(rows, f"column string, non_null long, {doubles}{counts}")


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Display form of :func:`numeric_stats` for columns with more than one value."""
    three = ("min", "max", "mean", "median", "std", "sum", "p25", "p75", "p95")
    stats = numeric_stats(df, cols).filter("non_null > 1")
    return stats.select(
        "column",
        "non_null",
        *[F.round(c, 3).alias(c) for c in three],
        F.round("skew", 2).alias("skew"),
        F.round("kurt", 2).alias("kurt"),
        "outliers",
        F.round(percent_of(F.col("outliers"), F.col("non_null")), 1).alias("outlier_pct"),
    )


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Values strictly outside the quartiles by more than ``k`` times their distance."""
    cols = list(cols if cols is not None else column_roles(df).numeric)
    found = summarize(df, {c: (0.25, 0.75) for c in cols}, (k,)) if cols else {}
    rows = []
    for c in cols:
        s = found[c]
        q1, q3 = s.quantiles
        known = q1 is not None and q3 is not None
        rows.append((c, s.n, q1 - k * (q3 - q1) if known else None, q3 + k * (q3 - q1) if known else None, s.outside[0]))
    stats = df.sparkSession.createDataFrame(rows, "column string, non_null long, low double, high double, outliers long")
    return stats.withColumn("outlier_pct", F.round(percent_of(F.col("outliers"), F.col("non_null")), 1))


def jarque_bera(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Normality test on all rows from the third and fourth moments."""
    cols = list(cols if cols is not None else column_roles(df).numeric)
    moments = per_column(
        df, {c: {"n": F.count(c), "g1": F.skewness(F.col(c)), "g2": F.kurtosis(F.col(c))} for c in cols}
    )
    jb = F.col("n") / 6 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4)
    tested = moments.select("column", "n", jb.alias("jb"), F.exp(-jb / 2).alias("p"))
    # Fixed value: significance level of the verdict.
    return tested.withColumn("normal", F.when(F.col("p") > 0.05, "yes").when(F.col("p").isNotNull(), "no"))


def value_counts_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return long_form(df, cols, "STRING").filter("value IS NOT NULL").groupBy("column", "value").count()


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value (smallest label on a tie), its share of all rows, and distinct values."""
    cols = list(cols if cols is not None else column_roles(df).categorical)
    rows = df.agg(F.count("*")).scalar()
    tops = value_counts_long(df, cols).groupBy("column").agg(
        F.min(F.struct((-F.col("count")).alias("m"), F.col("value"))).alias("t"), F.count("*").alias("distinct")
    )
    listed = column_list(df, cols).join(tops, "column", "left")
    top_rows = F.coalesce(-F.col("t.m"), F.lit(0))
    return listed.select(
        "column",
        F.coalesce("t.value", F.lit("")).alias("top"),
        top_rows.alias("top_rows"),
        F.round(percent_of(top_rows, rows), 1).alias("top_pct"),
        F.coalesce("distinct", F.lit(0).cast("long")).alias("distinct"),
    )


def profile_insights(df: DataFrame, limit: int | None = None, normality: bool = True) -> DataFrame:
    """Ranked findings: missing, duplicates, per-number and per-category notes, dates, overall score; all, or ``limit`` of them."""
    roles = column_roles(df)
    order = column_list(df, df.columns)
    quality = pinned(quality_score(df))
    found = []

    def add(frame, block, step, level, message):
        position = F.col("position") if "position" in frame.columns else F.lit(0)
        found.append(
            frame.select(
                F.lit(block).alias("block"),
                position.cast("long").alias("position"),
                F.lit(step).alias("step"),
                F.lit(level).alias("level"),
                message.alias("message"),
            )
        )

    # Fixed values below: limits of the findings.
    nulls = null_stats(df).join(order, "column").filter("null_pct > 20")
    worst = nulls.orderBy(F.desc("null_pct"), "position").limit(1)
    add(worst, 0, 0, "warn", F.concat("column", F.lit(" is missing in "), F.col("null_pct").cast("string"), F.lit("% of rows")))
    dups = quality.filter("duplicates > 0")
    add(dups, 1, 0, "bad", F.concat(F.col("duplicates").cast("string"), F.lit(" rows repeat an earlier row")))
    if roles.numeric:
        stats = pinned(numeric_profile(df)).join(order, "column")
        many = stats.filter("outlier_pct > 10")
        add(many, 2, 0, "warn", F.concat("column", F.lit(": "), F.col("outlier_pct").cast("string"), F.lit("% outliers")))
        side = F.when(F.col("skew") > 0, " has a long right tail, skewness ").otherwise(" has a long left tail, skewness ")
        add(stats.filter("abs(skew) > 2"), 2, 1, "info", F.concat("column", side, F.col("skew").cast("string")))
        if normality:
            normal = jarque_bera(df, roles.numeric).filter("normal = 'yes'").join(order, "column")
            add(normal, 2, 2, "good", F.concat("column", F.lit(" is consistent with a normal distribution")))
    if roles.categorical:
        cats = pinned(categorical_profile(df, roles.categorical)).join(order, "column")
        share = F.concat("top", F.lit(" makes up "), F.col("top_pct").cast("string"), F.lit("% of "), F.col("column"))
        add(cats.filter("top_pct > 80"), 3, 0, "info", share)
        ids = cats.filter(F.col("distinct") == quality.select("rows").scalar())
        add(ids, 3, 1, "info", F.concat("column", F.lit(" identifies each row")))
    if roles.date:
        add(quality, 4, 0, "good", F.lit(f"{roles.date[0]} allows time series"))
    add(quality.filter("score >= 90"), 5, 0, "good", F.concat(F.lit("quality score "), F.col("score").cast("string")))
    merged = found[0]
    for f in found[1:]:
        merged = merged.unionByName(f)
    ranked = merged.orderBy("block", "position", "step")
    return ranked if limit is None else ranked.limit(limit)


def quality_totals(df: DataFrame) -> DataFrame:
    q = quality_score(df)
    cells = F.greatest(F.col("rows") * len(df.columns), F.lit(1))
    numeric = column_roles(df).numeric
    outliers = F.lit(0).cast("long")
    if numeric:
        outliers = iqr_outliers(df, numeric).filter("non_null > 1").agg(F.coalesce(F.sum("outliers"), F.lit(0))).scalar()
    return q.select(
        F.col("null_cells").alias("total_nulls"),
        F.round(F.col("null_cells") / cells * 100.0, 2).alias("null_pct_cells"),
        "duplicates",
        outliers.alias("outliers"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
    )


def missing_ranked(df: DataFrame, n: int | None = None) -> DataFrame:
    ranked = null_stats(df).filter("null_pct > 0").orderBy(F.desc("null_pct"), "column")
    return ranked if n is None else ranked.limit(n)


def outlier_ranked(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    stats = numeric_profile(df, cols).filter("outliers > 0")
    return stats.select("column", "outliers", "outlier_pct", "skew", "kurt").orderBy(F.desc("outlier_pct"), "column")


def null_pattern(df: DataFrame, id_cols: Sequence[str], n: int = 100, seed: int = 0) -> DataFrame:
    """0/1 map of missing cells for a hash sample of rows, one row per (row, column)."""
    sample = sample_rows(df, n, list(id_cols), "hash", seed)
    cols = [c for c in df.columns if c not in id_cols]
    flags = ", ".join(f"'{c}', CAST(`{c}` IS NULL AS BIGINT)" for c in cols)
    return sample.selectExpr(*[f"`{c}`" for c in id_cols], f"stack({len(cols)}, {flags}) AS (column, is_null)")


def null_patterns(df: DataFrame) -> DataFrame:
    """How often each combination of missing columns occurs over all rows."""
    names = F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in df.columns])
    pattern = F.array_join(F.array_compact(names), ",").alias("missing_columns")
    return df.groupBy(pattern).agg(F.count("*").alias("rows"))


def schema_report(df: DataFrame, normality: bool = False) -> DataFrame:
    """One row per column of the table, numbers for numeric columns and the top value for categories."""
    roles = column_roles(df)
    listed = df.sparkSession.createDataFrame(
        [(i, c, roles.of(c) or "other") for i, c in enumerate(df.columns)], "position long, column string, type string"
    )
    total = df.agg(F.count("*")).scalar()
    report = listed.join(null_stats(df), "column").join(distinct_stats(df), "column")
    report = report.withColumn("non_null", total - F.col("nulls"))
    numbers = numeric_profile(df, roles.numeric).drop("non_null") if roles.numeric else None
    keep = ["min", "max", "mean", "std", "skew", "outliers"]
    if numbers is not None:
        report = report.join(numbers.select("column", *keep), "column", "left")
    if roles.categorical:
        report = report.join(categorical_profile(df, roles.categorical).select("column", "top", "top_pct"), "column", "left")
    if normality and roles.numeric:
        tested = jarque_bera(df, roles.numeric).select("column", "normal")
        report = report.join(tested, "column", "left")
    return report.drop("nulls").orderBy("position")


def stat_card(df: DataFrame, col: str, normality: bool = False) -> DataFrame:
    """The statistics of one column as rows (statistic, value)."""
    names = ["min", "max", "mean", "median", "std", "skew", "kurt", "p25", "p75", "p95", "outliers", "outlier_pct"]
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in names)
    card = numeric_profile(df, [col]).selectExpr(f"stack({len(names)}, {pairs}) AS (statistic, value)")
    if normality:
        tested = jarque_bera(df, [col])
        card = card.unionByName(tested.select(F.lit("normality_p").alias("statistic"), F.col("p").alias("value")))
    return card
