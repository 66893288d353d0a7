"""Alert rules over the profile. Each rule is a small aggregate with thresholds; all share one schema.

Rules read summaries of at most a row per column (or column pair). ``alert_report`` evaluates each summary
once for all rules that need it.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pearson
from ..functions.probability import pearson_p
from ..plans.joins import with_summary
from .forest import isolation_forest
from .profile import categorical_profile, distinct_stats, duplicate_count, numeric_stats, per_column, pinned
from .relations import correlation_pairs
from .roles import column_roles

SEVERITIES = ("CRITICAL", "WARNING", "INFO", "GOOD")
FIELDS = ("severity", "category", "title", "body", "recommendation", "column", "value")

# The thresholds of the rules.
NULL_CELLS_CRITICAL, NULL_CELLS_WARNING, NULL_COLUMN_WARNING = 20.0, 5.0, 30.0
DUPLICATE_WARNING = 5.0
OUTLIER_MIN_ROWS, EXTREME_FENCE, FENCE, OUTLIER_SHARE = 10, 4.0, 1.5, 0.10
SKEW_MIN_ROWS, SKEW_LIMIT = 30, 3.0
CORRELATION_WARNING, CORRELATION_INFO = 0.90, 0.75
TREND_MIN_ROWS, TREND_P, TREND_R, TREND_CHANGE = 20, 0.05, 0.4, 30.0
VARIATION_MIN_ROWS, VARIATION_LIMIT = 10, 0.01
IMBALANCE_SHARE = 0.80
FOREST_MIN_ROWS, FOREST_CONTAMINATION, FOREST_TREES, FOREST_WARNING = 20, 0.05, 100, 3.0


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _num(c: Column, digits: int = 2) -> Column:
    return F.format_number(c, digits)


def _alert(
    frame: DataFrame, severity: Column | str, category: str, title: Column, body: Column, advice: Column | str,
    column: Column | None = None, value: Column | None = None, rule: int = 0,
) -> DataFrame:
    def col(v):
        return F.lit(v) if isinstance(v, str) else v

    position = F.col("position").cast("long") if "position" in frame.columns else F.lit(0).cast("long")
    return frame.select(
        col(severity).alias("severity"), F.lit(category).alias("category"), title.alias("title"), body.alias("body"),
        col(advice).alias("recommendation"), (F.lit(None) if column is None else column).cast("string").alias("column"),
        (F.lit(None) if value is None else value).cast("double").alias("value"), F.lit(rule).cast("long").alias("rule"), position.alias("position"),
    )


def _positions(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "position long, column string")


class Summaries:
    """The summaries the rules read; each is computed on first use and kept (bounded by columns, not rows)."""

    def __init__(self, df: DataFrame, max_numeric: int | None = None):
        self.df, self.max_numeric, self._kept = df, max_numeric, {}

    def _once(self, name, make):
        if name not in self._kept:
            self._kept[name] = pinned(make())
        return self._kept[name]

    def prefetch(self, names: Sequence[str]) -> None:
        """Compute several summaries side by side; their jobs share the cluster."""
        with ThreadPoolExecutor(len(names)) as pool:
            make = inheritable_thread_target(self.df.sparkSession)(lambda name: getattr(self, name)())
            list(pool.map(make, names))

    def nulls(self) -> DataFrame:
        df = self.df
        counts = {c: {"nulls": F.count("*") - F.count(F.col(f"`{c}`")), "rows": F.count("*")} for c in df.columns}
        return self._once("nulls", lambda: per_column(df, counts).join(_positions(df), "column"))

    def duplicates(self) -> DataFrame:
        return self._once("duplicates", lambda: duplicate_count(self.df))

    def numbers(self) -> DataFrame:
        return self._once("numbers", lambda: numeric_stats(self.df, fences=(FENCE, EXTREME_FENCE)).join(_positions(self.df), "column"))

    def distincts(self) -> DataFrame:
        return self._once("distincts", lambda: distinct_stats(self.df, column_roles(self.df).numeric))

    def categories(self) -> DataFrame:
        return self._once("categories", lambda: categorical_profile(self.df).join(_positions(self.df), "column"))

    def correlations(self) -> DataFrame:
        return self._once("correlations", lambda: correlation_pairs(self.df))

    def trends(self) -> DataFrame:
        return self._once("trends", lambda: trend_stats(self.df, self.max_numeric))


def _of(df: DataFrame | Summaries) -> Summaries:
    return df if isinstance(df, Summaries) else Summaries(df)


def alert_null_total(df) -> DataFrame:
    s = _of(df)
    totals = s.nulls().agg(F.sum("nulls").alias("nulls"), F.sum("rows").alias("cells"))
    totals = totals.withColumn("pct", F.col("nulls") * 100.0 / F.greatest(F.col("cells"), F.lit(1)))
    hit = totals.filter(F.col("pct") > NULL_CELLS_WARNING)
    return _alert(
        hit, F.when(F.col("pct") > NULL_CELLS_CRITICAL, "CRITICAL").otherwise("WARNING"), "Data Quality",
        _text(_num(F.col("pct"), 1), "% of all cells are empty"), _text(F.col("nulls"), " of ", F.col("cells"), " cells hold no value."),
        "Find the columns concerned and decide whether to fill them or leave them out.", value=F.col("pct"), rule=1,
    )


def alert_null_worst(df) -> DataFrame:
    s = _of(df)
    worst = s.nulls().orderBy(F.desc("nulls"), "position").limit(1)
    worst = worst.withColumn("pct", F.col("nulls") * 100.0 / F.greatest(F.col("rows"), F.lit(1))).filter(F.col("pct") > NULL_COLUMN_WARNING)
    return _alert(
        worst, "WARNING", "Data Quality", _text(F.col("column"), " is empty in ", _num(F.col("pct"), 0), "% of rows"),
        _text(F.col("nulls"), " rows have no ", F.col("column"), "."), "Leave the column out of models or fill it.",
        F.col("column"), F.col("pct"), 2,
    )


def alert_duplicates(df) -> DataFrame:
    hit = _of(df).duplicates().filter("duplicates > 0")
    return _alert(
        hit, F.when(F.col("duplicate_pct") > DUPLICATE_WARNING, "WARNING").otherwise("INFO"), "Data Quality",
        _text(F.col("duplicates"), " rows repeat an earlier row"), _text(_num(F.col("duplicate_pct"), 1), "% of rows are exact repeats."),
        "Check whether the repeats are real events; drop them if not.", value=F.col("duplicates"), rule=3,
    )


def _outlier_base(s: Summaries) -> DataFrame:
    return s.numbers().filter((F.col("non_null") >= OUTLIER_MIN_ROWS) & (F.col("p75") - F.col("p25") != 0))


def alert_extreme_outliers(df) -> DataFrame:
    hit = _outlier_base(_of(df)).filter("outliers_1 > 0")
    return _alert(
        hit, "CRITICAL", "Outliers", _text(F.col("column"), " has ", F.col("outliers_1"), " extreme values"),
        _text("They lie more than 4 IQR beyond the quartiles. Range ", _num(F.col("min")), " to ", _num(F.col("max")), ", median ", _num(F.col("median")), "."),
        "Look at these rows: correct or cap errors, keep true events apart.", F.col("column"), F.col("outliers_1"), 4,
    )


def alert_moderate_outliers(df) -> DataFrame:
    base = _outlier_base(_of(df)).filter("outliers_1 = 0")
    hit = base.filter(F.col("outliers") > F.col("non_null") * OUTLIER_SHARE)
    return _alert(
        hit, "WARNING", "Outliers", _text(F.col("column"), " has ", F.col("outliers"), " values outside the usual range"),
        _text(_num(F.col("outliers") * 100.0 / F.col("non_null"), 0), "% of values lie more than 1.5 IQR beyond the quartiles."),
        "Look at the distribution; a log scale may help.", F.col("column"), F.col("outliers"), 4,
    )


def alert_skew(df) -> DataFrame:
    hit = _of(df).numbers().filter((F.col("non_null") >= SKEW_MIN_ROWS) & (F.abs("skew") > SKEW_LIMIT))
    right = F.col("skew") > 0
    return _alert(
        hit, "WARNING", "Distribution", _text(F.col("column"), " is strongly skewed to the ", F.when(right, "right").otherwise("left")),
        _text("Skewness is ", _num(F.col("skew")), "."),
        F.when(right, "Apply a log transform before modelling.").otherwise("Apply a square root transform before modelling."),
        F.col("column"), F.round("skew", 2), 6,
    )


def alert_correlation(df) -> DataFrame:
    s = _of(df)
    width = len(s.df.columns)
    hit = s.correlations().filter(F.abs("r") > CORRELATION_INFO).withColumn("position", F.col("i") * width + F.col("j"))
    strong = F.abs("r") > CORRELATION_WARNING
    return _alert(
        hit, F.when(strong, "WARNING").otherwise("INFO"), "Correlation",
        _text(F.col("a"), " and ", F.col("b"), F.when(strong, " carry nearly the same information").otherwise(" move together")),
        _text("Their correlation is ", _num(F.col("r")), "."),
        F.when(strong, "Use only one of the two in a model.").otherwise("Look at their scatter plot."),
        _text(F.col("a"), " / ", F.col("b")), F.round("r", 2), 7,
    )


def trend_stats(df: DataFrame, max_numeric: int | None = None) -> DataFrame:
    """Per (date, number): rows, slope per day, r, p and the change over the whole span in percent of the mean."""
    roles = column_roles(df)
    numbers = roles.numeric if max_numeric is None else roles.numeric[:max_numeric]
    rows, names = [], [(d, n) for d in roles.date for n in numbers]
    for d, c in names:
        y = F.col(f"`{c}`").cast("double")
        seconds = F.unix_micros(F.col(f"`{d}`").cast("timestamp")) / 1e6
        rows.append((F.when(y.isNotNull(), seconds), F.when(seconds.isNotNull(), y)))
    if not names:
        return df.sparkSession.createDataFrame([], "position long, date string, column string, n long, slope double, r double, change double")
    starts = df.agg(F.struct(*[F.min(t).alias(f"t{i}") for i, (t, _) in enumerate(rows)]))
    cells = []
    for i, (t, y) in enumerate(rows):
        cells += [F.lit(i), F.floor((t - F.col(f"_s.t{i}")) / 86400).cast("double"), y]
    long = with_summary(df, "_s", starts).select(F.stack(F.lit(len(rows)), *cells).alias("_p", "_d", "_y"))
    day, y = F.col("_d"), F.col("_y")
    slope = F.try_divide(F.regr_sxy(y, day), F.regr_sxx(y, day))
    # Fixed value: smallest size the mean is taken to have.
    change = slope * F.max(day) / F.greatest(F.abs(F.avg(y)), F.lit(1e-9)) * 100
    found = long.groupBy("_p").agg(
        F.regr_count(y, day).alias("n"), slope.alias("slope"), pearson(y, day).alias("r"), change.alias("change")
    )
    listed = df.sparkSession.createDataFrame([(i, d, c) for i, (d, c) in enumerate(names)], "position long, date string, column string")
    return listed.join(found, listed["position"] == found["_p"]).drop("_p")


def alert_trend(df, max_numeric: int | None = None) -> DataFrame:
    """A trend with p below the limit and strong enough. ``max_numeric`` limits the numeric columns looked at."""
    s = df if isinstance(df, Summaries) else Summaries(df, max_numeric)
    stats = s.trends().collect()
    kept = [r for r in stats if r.r is not None and r.n >= TREND_MIN_ROWS and abs(r.r) > TREND_R and pearson_p(r.r, r.n - 2) < TREND_P]
    schema = "position long, date string, column string, n long, slope double, r double, change double"
    hit = s.df.sparkSession.createDataFrame([tuple(r) for r in kept], schema)
    return _alert(
        hit, F.when(F.abs("change") > TREND_CHANGE, "WARNING").otherwise("INFO"), "Trend",
        _text(F.col("column"), F.when(F.col("slope") > 0, " rises").otherwise(" falls"), " over time"),
        _text("Against ", F.col("date"), ": r = ", _num(F.col("r")), ", about ", _num(F.col("change"), 0), "% over the whole span."),
        "Find out what drives the change.", F.col("column"), F.round("change", 2), 8,
    )


def alert_low_variance(df) -> DataFrame:
    s = _of(df)
    stats = s.numbers().filter(F.col("non_null") >= VARIATION_MIN_ROWS).join(s.distincts(), "column")
    variation = F.when(F.col("mean") == 0, 0.0).otherwise(F.try_divide(F.col("std"), F.abs("mean")))
    hit = stats.withColumn("cv", variation).filter((F.col("cv") < VARIATION_LIMIT) & (F.col("distinct") > 1))
    return _alert(
        hit, "INFO", "Data Quality", _text(F.col("column"), " hardly varies"), _text("Its spread is ", _num(F.col("cv") * 100, 2), "% of its mean."),
        "It adds little to a model; consider leaving it out.", F.col("column"), F.col("cv"), 9,
    )


def alert_imbalance(df) -> DataFrame:
    s = _of(df)
    share = F.col("top_rows") / F.nullif(F.col("rows") - F.col("nulls"), F.lit(0))
    stats = s.categories().join(s.nulls().select("column", "rows", "nulls"), "column").withColumn("share", share)
    hit = stats.filter((F.col("distinct") >= 2) & (F.col("share") > IMBALANCE_SHARE))
    return _alert(
        hit, "INFO", "Imbalance", _text(F.col("top"), " dominates ", F.col("column")),
        _text(_num(F.col("share") * 100, 0), "% of values are ", F.col("top"), "."),
        "As a model target this column needs class weights or stratified samples.", F.col("column"), F.col("share"), 10,
    )


def alert_ml_anomaly(df, id_cols: Sequence[str]) -> DataFrame:
    s = _of(df)
    feats = column_roles(s.df).numeric
    empty = s.df.sparkSession.createDataFrame([], "flagged long, total long")
    found = empty
    if len(feats) >= 2 and s.df.dropna(subset=feats).limit(FOREST_MIN_ROWS).count() >= FOREST_MIN_ROWS:
        scored = isolation_forest(s.df, id_cols, feats, FOREST_TREES, FOREST_CONTAMINATION, keep=())
        found = scored.agg(F.count_if("is_anomaly").alias("flagged"), F.count("*").alias("total"))
    hit = found.filter("flagged > 0").withColumn("pct", F.col("flagged") * 100.0 / F.col("total"))
    return _alert(
        hit, F.when(F.col("pct") > FOREST_WARNING, "WARNING").otherwise("INFO"), "ML Anomaly",
        _text("Isolation forest flags ", F.col("flagged"), " rows"), _text(_num(F.col("pct"), 1), f"% of rows are unusual over {len(feats)} numeric columns."),
        "Look at the flagged rows.", value=F.col("flagged"), rule=11,
    )


def alert_complete(df) -> DataFrame:
    hit = _of(df).nulls().agg(F.sum("nulls").alias("nulls")).filter("nulls = 0")
    return _alert(hit, "GOOD", "Data Quality", F.lit("No empty cells"), F.lit("Every column is filled in every row."), "Nothing to do.", rule=12)


def alert_unique_rows(df) -> DataFrame:
    hit = _of(df).duplicates().filter("duplicates = 0")
    return _alert(hit, "GOOD", "Data Quality", F.lit("No repeated rows"), F.lit("Every row is different."), "Nothing to do.", rule=13)


def alert_report(df: DataFrame, id_cols: Sequence[str] | None = None, max_numeric: int | None = None) -> DataFrame:
    """All rules, most severe first, then in rule and column order. The forest runs only with ``id_cols``."""
    s, roles = Summaries(df, max_numeric), column_roles(df)
    needed = ["nulls", "duplicates"]
    if roles.numeric:
        needed += ["numbers", "distincts", "trends"] + (["correlations"] if len(roles.numeric) >= 2 else [])
    s.prefetch(needed + (["categories"] if roles.categorical else []))
    rules = [alert_null_total(s), alert_null_worst(s), alert_duplicates(s)]
    if roles.numeric:
        rules += [alert_extreme_outliers(s), alert_moderate_outliers(s), alert_skew(s)]
        if len(roles.numeric) >= 2:
            rules.append(alert_correlation(s))
        rules += [alert_trend(s), alert_low_variance(s)]
    if roles.categorical:
        rules.append(alert_imbalance(s))
    if id_cols:
        rules.append(alert_ml_anomaly(s, id_cols))
    rules += [alert_complete(s), alert_unique_rows(s)]
    merged = rules[0]
    for r in rules[1:]:
        merged = merged.unionByName(r)
    return merged.orderBy(_severity_rank(), "rule", "position").select(*FIELDS)


def _severity_rank() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per severity and in total, zeros kept."""
    labels = alerts.sparkSession.createDataFrame(list(enumerate(["TOTAL", *SEVERITIES])), "position long, severity string")
    each = F.explode(F.array(F.lit("TOTAL"), F.col("severity"))).alias("severity")
    counts = alerts.select(each).groupBy("severity").agg(F.count("*").alias("count"))
    joined = labels.join(counts, "severity", "left")
    return joined.select("position", "severity", F.coalesce("count", F.lit(0).cast("long")).alias("count")).orderBy("position")


def alert_filter(alerts: DataFrame, severities: Sequence[str] = SEVERITIES, categories: Sequence[str] | None = None) -> DataFrame:
    kept = alerts.filter(F.col("severity").isin(*severities))
    return kept if categories is None else kept.filter(F.col("category").isin(*categories))
