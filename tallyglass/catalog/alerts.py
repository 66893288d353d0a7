"""Alert rules. Texts are free wording, so the SQL checks severity, category, column and value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts
from ..session import scratch_folder
from ..sources import exports
from .base import LINEITEM_COLUMNS, LINEITEM_GAPS, Tables, query, rounded, union_all

KEPT = ["severity", "category", "column", "value"]


def _checked(found):
    return rounded(found.select(*KEPT), 4, "value")


def row(severity: str, category: str, column: str = "NULL::VARCHAR", value: str = "NULL::DOUBLE") -> str:
    return f"SELECT {severity} AS severity, '{category}' AS category, {column} AS \"column\", round(({value})::DOUBLE, 4) AS value"


GAPPY = "g AS (SELECT CASE WHEN l_linenumber < 4 THEN NULL ELSE l_discount END AS l_discount, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS l_tax, l_quantity FROM lineitem)"


def _gappy(t: Tables):
    return t.lineitem.selectExpr(
        "CASE WHEN l_linenumber < 4 THEN NULL ELSE l_discount END AS l_discount", "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS l_tax", "l_quantity"
    )


NULL_SHARE = "(count(*) - count(l_discount) + count(*) - count(l_tax)) * 100.0 / (3 * count(*))"


@query(
    "alert_null_total",
    f"WITH {GAPPY}, n AS (SELECT {NULL_SHARE} AS pct FROM g) {row(chr(39) + 'WARNING' + chr(39), 'Data Quality', value='pct').replace(chr(39) + 'WARNING' + chr(39), 'CASE WHEN pct > 20 THEN ' + chr(39) + 'CRITICAL' + chr(39) + ' ELSE ' + chr(39) + 'WARNING' + chr(39) + ' END')} FROM n WHERE pct > 5",
)
def _(t):
    return _checked(alerts.alert_null_total(_gappy(t)))


@query(
    "alert_null_worst",
    f"WITH {GAPPY}, n AS (SELECT (count(*) - count(l_discount)) * 100.0 / count(*) AS pct FROM g) {row(repr('WARNING'), 'Data Quality', repr('l_discount'), 'pct')} FROM n WHERE pct > 30",
)
def _(t):
    return _checked(alerts.alert_null_worst(_gappy(t)))


@query(
    "alert_duplicates",
    f"""WITH d AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem),
    n AS (SELECT (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS dups, (SELECT count(*) FROM d) AS total)
    {row("CASE WHEN dups * 100.0 / total > 5 THEN 'WARNING' ELSE 'INFO' END", 'Data Quality', value='dups')} FROM n WHERE dups > 0""",
)
def _(t):
    return _checked(alerts.alert_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity")))


# One column with extreme values, one with many moderate ones, one with none.
SPIKED = """s AS (SELECT CASE WHEN day(o_orderdate) = 13 THEN o_totalprice * 15 ELSE o_totalprice END AS spiked,
CASE WHEN day(o_orderdate) < 4 THEN 1100.0 ELSE day(o_orderdate) * 10.0 + 300 END::DOUBLE AS shifted, o_totalprice AS plain FROM orders)"""


def _spiked(t: Tables):
    return t.orders.selectExpr(
        "CASE WHEN day(o_orderdate) = 13 THEN o_totalprice * 15 ELSE o_totalprice END AS spiked",
        "CAST(CASE WHEN day(o_orderdate) < 4 THEN 1100.0 ELSE day(o_orderdate) * 10.0 + 300 END AS DOUBLE) AS shifted",
        "o_totalprice AS plain",
    )


def fence_rows(columns: list[str]) -> str:
    return union_all([
        f"""SELECT '{c}' AS c, count({c}) AS n, count(*) FILTER ({c} < a - 4 * (b - a) OR {c} > b + 4 * (b - a)) AS extreme,
        count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS moderate
        FROM s, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM s)"""
        for c in columns
    ])


FENCED = f"{SPIKED}, f AS ({fence_rows(['spiked', 'shifted', 'plain'])})"


@query("alert_extreme_outliers", f"WITH {FENCED} {row(repr('CRITICAL'), 'Outliers', 'c', 'extreme')} FROM f WHERE n >= 10 AND extreme > 0")
def _(t):
    return _checked(alerts.alert_extreme_outliers(_spiked(t)))


@query("alert_moderate_outliers", f"WITH {FENCED} {row(repr('WARNING'), 'Outliers', 'c', 'moderate')} FROM f WHERE n >= 10 AND extreme = 0 AND moderate > 0.1 * n")
def _(t):
    return _checked(alerts.alert_moderate_outliers(_spiked(t)))


SKEWED = "e AS (SELECT value * value AS squared, -value * value AS mirrored, user_id FROM events)"


@query(
    "alert_skew",
    f"WITH {SKEWED}, k AS ("
    + union_all([f"SELECT '{c}' AS c, count({c}) AS n, skewness({c}) AS g FROM e" for c in ("squared", "mirrored", "user_id")])
    + f") {row(repr('WARNING'), 'Distribution', 'c', 'round(g, 2)')} FROM k WHERE n >= 30 AND abs(g) > 3",
)
def _(t):
    skewed = t.events.selectExpr("value * value AS squared", "-value * value AS mirrored", "user_id")
    return _checked(alerts.alert_skew(skewed))


RELATED = """r AS (SELECT l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net, l_quantity AS quantity, l_quantity * 1500 + l_extendedprice * 0.9 AS mixed FROM lineitem)"""
NAMES = ["price", "net", "quantity", "mixed"]


@query(
    "alert_correlation",
    f"WITH {RELATED}, c AS ("
    + union_all([f"SELECT '{a} / {b}' AS pair, corr({a}, {b}) AS r FROM r" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]])
    + f") {row("CASE WHEN abs(r) > 0.9 THEN 'WARNING' ELSE 'INFO' END", 'Correlation', 'pair', 'round(r, 2)')} FROM c WHERE abs(r) > 0.75",
)
def _(t):
    related = t.lineitem.selectExpr(
        "l_extendedprice AS price", "l_extendedprice * (1 - l_discount) AS net", "l_quantity AS quantity", "l_quantity * 1500 + l_extendedprice * 0.9 AS mixed"
    )
    return _checked(alerts.alert_correlation(related))


TRENDING = """t AS (SELECT o_orderdate, o_totalprice + 200.0 * date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS rising,
1000000 - 5.0 * date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + o_custkey AS falling, o_totalprice AS plain FROM orders)"""
TREND_ROWS = union_all([
    f"""SELECT {i}::BIGINT AS position, 'o_orderdate' AS date, '{c}' AS "column", regr_count({c}, d) AS n, regr_slope({c}, d) AS slope, corr({c}, d) AS r,
    regr_slope({c}, d) * max(d) / greatest(abs(avg({c})), 1e-9) * 100 AS change FROM (SELECT *, date_diff('day', (SELECT min(o_orderdate) FROM t), o_orderdate) AS d FROM t)"""
    for i, c in enumerate(["rising", "falling", "plain"])
])


def _trending(t: Tables):
    return t.orders.selectExpr(
        "o_orderdate",
        "o_totalprice + 200.0D * datediff(o_orderdate, DATE '1995-01-01') AS rising",
        "1000000 - 5.0D * datediff(o_orderdate, DATE '1995-01-01') + o_custkey AS falling",
        "o_totalprice AS plain",
    )


@query("trend_stats", f"WITH {TRENDING}, k AS ({TREND_ROWS}) SELECT position, date, \"column\", n, round(slope, 4) AS slope, round(r, 5) AS r, round(change, 3) AS change FROM k")
def _(t):
    return rounded(rounded(rounded(alerts.trend_stats(_trending(t)), 4, "slope"), 5, "r"), 3, "change")


@query(
    "alert_trend",
    f"""WITH {TRENDING}, k AS ({TREND_ROWS})
    {row("CASE WHEN abs(change) > 30 THEN 'WARNING' ELSE 'INFO' END", 'Trend', '"column"', 'round(change, 2)')} FROM k WHERE n >= 20 AND abs(r) > 0.4""",
)
def _(t):
    return _checked(alerts.alert_trend(_trending(t)))


@query(
    "alert_low_variance",
    f"""WITH k AS (SELECT stddev_samp(1000 + l_tax) / abs(avg(1000 + l_tax)) AS cv FROM lineitem) {row(repr('INFO'), 'Data Quality', repr('nearly_flat'), 'cv')} FROM k WHERE cv < 0.01""",
)
def _(t):
    return _checked(alerts.alert_low_variance(t.lineitem.selectExpr("1000 + l_tax AS nearly_flat", "l_quantity", "5.0D AS flat")))


DOMINATED = "d AS (SELECT CASE WHEN month(o_orderdate) = 2 THEN 'rare' ELSE 'common' END AS kind, o_orderstatus, 'one' AS single FROM orders)"


@query(
    "alert_imbalance",
    f"WITH {DOMINATED}, k AS (SELECT count(*) FILTER (kind = 'common') / count(*) AS share FROM d) {row(repr('INFO'), 'Imbalance', repr('kind'), 'share')} FROM k WHERE share > 0.8",
)
def _(t):
    dominated = t.orders.selectExpr("CASE WHEN month(o_orderdate) = 2 THEN 'rare' ELSE 'common' END AS kind", "o_orderstatus", "'one' AS single")
    return _checked(alerts.alert_imbalance(dominated))


@query("alert_ml_anomaly")
def _(t):
    return alerts.alert_ml_anomaly(t.events, ["event_id"]).select(*alerts.FIELDS)


@query(
    "alert_complete",
    f"WITH n AS (SELECT {' + '.join(f'count(*) - count({c})' for c in LINEITEM_COLUMNS)} AS nulls FROM lineitem) {row(repr('GOOD'), 'Data Quality')} FROM n WHERE nulls = 0",
)
def _(t):
    return _checked(alerts.alert_complete(t.lineitem))


@query(
    "alert_unique_rows",
    f"WITH n AS (SELECT (SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS dups) {row(repr('GOOD'), 'Data Quality')} FROM n WHERE dups = 0",
)
def _(t):
    return _checked(alerts.alert_unique_rows(t.orders))


def _report(t: Tables):
    """The report on line items with gaps, repeated rows and related columns."""
    rows = t.lineitem_gaps.selectExpr(
        "l_quantity", "l_quantity * l_quantity * l_quantity AS cubed", "1000 + l_tax AS nearly_flat", "l_discount", "l_returnflag", "l_shipdate"
    )
    return alerts.alert_report(rows)


@query("alert_report")
def _(t):
    spiked = t.orders.withColumn("o_totalprice", F.expr("CASE WHEN day(o_orderdate) = 13 THEN o_totalprice * 15 ELSE o_totalprice END"))
    return alerts.alert_report(spiked, ["o_orderkey"])


RULES = (
    f"""WITH {LINEITEM_GAPS}, v AS (SELECT l_quantity, l_quantity ** 3 AS cubed, 1000 + l_tax AS nearly_flat, l_discount, l_returnflag, l_shipdate FROM li),
    n AS (SELECT (SELECT count(*) FROM v) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) AS dups, (SELECT count(*) FROM v) AS total),
    c AS (SELECT corr(l_quantity, cubed) AS r, stddev_samp(nearly_flat) / avg(nearly_flat) AS cv FROM v)
    {row("CASE WHEN dups * 100.0 / total > 5 THEN 'WARNING' ELSE 'INFO' END", 'Data Quality', value='dups')} FROM n WHERE dups > 0
    UNION ALL {row("CASE WHEN r > 0.9 THEN 'WARNING' ELSE 'INFO' END", 'Correlation', repr('l_quantity / cubed'), 'round(r, 2)')} FROM c WHERE r > 0.75
    UNION ALL {row(repr('INFO'), 'Data Quality', repr('nearly_flat'), 'cv')} FROM c WHERE cv < 0.01
    UNION ALL {row(repr('GOOD'), 'Data Quality')} FROM n WHERE dups = 0
    UNION ALL {row("CASE WHEN pct > 20 THEN 'CRITICAL' ELSE 'WARNING' END", 'Data Quality', value='pct')}
    FROM (SELECT (2 * count(*) - count(l_discount) - count(l_returnflag)) * 100.0 / (6 * count(*)) AS pct FROM v) WHERE pct > 5"""
)


@query("alert_report_rules", RULES)
def _(t):
    return _checked(_report(t))


@query(
    "alert_counts",
    f"""WITH a AS ({RULES}), s(position, severity) AS (VALUES (0, 'TOTAL'), (1, 'CRITICAL'), (2, 'WARNING'), (3, 'INFO'), (4, 'GOOD'))
    SELECT position::BIGINT AS position, severity, (SELECT count(*) FROM a WHERE s.severity IN ('TOTAL', a.severity)) AS count FROM s""",
)
def _(t):
    return alerts.alert_counts(_report(t))


@query("alert_filter", f"SELECT * FROM ({RULES}) WHERE severity IN ('WARNING', 'INFO') AND category IN ('Data Quality', 'Correlation')")
def _(t):
    return _checked(alerts.alert_filter(_report(t), ["WARNING", "INFO"], ["Data Quality", "Correlation"]))


@query("export_alerts", f"SELECT severity, category, \"column\", 'lineitem' AS \"table\" FROM ({RULES})")
def _(t):
    folder = scratch_folder(t.spark, "alerts")
    written = t.spark.read.option("header", True).csv(exports.export_alerts(_report(t), folder, "lineitem"))
    return written.select("severity", "category", "column", "table")
