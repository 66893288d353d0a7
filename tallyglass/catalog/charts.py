"""Chart aggregates and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, timeseries
from .base import LINEITEM_GAPS, ORDERS_GAPS, query, rounded

HIERARCHY = """WITH p AS (SELECT CASE WHEN p_size = 7 THEN NULL ELSE p_brand END AS p_brand, p_type, p_retailprice FROM part)
SELECT p_brand, p_type, (2 - grouping(p_type))::BIGINT AS depth, round(sum(p_retailprice), 2) AS value,
round(sum(p_retailprice * p_retailprice) / sum(p_retailprice), 4) AS colour
FROM p WHERE p_brand IS NOT NULL AND p_type IS NOT NULL GROUP BY ROLLUP (p_brand, p_type) HAVING grouping(p_brand) = 0"""


@query("treemap", HIERARCHY)
def _(t):
    parts = t.part.withColumn("p_brand", F.expr("CASE WHEN p_size = 7 THEN NULL ELSE p_brand END"))
    return rounded(rounded(charts.hierarchy(parts, ["p_brand", "p_type"], "p_retailprice"), 2, "value"), 4, "colour")


@query(
    "sunburst",
    """SELECT l_returnflag, l_linestatus, (2 - grouping(l_linestatus))::BIGINT AS depth, round(sum(l_quantity), 2) AS value,
    round(sum(l_quantity * l_quantity) / sum(l_quantity), 4) AS colour FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING grouping(l_returnflag) = 0""",
)
def _(t):
    return rounded(rounded(charts.hierarchy(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity"), 2, "value"), 4, "colour")


@query("funnel", f"WITH {ORDERS_GAPS} SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def _(t):
    return rounded(charts.funnel(t.orders_gaps, "o_orderpriority", "o_totalprice"), 2, "total")


@query(
    "waterfall",
    """WITH s AS (SELECT p_brand AS label, round(sum(p_retailprice), 2) AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
    r AS (SELECT row_number() OVER (ORDER BY value DESC, label) AS position, * FROM s)
    SELECT position::BIGINT AS position, label, 'relative' AS measure, value, round(sum(value) OVER (ORDER BY position), 2) AS running FROM r
    UNION ALL SELECT 11, 'Total', 'total', round(sum(value), 2), round(sum(value), 2) FROM r""",
)
def _(t):
    return rounded(charts.waterfall(t.part, "p_retailprice", "p_brand", 10), 2, "value", "running")


@query(
    "waterfall_rows",
    """WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) AS position, c_acctbal AS value FROM customer ORDER BY c_custkey LIMIT 10)
    SELECT position::BIGINT AS position, (position - 1)::VARCHAR AS label, 'relative' AS measure, value, round(sum(value) OVER (ORDER BY position), 2) AS running FROM r
    UNION ALL SELECT 11, 'Total', 'total', round(sum(value), 2), round(sum(value), 2) FROM r""",
)
def _(t):
    return rounded(charts.waterfall(t.customer, "c_acctbal", None, 10, "c_custkey"), 2, "value", "running")


@query(
    "radar_means",
    """WITH k AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5), m AS (SELECT * FROM part SEMI JOIN k USING (p_brand))
    SELECT p_brand, 'p_size' AS axis, round(avg(p_size), 4) AS mean FROM m GROUP BY 1
    UNION ALL SELECT p_brand, 'p_retailprice', round(avg(p_retailprice), 4) FROM m GROUP BY 1
    UNION ALL SELECT p_brand, 'p_partkey', round(avg(p_partkey), 4) FROM m GROUP BY 1""",
)
def _(t):
    return rounded(charts.radar_means(t.part, ["p_size", "p_retailprice", "p_partkey"], "p_brand"), 4, "mean")


@query("bubble", "SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus FROM orders")
def _(t):
    return charts.project_sample(t.raw("orders"), ["o_totalprice", "o_custkey", "o_orderstatus"], "o_orderkey")


FLOWS = "f AS (SELECT o_orderstatus AS source, o_orderpriority AS target, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30)"
NODES = 'n AS (SELECT node, (row_number() OVER (ORDER BY node) - 1)::BIGINT AS "index" FROM (SELECT source AS node FROM f UNION SELECT target FROM f))'


@query(
    "sankey",
    f"""WITH {FLOWS}, {NODES} SELECT source, target, value, a."index" AS source_index, b."index" AS target_index
    FROM f JOIN n a ON a.node = source JOIN n b ON b.node = target""",
)
def _(t):
    return rounded(charts.sankey(t.orders, "o_orderstatus", "o_orderpriority", "o_totalprice")[1], 2, "value")


@query("sankey_nodes", f"WITH {FLOWS}, {NODES} SELECT * FROM n")
def _(t):
    return charts.sankey(t.orders, "o_orderstatus", "o_orderpriority", "o_totalprice")[0]


@query("parallel_coordinates", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(t):
    return charts.project_sample(t.raw("part"), ["p_size", "p_retailprice"], "p_partkey")


@query("scatter3d", "SELECT event_id, user_id, value, event_type FROM events")
def _(t):
    return charts.project_sample(t.raw("events"), ["user_id", "value", "event_type"], "event_id")


@query(
    "value_matrix",
    """SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0), 2) AS "F",
    round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0), 2) AS "O" FROM lineitem GROUP BY 1""",
)
def _(t):
    return rounded(charts.value_matrix(t.lineitem, "l_returnflag", "l_linestatus", "l_quantity", "sum", ["F", "O"]), 2, "F", "O")


@query("value_matrix_long", "SELECT p_brand, p_type, round(avg(p_retailprice), 4) AS value FROM part GROUP BY 1, 2")
def _(t):
    return rounded(charts.value_matrix(t.part, "p_brand", "p_type", "p_retailprice", "mean", wide=False), 4, "value")


@query(
    "value_matrix_map",
    """WITH c AS (SELECT o_orderstatus, o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
    SELECT o_orderstatus, count(*) AS cells, min(o_custkey) AS first_key, max(o_custkey) AS last_key, round(sum(v), 2) AS total FROM c GROUP BY 1""",
)
def _(t):
    """A column per customer would be too many for a pivot."""
    found = charts.value_map(t.orders, "o_orderstatus", "o_custkey", "o_totalprice")
    keys = F.map_keys("cells")
    total = F.aggregate(F.map_values("cells"), F.lit(0.0), lambda a, v: a + v)
    return found.select("o_orderstatus", F.size("cells").cast("long").alias("cells"), keys[0].alias("first_key"), F.element_at(keys, -1).alias("last_key"), F.round(total, 2).alias("total"))


DAILY = """d AS (SELECT CAST(ts AS DATE) AS period, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1)"""


@query("candlestick", f"WITH {DAILY} SELECT * FROM d")
def _(t):
    daily = timeseries.ohlc(t.events, "ts", "value", "D", ["event_id"])
    return timeseries.ohlc_rows(daily, "period", "open", "high", "low", "close")


@query(
    "ohlc_resample",
    """SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS period, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close
    FROM events GROUP BY 1""",
)
def _(t):
    return timeseries.ohlc(t.events, "ts", "value", "W", ["event_id"])


@query("lollipop", "SELECT p_brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return rounded(charts.top_categories(t.part, "p_brand", "p_retailprice", 20), 2, "total")


@query(
    "stacked_area",
    """WITH k AS (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)
    SELECT last_day(o_orderdate) AS period, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders SEMI JOIN k USING (o_orderpriority) GROUP BY 1, 2""",
)
def _(t):
    return rounded(charts.stacked_area(t.orders, "o_orderdate", "o_orderpriority", "o_totalprice", "M"), 2, "total")


@query(
    "histogram2d",
    """WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
    SELECT least(29, floor((l_quantity - a) / (b - a) * 30))::BIGINT AS x_bin, least(29, floor((l_extendedprice - c) / (d - c) * 30))::BIGINT AS y_bin, count(*) AS count
    FROM lineitem, e GROUP BY 1, 2""",
)
def _(t):
    return charts.histogram2d(t.lineitem, "l_quantity", "l_extendedprice", 30, 30)


@query(
    "histogram2d_marginals",
    """WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
    SELECT 'x' AS axis, least(29, floor((l_quantity - a) / (b - a) * 30))::BIGINT AS bin, count(*) AS count FROM lineitem, e GROUP BY 1, 2
    UNION ALL SELECT 'y', least(29, floor((l_extendedprice - c) / (d - c) * 30))::BIGINT, count(*) FROM lineitem, e GROUP BY 1, 2""",
)
def _(t):
    return charts.marginals(charts.histogram2d(t.lineitem, "l_quantity", "l_extendedprice", 30, 30))


@query(
    "bar_race",
    """WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, l_suppkey::VARCHAR AS supplier, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1, 2),
    k AS (SELECT supplier FROM m GROUP BY 1 ORDER BY sum(total) DESC, 1 LIMIT 10), f AS (SELECT * FROM m SEMI JOIN k USING (supplier))
    SELECT *, row_number() OVER (PARTITION BY period ORDER BY total DESC, supplier) AS rank, round((SELECT max(total) * 1.1 FROM f), 4)::DOUBLE AS axis_max FROM f""",
)
def _(t):
    li = t.lineitem.withColumn("supplier", F.col("l_suppkey").cast("string"))
    return rounded(rounded(charts.bar_race(li, "l_shipdate", "supplier", "l_quantity", 10), 2, "total"), 4, "axis_max")


# --- time series -------------------------------------------------------------------------------------------------
@query("ts_raw", f"WITH {ORDERS_GAPS} SELECT o_orderdate, o_totalprice, o_custkey FROM o WHERE o_orderdate IS NOT NULL")
def _(t):
    return timeseries.ts_raw(t.orders_gaps, "o_orderdate", ["o_totalprice", "o_custkey"])


# Orders of some months only, so that empty periods appear.
PARTIAL = "p AS (SELECT * FROM orders WHERE month(o_orderdate) NOT IN (4, 5, 6, 11))"


def _partial(t):
    return t.orders.filter(~F.month("o_orderdate").isin(4, 5, 6, 11))


def resample_sql(label: str, periods: str) -> str:
    return f"""WITH {PARTIAL}, s AS (SELECT {label} AS period, sum(o_totalprice) AS a, sum(o_custkey) AS b FROM p GROUP BY 1),
    r AS (SELECT {periods} AS period FROM s)
    SELECT r.period, round(coalesce(a, 0), 2) AS o_totalprice, coalesce(b, 0)::BIGINT AS o_custkey FROM r LEFT JOIN s USING (period)"""


FIRST_TO_LAST = "CAST(unnest(range({0}, {1} + INTERVAL 1 DAY, INTERVAL {2})) AS DATE)"
RESAMPLE = {
    "D": resample_sql("CAST(o_orderdate AS DATE)", FIRST_TO_LAST.format("min(period)", "max(period)", "1 DAY")),
    "W": resample_sql("CAST(date_trunc('week', o_orderdate) AS DATE) + 6", FIRST_TO_LAST.format("min(period)", "max(period)", "7 DAY")),
    "M": resample_sql("last_day(o_orderdate)", "last_day(CAST(unnest(range(date_trunc('month', min(period)), max(period) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE))"),
    "Q": resample_sql(
        "last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE))",
        "last_day(CAST(unnest(range(date_trunc('quarter', min(period)), max(period) + INTERVAL 1 DAY, INTERVAL 3 MONTH)) + INTERVAL 2 MONTH AS DATE))",
    ),
}


def _register_resample(name: str, freq: str):
    @query(name, RESAMPLE[freq])
    def _(t):
        return rounded(timeseries.resample(_partial(t), "o_orderdate", ["o_totalprice", "o_custkey"], freq), 2, "o_totalprice")


for _name, _freq in (("resample", "M"), ("resample_daily", "D"), ("resample_weekly", "W"), ("resample_quarterly", "Q")):
    _register_resample(_name, _freq)


@query(
    "rolling_average",
    """WITH s AS (SELECT last_day(o_orderdate) AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT period, round(v, 2) AS o_totalprice, round(CASE WHEN count(v) OVER a = 3 THEN avg(v) OVER a END, 2) AS o_totalprice_3_period,
    round(CASE WHEN count(v) OVER b = 7 THEN avg(v) OVER b END, 2) AS o_totalprice_7_period FROM s
    WINDOW a AS (ORDER BY period ROWS 2 PRECEDING), b AS (ORDER BY period ROWS 6 PRECEDING)""",
)
def _(t):
    monthly = timeseries.resample(t.orders, "o_orderdate", ["o_totalprice"], "M")
    averaged = timeseries.rolling_average(monthly, ["o_totalprice"])
    return rounded(averaged, 2, "o_totalprice", "o_totalprice_3_period", "o_totalprice_7_period")


def change_sql(periods: int) -> str:
    return f"""WITH s AS (SELECT last_day(o_orderdate) AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT period, round(v, 2) AS o_totalprice, round((v / lag(v, {periods}) OVER (ORDER BY period) - 1) * 100, 1) AS o_totalprice_pct_change FROM s"""


@query("pct_change", change_sql(1))
def _(t):
    monthly = timeseries.resample(t.orders, "o_orderdate", ["o_totalprice"], "M")
    return rounded(timeseries.pct_change(monthly, "o_totalprice"), 2, "o_totalprice")


@query("pct_change_yearly", change_sql(12))
def _(t):
    monthly = timeseries.resample(t.orders, "o_orderdate", ["o_totalprice"], "M")
    return rounded(timeseries.pct_change(monthly, "o_totalprice", 12), 2, "o_totalprice")


@query(
    "stacked_area_weekly",
    f"""WITH {LINEITEM_GAPS}, k AS (SELECT l_returnflag FROM li WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)
    SELECT CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS period, l_returnflag, round(sum(l_quantity), 2) AS total FROM li SEMI JOIN k USING (l_returnflag) GROUP BY 1, 2""",
)
def _(t):
    return rounded(charts.stacked_area(t.lineitem_gaps, "l_shipdate", "l_returnflag", "l_quantity", "W", 2), 2, "total")
