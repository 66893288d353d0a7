"""Filters, quick aggregates and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from ..operators.filters import Filter
from .base import LINEITEM_GAPS, query, rounded, union_all

ROW = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
SELECT_ROW = f"SELECT {', '.join(ROW)} FROM"


@query("filter_numeric", f"{SELECT_ROW} lineitem WHERE l_quantity BETWEEN 10 AND 40 AND l_discount BETWEEN 0.02 AND 0.05")
def _(t):
    chosen = [Filter.num("l_quantity", 10, 40), Filter.num("l_discount", 0.02, 0.05)]
    return t.where("lineitem", chosen).select(*ROW)


@query("filter_category", f"WITH {LINEITEM_GAPS} {SELECT_ROW} li WHERE l_returnflag IN ('A', 'N')")
def _(t):
    return filters.apply_filters(t.lineitem_gaps, [Filter.isin("l_returnflag", ["A", "N"])]).select(*ROW)


@query("filter_category_many", "SELECT o_orderkey FROM orders WHERE o_custkey < 1200")
def _(t):
    """More chosen values than an IN list should hold: a semi join."""
    return t.where("orders", [Filter.isin("o_custkey", range(1200))]).select("o_orderkey")


@query("filter_date", "SELECT event_id FROM events WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-12'")
def _(t):
    return t.where("events", [Filter.date("ts", "2024-01-05", "2024-01-11")]).select("event_id")


@query("filter_date_midnight", "SELECT event_id FROM events WHERE ts >= DATE '2024-01-05' AND ts <= TIMESTAMP '2024-01-11 00:00:00'")
def _(t):
    return t.where("events", [Filter.date("ts", "2024-01-05", "2024-01-11", inclusive_day=False)]).select("event_id")


@query("filter_text", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring')")
def _(t):
    return t.where("part", [Filter.contains("p_name", "RING")]).select("p_partkey")


@query("filter_text_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)^(red|blue).*t$')")
def _(t):
    return t.where("part", [Filter.contains("p_name", "^(RED|blue).*t$", regex=True)]).select("p_partkey")


def _combined():
    return [
        Filter.num("l_quantity", 10, 40), Filter.isin("l_returnflag", ["A", "N"]),
        Filter.date("l_shipdate", "1996-01-01", "1998-12-31"), Filter.contains("l_linestatus", "o"),
    ]


COMBINED = """l_quantity BETWEEN 10 AND 40 AND l_returnflag IN ('A', 'N') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01'
AND contains(lower(l_linestatus), 'o')"""


@query("filter_combined", f"{SELECT_ROW} lineitem WHERE {COMBINED}")
def _(t):
    return t.where("lineitem", _combined()).select(*ROW)


@query(
    "filter_metrics",
    f"""WITH f AS (SELECT count(*) AS matching, sum(l_orderkey) AS s FROM lineitem WHERE {COMBINED}), n AS (SELECT count(*) AS total FROM lineitem)
    SELECT matching, round(matching * 100.0 / total, 1)::DOUBLE AS pct, total - matching AS filtered_out, 11::BIGINT AS columns, s::DOUBLE AS total_measure FROM f, n""",
)
def _(t):
    return filters.filter_metrics(t.raw("lineitem"), _combined())


FUNCTIONS = {"sum": "sum", "mean": "avg", "count": "count", "max": "max", "min": "min", "std": "stddev_samp"}


def _register_aggregates(fn: str):
    kind = "BIGINT" if fn == "count" else "DOUBLE"
    value = f"round({FUNCTIONS[fn]}(l_discount), 4)::{kind} AS value"

    @query(f"quick_agg_{fn}", f"WITH {LINEITEM_GAPS} SELECT {value} FROM li WHERE l_quantity BETWEEN 10 AND 40")
    def _(t):
        kept = filters.apply_filters(t.lineitem_gaps, [Filter.num("l_quantity", 10, 40)])
        result = filters.quick_agg(kept, "l_discount", fn)
        return result if fn == "count" else rounded(result, 4, "value")

    @query(f"group_agg_{fn}", f"WITH {LINEITEM_GAPS} SELECT l_returnflag, {value} FROM li WHERE l_quantity BETWEEN 10 AND 40 AND l_returnflag IS NOT NULL GROUP BY 1")
    def _(t):
        kept = filters.apply_filters(t.lineitem_gaps, [Filter.num("l_quantity", 10, 40)])
        result = filters.quick_agg(kept, "l_discount", fn, "l_returnflag")
        return result if fn == "count" else rounded(result, 4, "value")


for _fn in FUNCTIONS:
    _register_aggregates(_fn)


@query("project_columns", "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def _(t):
    return filters.project_columns(t.raw("lineitem"), ["l_orderkey", "l_quantity", "l_shipdate"])


@query("preview", "SELECT event_id, ts, user_id, event_type, value FROM events WHERE value >= 10 ORDER BY event_id LIMIT 500")
def _(t):
    kept = t.where("events", [Filter.num("value", 10)])
    return filters.preview(kept.drop("props"), "event_id")


@query("category_options", f"WITH {LINEITEM_GAPS} SELECT DISTINCT l_returnflag FROM li WHERE l_returnflag IS NOT NULL")
def _(t):
    return filters.category_options(t.lineitem_gaps, "l_returnflag")


BOUNDED = ["l_orderkey", "l_quantity", "l_extendedprice"]


@query("range_options", union_all([f"SELECT '{c}' AS \"column\", min({c})::VARCHAR AS \"min\", max({c})::VARCHAR AS \"max\" FROM lineitem" for c in BOUNDED]))
def _(t):
    return filters.range_options(t.lineitem.select(*BOUNDED))


@query("filter_null_key", f"WITH {LINEITEM_GAPS} SELECT count(*) AS n FROM li WHERE l_discount >= 0.0")
def _(t):
    """Null cells never pass a filter."""
    return filters.apply_filters(t.lineitem_gaps, [Filter.num("l_discount", 0.0)]).agg(F.count("*").alias("n"))
