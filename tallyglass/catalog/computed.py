"""Computed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import computed
from .base import ORDERS_GAPS, query, rounded
from .profile import histogram_sql


@query(
    "formula_column",
    "SELECT o_orderkey, o_totalprice / nullif(o_custkey, 0) + 1 AS ratio FROM orders",
)
def _(t):
    return computed.formula(t.orders, "ratio", "try_divide(o_totalprice, o_custkey) + 1").select("o_orderkey", "ratio")


EQUAL_WIDTH = """WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events), w AS (SELECT a, b, (b - a) / 6 AS s FROM e)
SELECT event_id, ((value > a - (b - a) * 0.001)::INT + (value > 1.0::DOUBLE * s + a)::INT + (value > 2.0::DOUBLE * s + a)::INT + (value > 3.0::DOUBLE * s + a)::INT
 + (value > 4.0::DOUBLE * s + a)::INT + (value > 5.0::DOUBLE * s + a)::INT - 1)::BIGINT AS value_bin FROM events, w"""


@query("bin_equal_width", EQUAL_WIDTH)
def _(t):
    return computed.bin_equal_width(t.events, "value", 6).select("event_id", "value_bin")


QUARTER_BINS = """WITH q AS (SELECT list_distinct(quantile_cont(l_quantity, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
greatest(len(list_filter(edges, lambda e: e < l_quantity)) - 1, 0)::BIGINT AS l_quantity_bin FROM lineitem, q"""


@query("bin_quantile", QUARTER_BINS)
def _(t):
    binned = computed.bin_quantile(t.lineitem, "l_quantity", 5)
    return binned.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity_bin")


@query(
    "bin_custom",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_acctbal <= 1000 THEN 0 WHEN c_acctbal > 1000 AND c_acctbal <= 5000 THEN 1
    WHEN c_acctbal > 5000 AND c_acctbal <= 9000 THEN 2 END::BIGINT AS c_acctbal_bin FROM customer""",
)
def _(t):
    return computed.bin_custom(t.customer, "c_acctbal", [0, 1000, 5000, 9000]).select("c_custkey", "c_acctbal_bin")


@query("bin_preview", f"WITH b AS ({EQUAL_WIDTH}) SELECT value_bin, count(*) AS count FROM b GROUP BY 1")
def _(t):
    return computed.bin_preview(computed.bin_equal_width(t.events, "value", 6), "value_bin")


RANKS = {
    "average": "(2 * rank() OVER v + count(*) OVER (PARTITION BY o_orderpriority, x) - 1) / 2.0::DOUBLE",
    "min": "rank() OVER v",
    "max": "rank() OVER v + count(*) OVER (PARTITION BY o_orderpriority, x) - 1",
    "dense": "dense_rank() OVER v",
    "ordinal": "row_number() OVER (PARTITION BY o_orderpriority ORDER BY x DESC NULLS LAST, o_orderkey)",
}


def _register_rank(method: str):
    sql = f"""WITH {ORDERS_GAPS}, r AS (SELECT o_orderkey, o_orderpriority, floor(o_totalprice / 1000) AS x FROM o)
    SELECT o_orderkey, CASE WHEN x IS NOT NULL THEN {RANKS[method]} END::{'DOUBLE' if method == 'average' else 'BIGINT'} AS x_rank
    FROM r WINDOW v AS (PARTITION BY o_orderpriority ORDER BY x DESC NULLS LAST)"""

    @query(f"rank_{method}", sql)
    def _(t):
        rows = t.orders_gaps.withColumn("x", F.floor(F.col("o_totalprice") / 1000).cast("double"))
        ranked = computed.rank_column(rows, "x", method, partition_by=["o_orderpriority"], id_cols=["o_orderkey"])
        return ranked.select("o_orderkey", "x_rank")


for _method in computed.RANK_METHODS:
    _register_rank(_method)


@query("rank_whole_table", "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice)::BIGINT AS o_totalprice_rank FROM orders")
def _(t):
    """Ranked over the whole table; a small task size forces the bucketed plan."""
    ranked = computed.rank_column(t.orders, "o_totalprice", "min", ascending=True, id_cols=["o_orderkey"], rows_per_task=5000)
    return ranked.select("o_orderkey", "o_totalprice_rank")


SCALES = {
    "minmax": "(c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ())",
    "zscore": "(c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER ()",
    "log": "ln(1 + greatest(c_acctbal, 0))",
    "sqrt": "sqrt(greatest(c_acctbal, 0))",
}


def _register_scale(method: str):
    @query(f"scale_{method}", f"SELECT c_custkey, round({SCALES[method]}, 6) AS c_acctbal_norm FROM customer")
    def _(t):
        return rounded(computed.scale(t.customer, "c_acctbal", method).select("c_custkey", "c_acctbal_norm"), 6, "c_acctbal_norm")


for _method in SCALES:
    _register_scale(_method)


_SIDE = "SELECT '{0}' AS side, * FROM ({1})"


@query(
    "before_after",
    "WITH s AS (SELECT c_acctbal, sqrt(greatest(c_acctbal, 0)) AS scaled FROM customer) "
    + _SIDE.format("before", histogram_sql("s", "c_acctbal", 30))
    + " UNION ALL "
    + _SIDE.format("after", histogram_sql("s", "scaled", 30)),
)
def _(t):
    scaled = computed.scale(t.customer, "c_acctbal", "sqrt", "scaled")
    return rounded(computed.before_after(scaled, "c_acctbal", "scaled"), 6, "low", "high")


ROLLING = {"mean": "avg", "sum": "sum", "std": "stddev_samp", "min": "min", "max": "max"}


def _register_rolling(fn: str):
    sql = f"""WITH {ORDERS_GAPS} SELECT o_orderkey, round(CASE WHEN count(o_totalprice) OVER w = 5 THEN {ROLLING[fn]}(o_totalprice) OVER w END, 2) AS rolled FROM o
    WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS 4 PRECEDING)"""

    @query(f"rolling_{fn}", sql)
    def _(t):
        rolled = computed.rolling_column(
            t.orders_gaps, "o_totalprice", 5, fn, ["o_orderdate", "o_orderkey"], ["o_orderstatus"], "rolled"
        )
        return rounded(rolled.select("o_orderkey", "rolled"), 2, "rolled")


for _fn in ROLLING:
    _register_rolling(_fn)


@query(
    "rolling_whole_table",
    """SELECT event_id, round(CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END, 6) AS rolled FROM events
    WINDOW w AS (ORDER BY ts, event_id ROWS 6 PRECEDING)""",
)
def _(t):
    """Over the whole table in time order; a small task size forces the bucketed plan."""
    rolled = computed.rolling_column(t.events, "value", 7, "mean", ["ts", "event_id"], name="rolled", rows_per_task=3000)
    return rounded(rolled.select("event_id", "rolled"), 6, "rolled")


@query("pct_of_total", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER () * 100, 8) AS o_totalprice_pct FROM orders")
def _(t):
    return rounded(computed.pct_of_total(t.orders, "o_totalprice").select("o_orderkey", "o_totalprice_pct"), 8, "o_totalprice_pct")


@query(
    "pct_of_group",
    f"""WITH {ORDERS_GAPS} SELECT o_orderkey, round(CASE WHEN o_orderpriority IS NOT NULL THEN o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority) * 100 END, 8) AS o_totalprice_pct FROM o""",
)
def _(t):
    shares = computed.pct_of_total(t.orders_gaps, "o_totalprice", "o_orderpriority", ["o_orderkey"])
    return rounded(shares.select("o_orderkey", "o_totalprice_pct"), 8, "o_totalprice_pct")


@query("lag_column", "SELECT o_orderkey, lag(o_totalprice, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS o_totalprice_lag3 FROM orders")
def _(t):
    return computed.lag_column(t.orders, "o_totalprice", 3, ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "o_totalprice_lag3")


@query("lag_whole_table", "SELECT event_id, lag(value, 12) OVER (ORDER BY ts, event_id) AS value_lag12 FROM events")
def _(t):
    lagged = computed.lag_column(t.events, "value", 12, ["ts", "event_id"], rows_per_task=3000)
    return lagged.select("event_id", "value_lag12")


@query("computed_preview", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice FROM orders ORDER BY o_orderkey LIMIT 20")
def _(t):
    added = computed.formula(t.orders, "twice", "round(o_totalprice * 2, 2)")
    return computed.computed_preview(added, ["twice"], "o_orderkey")


@query("clear_computed", "SELECT count(*) AS rows, 6::BIGINT AS columns FROM orders")
def _(t):
    cleared = computed.clear_computed(computed.formula(t.orders, "twice", "o_totalprice * 2"), ["twice"])
    return cleared.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(cleared.columns)).cast("long"))


# Ranks of other types of keys, with groups cut into small ranges.
_TYPED = {
    "text": ("o_orderpriority || '-' || CAST(o_custkey AS string)", "o_orderpriority || '-' || o_custkey::VARCHAR"),
    "wide": ("1152921504606846976 + o_custkey", "1152921504606846976 + o_custkey"),
    "decimal": ("CAST('123456789012345678901.25' AS DECIMAL(30, 2)) + o_custkey", "123456789012345678901.25::DECIMAL(30, 2) + o_custkey"),
    "day": ("CAST(o_orderdate AS DATE)", "CAST(o_orderdate AS DATE)"),
}


def _register_typed(name: str, spark_key: str, duck_key: str):
    @query(
        f"rank_{name}_keys",
        f"""WITH k AS (SELECT o_orderkey, {duck_key} AS k FROM orders) SELECT o_orderkey, rank() OVER w + (count(*) OVER (PARTITION BY k) - 1) / 2.0::DOUBLE AS average_rank,
        row_number() OVER (ORDER BY k DESC, o_orderkey) AS ordinal_rank FROM k WINDOW w AS (ORDER BY k DESC)""",
    )
    def _(t):
        rows = t.orders.select("o_orderkey", F.expr(spark_key).alias("k"))
        ranked = computed.rank_column(rows, "k", "average", name="average_rank", rows_per_task=2000)
        return computed.rank_column(ranked, "k", "ordinal", id_cols=["o_orderkey"], name="ordinal_rank", rows_per_task=2000).drop("k")


for _name, _keys in _TYPED.items():
    _register_typed(_name, *_keys)
