"""Sources, column roles, profile, dashboard and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import normalize_nan
from ..operators import charts, computed, dashboard, distributions, profile, roles
from ..operators.charts import value_counts
from ..operators.segments import cluster_means
from ..plans.sampling import sample_rows
from ..session import scratch_folder
from ..sources import exports, tables
from .base import LINEITEM_COLUMNS, LINEITEM_GAPS, LINEITEM_NUMERIC, query, rounded, union_all

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
WIDTHS = dict(zip(TABLES, [2, 3, 5, 4, 6, 6, 11, 6, 5, 3, 3, 2, 3, 4]))


# --- sources -----------------------------------------------------------------------------------------------------
@query("read_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def _(t):
    """Written as CSV with a header and read back with inferred types."""
    path = scratch_folder(t.spark, "orders")
    exports.export(t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("date")), path, "csv")
    back = tables.read_table(t.spark, path, "csv")
    return back.select(
        F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date")
    )


@query("read_workbook", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    tables.read_workbook(t.spark, {n: t.path(n) for n in ("nation", "region")})
    return t.spark.sql("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


@query("table_summary", union_all([f"SELECT '{n}' AS \"table\", count(*) AS rows, CAST({w} AS BIGINT) AS columns FROM {n}" for n, w in WIDTHS.items()]))
def _(t):
    return tables.table_summary({n: t.raw(n) for n in TABLES})


@query("export_rows", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 25")
def _(t):
    path = scratch_folder(t.spark, "rows")
    exports.export(t.raw("lineitem").filter("l_quantity >= 25"), path, "parquet", ["l_orderkey", "l_linenumber", "l_quantity"])
    return t.spark.read.parquet(path)


@query("export_pivot", "SELECT l_returnflag, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_quantity >= 25 GROUP BY 1")
def _(t):
    folder = scratch_folder(t.spark, "pivot")
    written = exports.export_pivot(t.raw("lineitem").filter("l_quantity >= 25"), folder, "l_returnflag", "l_quantity", "parquet")
    return rounded(t.spark.read.parquet(written["pivot"]), 2, "total")


# --- roles -------------------------------------------------------------------------------------------------------
@query(
    "coerce_dates",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS DATE) AS order_date,
       CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'set' END AS sentiment FROM orders""",
)
def _(t):
    """Dates written in two formats plus text that is no date; ``sentiment`` contains a date word and must stay."""
    text = F.when(F.col("o_orderstatus") == "P", F.lit("pending")).when(
        F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy")
    ).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    sentiment = F.when(F.col("o_orderstatus") == "P", "pending").otherwise("set")
    written = t.orders.select("o_orderkey", text.alias("order_date"), sentiment.alias("sentiment"))
    return roles.coerce_dates(written).withColumn("order_date", F.col("order_date").cast("date"))


@query(
    "column_roles",
    union_all([
        f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", '{'numeric' if i < 8 else 'categorical' if i < 10 else 'date'}' AS role, count(*) AS non_null FROM lineitem"
        for i, c in enumerate(LINEITEM_COLUMNS)
    ]),
)
def _(t):
    li = t.lineitem
    counts = profile.per_column(li, {c: {"non_null": F.count(c)} for c in li.columns})
    return roles.roles_frame(li).join(counts, "column").select("position", "column", "role", "non_null")


@query("merge_computed", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity * 2 AS twice FROM lineitem")
def _(t):
    added = roles.with_computed(t.lineitem, {"net": "round(l_extendedprice * (1 - l_discount), 4)", "twice": F.col("l_quantity") * 2})
    return added.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net", "twice")


NULL_CELLS = f"(SELECT {' + '.join(f'count(*) - count({c})' for c in LINEITEM_COLUMNS)} FROM li)"
DUPLICATES = "(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM li)) FROM li)"
SCORE = f"""round(greatest(0, 100 - {NULL_CELLS} * 100.0 / ((SELECT count(*) FROM li) * 11)
  - least({DUPLICATES} * 20.0 / (SELECT count(*) FROM li), 20)), 1)"""


@query(
    "table_banner",
    f"""WITH {LINEITEM_GAPS} SELECT (SELECT count(*) FROM li) AS rows, 11::BIGINT AS columns, 8::BIGINT AS n_numeric, 2::BIGINT AS n_categorical,
    1::BIGINT AS n_date, 'l_orderkey, l_partkey, l_suppkey, l_linenumber' AS numeric_names, 'l_returnflag, l_linestatus' AS categorical_names,
    'l_shipdate' AS date_names, CAST({SCORE} AS DOUBLE) AS score, CASE WHEN {SCORE} >= 90 THEN 'good' WHEN {SCORE} >= 70 THEN 'fair' ELSE 'poor' END AS grade""",
)
def _(t):
    return roles.table_banner(t.lineitem_gaps)


# --- profile -----------------------------------------------------------------------------------------------------
def _null_rows(cols=LINEITEM_COLUMNS):
    return union_all([f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0 / count(*), 1)::DOUBLE AS null_pct FROM li" for c in cols])


@query("null_stats", f"WITH {LINEITEM_GAPS} {_null_rows()}")
def _(t):
    return profile.null_stats(t.lineitem_gaps)


@query("distinct_stats", f"WITH {LINEITEM_GAPS} " + union_all([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM li" for c in LINEITEM_COLUMNS]))
def _(t):
    return profile.distinct_stats(t.lineitem_gaps)


COPIED = "d AS (SELECT l_returnflag, l_linestatus, l_quantity, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS l_discount FROM lineitem)"


@query(
    "duplicate_count",
    f"""WITH {COPIED}, g AS (SELECT count(*) AS n FROM d GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount)
    SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates, round(sum(n - 1) * 100.0 / sum(n), 4)::DOUBLE AS duplicate_pct FROM g""",
)
def _(t):
    copied = t.lineitem.selectExpr(
        "l_returnflag", "l_linestatus", "l_quantity", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS l_discount"
    )
    return rounded(profile.duplicate_count(copied), 4, "duplicate_pct")


@query(
    "quality_score",
    f"""WITH {COPIED}, li AS (SELECT * FROM d), n AS (SELECT count(*) AS rows, count(*) - count(l_discount) AS null_cells FROM d),
    u AS (SELECT count(*) AS distincts FROM (SELECT DISTINCT * FROM d))
    SELECT rows, null_cells, rows - distincts AS duplicates,
    round(greatest(0, 100 - null_cells * 100.0 / (rows * 4) - least((rows - distincts) * 20.0 / rows, 20)), 1)::DOUBLE AS score FROM n, u""",
)
def _(t):
    copied = t.lineitem.selectExpr(
        "l_returnflag", "l_linestatus", "l_quantity", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS l_discount"
    )
    return profile.quality_score(copied)


def numeric_rows(cols, source="li"):
    """SQL of the display profile, one SELECT per column."""
    return union_all([
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, round(min({c}), 3)::DOUBLE AS "min", round(max({c}), 3)::DOUBLE AS "max",
        round(avg({c}), 3) AS mean, round(median({c}::DOUBLE), 3) AS median, round(stddev_samp({c}), 3) AS std, round(sum({c}), 2)::DOUBLE AS "sum",
        round(quantile_cont({c}::DOUBLE, 0.25), 3) AS p25, round(quantile_cont({c}::DOUBLE, 0.75), 3) AS p75, round(quantile_cont({c}::DOUBLE, 0.95), 3) AS p95,
        round(skewness({c}), 2) AS skew, round(kurtosis({c}), 2) AS kurt,
        (SELECT count(*) FROM {source}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM {source}) WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers
        FROM {source}"""
        for c in cols
    ])


@query("numeric_profile", f"WITH {LINEITEM_GAPS}, p AS ({numeric_rows(LINEITEM_NUMERIC)}) SELECT *, round(outliers * 100.0 / non_null, 1)::DOUBLE AS outlier_pct FROM p")
def _(t):
    return rounded(profile.numeric_profile(t.lineitem_gaps), 2, "sum")


@query(
    "iqr_outliers",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT 'value' AS "column", count(value) AS non_null, round(any_value(a - 1.5 * (b - a)), 4) AS low, round(any_value(b + 1.5 * (b - a)), 4) AS high,
    count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers,
    round(count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) * 100.0 / count(value), 1)::DOUBLE AS outlier_pct FROM events, q""",
)
def _(t):
    return rounded(profile.iqr_outliers(t.events, ["value"]), 4, "low", "high")


@query(
    "jarque_bera",
    """WITH m AS (SELECT count(x) AS n, avg(x) AS mu, var_pop(x) AS v FROM (SELECT l_quantity AS x FROM lineitem)),
    s AS (SELECT any_value(n) AS n, avg((l_quantity - mu) ** 3) / any_value(v) ** 1.5 AS g1, avg((l_quantity - mu) ** 4) / any_value(v) ** 2 - 3 AS g2 FROM lineitem, m)
    SELECT 'l_quantity' AS "column", n, round(n / 6.0 * (g1 * g1 + g2 * g2 / 4), 3) AS jb, round(exp(-(n / 6.0 * (g1 * g1 + g2 * g2 / 4)) / 2), 6) AS p FROM s""",
)
def _(t):
    return rounded(rounded(profile.jarque_bera(t.lineitem, ["l_quantity"]), 3, "jb"), 6, "p").drop("normal")


def _category_rows(cols):
    return union_all([
        f"""(SELECT '{c}' AS "column", {c} AS top, count(*) AS top_rows, round(count(*) * 100.0 / (SELECT count(*) FROM li), 1)::DOUBLE AS top_pct,
        (SELECT count(DISTINCT {c}) FROM li) AS "distinct" FROM li WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
        for c in cols
    ])


@query("categorical_profile", f"WITH {LINEITEM_GAPS} {_category_rows(['l_returnflag', 'l_linestatus'])}")
def _(t):
    return profile.categorical_profile(t.lineitem_gaps)


@query("profile_insights")
def _(t):
    skewed = t.events.withColumn("value", F.col("value") * F.col("value")).withColumn(
        "event_type", F.expr("CASE WHEN user_id > 20 THEN 'view' ELSE event_type END")
    )
    return profile.profile_insights(skewed)


@query(
    "quality_totals",
    """WITH e AS (SELECT * REPLACE (CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value) FROM events),
    q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM e)
    SELECT (SELECT count(*) - count(value) FROM e) AS total_nulls, round((SELECT (count(*) - count(value)) * 100.0 / (count(*) * 6) FROM e), 2)::DOUBLE AS null_pct_cells,
    0::BIGINT AS duplicates, (SELECT count(*) FROM e, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))
    + (SELECT count(*) FROM e, (SELECT quantile_cont(user_id::DOUBLE, 0.25) AS a, quantile_cont(user_id::DOUBLE, 0.75) AS b FROM e) WHERE user_id < a - 1.5 * (b - a) OR user_id > b + 1.5 * (b - a)) AS outliers,
    6::BIGINT AS columns""",
)
def _(t):
    return profile.quality_totals(t.events.withColumn("value", F.expr("CASE WHEN event_type = 'error' THEN NULL ELSE value END")))


@query("missing_ranked", f"WITH {LINEITEM_GAPS}, n AS ({_null_rows()}) SELECT * FROM n WHERE null_pct > 0")
def _(t):
    return profile.missing_ranked(t.lineitem_gaps)


@query(
    "outlier_ranked",
    f"WITH p AS ({numeric_rows(['event_id', 'user_id', 'value'], 'events')}) SELECT \"column\", outliers, round(outliers * 100.0 / non_null, 1)::DOUBLE AS outlier_pct, skew, kurt FROM p WHERE outliers > 0",
)
def _(t):
    return profile.outlier_ranked(t.events)


@query("null_pattern")
def _(t):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    return profile.null_pattern(t.lineitem_gaps, keys)


@query(
    "null_patterns_full",
    f"""WITH {LINEITEM_GAPS} SELECT concat_ws(',', CASE WHEN l_discount IS NULL THEN 'l_discount' END, CASE WHEN l_returnflag IS NULL THEN 'l_returnflag' END) AS missing_columns,
    count(*) AS rows FROM li GROUP BY 1""",
)
def _(t):
    return profile.null_patterns(t.lineitem_gaps)


_KINDS = ["numeric"] * 8 + ["categorical"] * 2 + ["date"]


@query(
    "schema_report",
    f"""WITH {LINEITEM_GAPS}, n AS ({_null_rows()}), p AS ({numeric_rows(LINEITEM_NUMERIC)}), c AS ({_category_rows(['l_returnflag', 'l_linestatus'])}),
    u AS ({union_all([f'SELECT {i}::BIGINT AS position, {chr(39)}{c}{chr(39)} AS "column", {chr(39)}{k}{chr(39)} AS type, count(DISTINCT {c}) AS "distinct", count({c}) AS non_null FROM li' for i, (c, k) in enumerate(zip(LINEITEM_COLUMNS, _KINDS))])})
    SELECT u.position, u."column", u.type, null_pct, u."distinct", u.non_null, "min", "max", mean, std, skew, outliers, top, top_pct
    FROM u JOIN n USING ("column") LEFT JOIN p USING ("column") LEFT JOIN c USING ("column")""",
)
def _(t):
    return profile.schema_report(t.lineitem_gaps)


_CARD = ["min", "max", "mean", "median", "std", "skew", "kurt", "p25", "p75", "p95", "outliers", "outlier_pct"]


@query(
    "stat_card",
    f"WITH p AS ({numeric_rows(['value'], 'events')}), f AS (SELECT *, round(outliers * 100.0 / non_null, 1) AS outlier_pct FROM p) "
    + union_all([f"SELECT '{s}' AS statistic, \"{s}\"::DOUBLE AS value FROM f" for s in _CARD]),
)
def _(t):
    return profile.stat_card(t.events, "value")


# --- dashboard ---------------------------------------------------------------------------------------------------
@query(
    "kpi_cards",
    "SELECT * FROM ("
    + union_all([f"SELECT '{c}' AS \"column\", round(sum({c}), 2)::DOUBLE AS total, round(avg({c}), 4) AS mean, count({c}) AS records FROM li" for c in LINEITEM_NUMERIC]).join(
        [f"WITH {LINEITEM_GAPS} ", ""]
    )
    + ') ORDER BY total DESC, "column" LIMIT 5',
)
def _(t):
    return rounded(rounded(dashboard.kpi_cards(t.lineitem_gaps), 2, "total"), 4, "mean")


@query(
    "auto_top_categories",
    "SELECT 'l_linestatus' AS category, l_linestatus AS label, 'l_extendedprice' AS measure, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_linestatus",
)
def _(t):
    return rounded(dashboard.auto_top_categories(t.lineitem), 2, "total")


def histogram_sql(table: str, col: str, bins: int, value="count"):
    return f"""WITH e AS (SELECT min({col}) AS a, max({col}) AS b FROM {table}),
    h AS (SELECT CASE WHEN a = b THEN 0 ELSE least({bins - 1}, floor(({col} - a) / (b - a) * {bins}))::BIGINT END AS bin, count(*) AS n FROM {table}, e WHERE {col} IS NOT NULL GROUP BY 1)
    SELECT i::BIGINT AS bin, coalesce(n, 0)::BIGINT AS {value}, round(a + i * ((b - a) / {bins}), 6) AS low, round(a + (i + 1) * ((b - a) / {bins}), 6) AS high
    FROM range({bins}) r(i) CROSS JOIN e LEFT JOIN h ON h.bin = i"""


@query("auto_histogram", histogram_sql("customer", "c_acctbal", 30))
def _(t):
    return rounded(distributions.histogram(t.customer, "c_acctbal", 30), 6, "low", "high")


@query("breakdown", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(t):
    return value_counts(t.part, "p_brand", 8)


@query("sample_rows", "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 500")
def _(t):
    return sample_rows(t.raw("events").select("event_id", "user_id", "value"), 500, "event_id")


@query("sample_rows_hash")
def _(t):
    return sample_rows(t.raw("events").select("event_id", "user_id", "value"), 500, "event_id", "hash")


@query(
    "auto_trend",
    """WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1),
    r AS (SELECT CAST(unnest(range(min(period), max(period) + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS DATE) AS period FROM w)
    SELECT r.period, round(coalesce(v, 0), 2) AS o_totalprice FROM r LEFT JOIN w USING (period)""",
)
def _(t):
    return rounded(dashboard.auto_trend(t.orders), 2, "o_totalprice")


# --- distributions -----------------------------------------------------------------------------------------------
@query("histogram", histogram_sql("events", "value", 40))
def _(t):
    return rounded(distributions.histogram(t.events, "value", 40), 6, "low", "high")


@query(
    "histogram_split",
    """WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events)
    SELECT least(39, floor((value - a) / (b - a) * 40))::BIGINT AS bin, event_type, count(*) AS count FROM events, e GROUP BY 1, 2""",
)
def _(t):
    return distributions.histogram(t.events, "value", 40, "event_type").select("bin", "event_type", "count")


@query(
    "value_breakdown",
    f"WITH {LINEITEM_GAPS} SELECT l_returnflag, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM li), 1)::DOUBLE AS pct FROM li WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
)
def _(t):
    return distributions.value_breakdown(t.lineitem_gaps, "l_returnflag", 15)


BOXES = """q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
b AS (SELECT e.*, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events e JOIN q USING (event_type))"""


@query(
    "box_stats",
    f"""WITH {BOXES} SELECT event_type, count(*) AS n, round(max(q1), 4) AS q1, round(max(median), 4) AS median, round(max(q3), 4) AS q3,
    min(value) FILTER (inside) AS lower_whisker, max(value) FILTER (inside) AS upper_whisker, count(*) FILTER (NOT inside) AS outliers FROM b GROUP BY 1""",
)
def _(t):
    return rounded(distributions.box_stats(t.events, "value", "event_type"), 4, "q1", "median", "q3")


@query("box_outliers", f"WITH {BOXES} SELECT event_id, event_type, value FROM b WHERE NOT inside")
def _(t):
    return distributions.box_outliers(t.events, "value", "event_type").select("event_id", "event_type", "value")


@query(
    "violin_density",
    """WITH s AS (SELECT event_type, count(value) AS n, min(value) AS lo, max(value) AS hi,
      1.059 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349) * count(value) ** -0.2 AS h FROM events GROUP BY 1),
    c AS (SELECT event_type, least(511, floor((value - lo) / (hi - lo) * 512)) AS cell, count(*) AS w FROM events JOIN s USING (event_type) GROUP BY 1, 2),
    g AS (SELECT *, lo + (cell + 0.5) * ((hi - lo) / 512) AS m FROM c JOIN s USING (event_type)),
    x AS (SELECT g.*, i, lo - 2 * h + i * ((hi - lo + 4 * h) / 99) AS x FROM g, range(100) r(i))
    SELECT event_type, i::BIGINT AS point, round(max(x), 6) AS x, round(sum(w * exp(-(((x - m) / h) * ((x - m) / h)) / 2) / (n * h * sqrt(2 * pi()))), 8) AS density FROM x GROUP BY 1, 2""",
)
def _(t):
    return rounded(rounded(distributions.kde(t.events, "value", "event_type"), 6, "x"), 8, "density")


@query("strip_points", "SELECT event_id, event_type, value FROM events")
def _(t):
    return sample_rows(t.raw("events").select("event_id", "event_type", "value"), None, "event_id")


def _infinite(t):
    """Values with both infinities and NaN, which counts as missing."""
    planted = "CASE WHEN event_id % 97 = 0 THEN 'Infinity' WHEN event_id % 89 = 0 THEN '-Infinity' WHEN event_id % 83 = 0 THEN 'NaN' ELSE value END"
    return normalize_nan(t.raw("events").select(F.expr(f"CAST({planted} AS DOUBLE)").alias("value")))


INFINITE = """e AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'inf'::DOUBLE WHEN event_id % 89 = 0 THEN '-inf'::DOUBLE WHEN event_id % 83 = 0 THEN NULL ELSE value END AS value FROM events)"""


@query(
    "quantiles_infinite",
    f"""WITH {INFINITE}, q AS (SELECT quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]) AS q, count(value) AS n FROM e)
    SELECT n AS non_null, round(q[2], 6) AS p25, round(q[3], 6) AS median, round(q[4], 6) AS p75, round(q[5], 6) AS p95,
    (SELECT count(*) FROM e WHERE value < q[2] - 1.5 * (q[4] - q[2]) OR value > q[4] + 1.5 * (q[4] - q[2])) AS outliers, q[1] AS "min", q[6] AS "max" FROM q""",
)
def _(t):
    stats = profile.numeric_stats(_infinite(t)).select("non_null", "p25", "median", "p75", "p95", "outliers", "min", "max")
    return rounded(stats, 6, "p25", "median", "p75", "p95")


@query(
    "histogram_infinite",
    f"""WITH {INFINITE}, f AS (SELECT value FROM e WHERE isfinite(value)), b AS (SELECT min(value) AS a, max(value) AS z FROM f),
    c AS (SELECT least(9, floor((value - a) / (z - a) * 10))::BIGINT AS bin, count(*) AS n FROM f, b GROUP BY 1)
    SELECT i AS bin, coalesce(n, 0)::BIGINT AS count, round(a + i * ((z - a) / 10), 6) AS low, round(a + (i + 1) * ((z - a) / 10), 6) AS high FROM range(10) r(i) LEFT JOIN c ON bin = i, b""",
)
def _(t):
    return rounded(distributions.histogram(_infinite(t), "value", 10), 6, "low", "high")


@query(
    "bin_equal_width_infinite",
    f"""WITH {INFINITE}, b AS (SELECT min(value) AS a, max(value) AS z FROM e WHERE isfinite(value)),
    g AS (SELECT [a - (z - a) * 0.001] || list_transform(range(1, 6), lambda i: i * ((z - a) / 6) + a) || [z] AS edges FROM b)
    SELECT CASE WHEN isfinite(value) THEN len(list_filter(edges, lambda e: e < value)) - 1 END::BIGINT AS bin, count(*) AS count FROM e, g GROUP BY 1""",
)
def _(t):
    return computed.bin_equal_width(_infinite(t), "value", 6, "bin").groupBy("bin").agg(F.count("*").alias("count"))


@query(
    "histogram2d_infinite",
    f"""WITH {INFINITE}, f AS (SELECT value, value * value AS square FROM e WHERE isfinite(value)),
    b AS (SELECT min(value) AS a, max(value) AS z, min(square) AS c, max(square) AS d FROM f)
    SELECT least(9, floor((value - a) / (z - a) * 10))::BIGINT AS x_bin, least(9, floor((square - c) / (d - c) * 10))::BIGINT AS y_bin, count(*) AS count FROM f, b GROUP BY 1, 2""",
)
def _(t):
    squared = _infinite(t).withColumn("square", F.when(F.abs("value") < float("inf"), F.col("value") * F.col("value")))
    return charts.histogram2d(squared, "value", "square", 10, 10)


@query(
    "qq_plot",
    f"""SELECT unnest(range(99))::BIGINT AS point,
    unnest(list_transform(quantile_cont(value, [{', '.join(str(0.01 + 0.98 * i / 98) for i in range(99))}]), lambda v: round(v, 6))) AS observed FROM events""",
)
def _(t):
    return rounded(distributions.qq_plot(t.events, "value", 99), 6, "observed").select("point", "observed")


@query(
    "histogram_grid",
    union_all([
        f"""SELECT '{c}' AS "column", CASE WHEN a = b THEN 0 ELSE least(24, floor(({c} - a) / (b - a) * 25))::BIGINT END AS bin, count(*) AS count
        FROM lineitem, (SELECT min({c})::DOUBLE AS a, max({c})::DOUBLE AS b FROM lineitem) GROUP BY 1, 2"""
        for c in LINEITEM_NUMERIC
    ]),
)
def _(t):
    return distributions.histogram_grid(t.lineitem)


# The aggregation of cluster means, on given groups instead of fitted clusters.
@query("group_means", "SELECT p_type, round(avg(p_size), 2) AS p_size, round(avg(p_retailprice), 2) AS p_retailprice FROM part GROUP BY 1")
def _(t):
    return cluster_means(t.part, ["p_size", "p_retailprice"], "p_type")

