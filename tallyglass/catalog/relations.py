"""Correlation, regression, group differences."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import charts, relations
from .base import LINEITEM_GAPS, query, rounded, union_all

# Raw lineitem measures are hardly correlated, so some derived ones join them.
CHECKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "mixed"]
DERIVED = f"""{LINEITEM_GAPS}, m AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net,
l_quantity * 1000 + l_extendedprice * 0.5 AS mixed, l_returnflag FROM li)"""


def _derived(t):
    return t.lineitem_gaps.selectExpr(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_extendedprice * (1 - l_discount) AS net",
        "l_quantity * 1000 + l_extendedprice * 0.5 AS mixed", "l_returnflag",
    )


def pair_rows(digits: str = "2") -> str:
    return union_all([f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), {digits}) AS r FROM m" for a, b in combinations(CHECKED, 2)])


@query(
    "correlation_matrix",
    f"WITH {DERIVED}, p AS ({pair_rows()}) SELECT * FROM p UNION ALL SELECT b, a, r FROM p UNION ALL " + union_all([f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in CHECKED]),
)
def _(t):
    return relations.correlation_matrix(_derived(t), CHECKED)


@query(
    "top_correlations",
    f"WITH {DERIVED}, p AS ("
    + union_all([
        f"SELECT {i} AS i, {j} AS j, '{CHECKED[i]}' AS a, '{CHECKED[j]}' AS b, round(corr({CHECKED[i]}, {CHECKED[j]}), 2) AS r FROM m"
        for i, j in combinations(range(len(CHECKED)), 2)
    ])
    + ") SELECT a, b, r FROM p ORDER BY abs(r) DESC, i, j LIMIT 6",
)
def _(t):
    return relations.top_correlations(_derived(t), 6, CHECKED)


@query("scatter_sample", "SELECT event_id, user_id, value, event_type FROM events")
def _(t):
    return charts.project_sample(t.raw("events"), ["user_id", "value", "event_type"], "event_id")


@query(
    "ols_trendline",
    f"""WITH {DERIVED} SELECT regr_count(net, l_quantity) AS n, round(regr_slope(net, l_extendedprice), 6) AS slope, round(regr_intercept(net, l_extendedprice), 3) AS intercept,
    round(regr_r2(net, l_extendedprice), 6) AS r2 FROM m""",
)
def _(t):
    line = relations.ols(_derived(t), "l_extendedprice", "net")
    return rounded(rounded(line, 6, "slope", "r2"), 3, "intercept")


@query("pearson_test", f"WITH {DERIVED} SELECT count(net) AS n, round(corr(net, l_extendedprice), 6) AS r FROM m WHERE l_extendedprice IS NOT NULL")
def _(t):
    return rounded(relations.pearson_test(_derived(t), "l_extendedprice", "net").select("n", "r"), 6, "r")


@query("pearson_test_p")
def _(t):
    return relations.pearson_test(t.lineitem, "l_quantity", "l_tax")


# Normal equations of two features, solved by Cramer's rule on centred sums.
NORMAL = """c AS (SELECT net AS y, l_extendedprice AS a, l_quantity AS b FROM m WHERE net IS NOT NULL),
v AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM c),
k AS (SELECT (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ka, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS kb, * FROM v),
f AS (SELECT ka, kb, my - ka * ma - kb * mb AS k0 FROM k)"""


@query(
    "linear_regression",
    f"""WITH {DERIVED}, {NORMAL} SELECT round(any_value(ka), 4) AS coef_l_extendedprice, round(any_value(kb), 4) AS coef_l_quantity, round(any_value(k0), 3) AS intercept,
    round(1 - sum((y - k0 - ka * a - kb * b) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - k0 - ka * a - kb * b) ** 2)), 4) AS rmse,
    round(avg(abs(y - k0 - ka * a - kb * b)), 4) AS mae, count(*) AS n FROM c, f""",
)
def _(t):
    fit = relations.linear_regression(_derived(t), "net", ["l_extendedprice", "l_quantity"])
    return rounded(rounded(rounded(fit, 3, "intercept"), 6, "r2"), 4, "rmse", "mae")


@query(
    "regression_predictions",
    """WITH k AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i FROM orders)
    SELECT o_orderkey, o_totalprice AS actual, round(i + s * o_custkey, 3) AS predicted, round(o_totalprice - i - s * o_custkey, 3) AS residual FROM orders, k""",
)
def _(t):
    scored = relations.regression_predictions(t.orders, "o_totalprice", ["o_custkey"])
    return rounded(scored.select("o_orderkey", "actual", "predicted", "residual"), 3, "predicted", "residual")


@query(
    "residual_histogram",
    """WITH k AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i FROM orders),
    r AS (SELECT o_totalprice - i - s * o_custkey AS x FROM orders, k), e AS (SELECT min(x) AS a, max(x) AS b FROM r),
    c AS (SELECT least(29, floor((x - a) / (b - a) * 30))::BIGINT AS bin, count(*) AS n FROM r, e GROUP BY 1)
    SELECT g AS bin, coalesce(n, 0)::BIGINT AS count, round(a + g * ((b - a) / 30), 2) AS low, round(a + (g + 1) * ((b - a) / 30), 2) AS high FROM range(30) r(g) LEFT JOIN c ON bin = g, e""",
)
def _(t):
    return rounded(relations.residual_histogram(t.orders, "o_totalprice", ["o_custkey"]).select("bin", "count", "low", "high"), 2, "low", "high")


@query(
    "feature_importance",
    f"""WITH {DERIVED}, {NORMAL} SELECT 'l_extendedprice' AS feature, round(ka, 4) AS coefficient, round(100 * abs(ka) / (abs(ka) + abs(kb)), 3) AS importance_pct FROM f
    UNION ALL SELECT 'l_quantity', round(kb, 4), round(100 * abs(kb) / (abs(ka) + abs(kb)), 3) FROM f""",
)
def _(t):
    shares = relations.feature_importance(_derived(t), "net", ["l_extendedprice", "l_quantity"])
    return rounded(rounded(shares, 4, "coefficient"), 3, "importance_pct")


TOP_BRANDS = "k AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 8), g AS (SELECT * FROM part SEMI JOIN k USING (p_brand))"


@query(
    "group_stats",
    f"""WITH {TOP_BRANDS} SELECT p_brand, round(avg(p_retailprice), 2) AS mean, round(median(p_retailprice), 2) AS median, round(stddev_samp(p_retailprice), 2) AS std,
    count(p_retailprice) AS count FROM g GROUP BY 1""",
)
def _(t):
    return relations.group_stats(t.part, "p_retailprice", "p_brand", 8)


@query(
    "anova",
    f"""WITH {TOP_BRANDS}, s AS (SELECT count(*) AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) AS v FROM g GROUP BY p_brand),
    a AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * m) / sum(n) AS grand, sum(n * v) AS within FROM s),
    b AS (SELECT sum(n * (m - (SELECT grand FROM a)) ** 2) AS between FROM s)
    SELECT round((between / (k - 1)) / (within / (n - k)), 6) AS f, k - 1 AS df_between, n - k AS df_within FROM a, b""",
)
def _(t):
    return rounded(relations.anova(t.part, "p_retailprice", "p_brand", 8).select("f", "df_between", "df_within"), 6, "f")


@query(
    "anova_p",
    """WITH g AS (SELECT o_orderstatus AS k, o_totalprice + CASE o_orderstatus WHEN 'F' THEN 3000 ELSE 0 END AS y FROM orders),
    s AS (SELECT count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM g GROUP BY k),
    a AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * m) / sum(n) AS grand, sum(n * v) AS within FROM s),
    f AS (SELECT k, n, (sum_between / (k - 1)) / (within / (n - k)) AS f FROM a, (SELECT sum(s.n * (m - grand) ** 2) AS sum_between FROM s, a))
    SELECT round(f, 6) AS f, k - 1 AS df_between, n - k AS df_within, round((1 + 2 * f / (n - k)) ** (-(n - k) / 2.0), 8) AS p FROM f""",
)
def _(t):
    """Three groups: the upper tail of F with two degrees of freedom has a closed form."""
    rows = t.orders.selectExpr("o_orderstatus", "o_totalprice + IF(o_orderstatus = 'F', 3000, 0) AS y")
    return rounded(rounded(relations.anova(rows, "y", "o_orderstatus", 8).select("f", "df_between", "df_within", "p"), 6, "f"), 8, "p")


@query(
    "partial_correlation",
    f"""WITH {DERIVED}, r AS (SELECT count(*) AS n, corr(net, mixed) AS xy, corr(net, l_extendedprice) AS xz, corr(mixed, l_extendedprice) AS yz FROM m WHERE net IS NOT NULL)
    SELECT n, round(xy, 6) AS raw_r, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 5) AS partial_r FROM r""",
)
def _(t):
    result = relations.partial_correlation(_derived(t), "net", "mixed", ["l_extendedprice"])
    return rounded(rounded(result.select("n", "raw_r", "partial_r"), 6, "raw_r"), 5, "partial_r")


@query(
    "partial_correlation_many",
    """WITH m AS (SELECT l_extendedprice AS x, l_extendedprice * (1 - l_discount) + 900 * l_quantity AS y, l_quantity AS u, l_tax * 1000 + l_quantity AS v FROM lineitem),
    r AS (SELECT count(*) AS n, corr(x, y) AS xy, corr(x, u) AS xu, corr(y, u) AS yu, corr(x, v) AS xv, corr(y, v) AS yv, corr(u, v) AS uv FROM m),
    s AS (SELECT n, xy, (xy - xu * yu) / sqrt((1 - xu * xu) * (1 - yu * yu)) AS a, (xv - xu * uv) / sqrt((1 - xu * xu) * (1 - uv * uv)) AS b,
      (yv - yu * uv) / sqrt((1 - yu * yu) * (1 - uv * uv)) AS c FROM r)
    SELECT n, round(xy, 6) AS raw_r, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 5) AS partial_r FROM s""",
)
def _(t):
    rows = t.lineitem.selectExpr("l_extendedprice AS x", "l_extendedprice * (1 - l_discount) + 900 * l_quantity AS y", "l_quantity AS u", "l_tax * 1000 + l_quantity AS v")
    result = relations.partial_correlation(rows, "x", "y", ["u", "v"])
    return rounded(rounded(result.select("n", "raw_r", "partial_r"), 6, "raw_r"), 5, "partial_r")


@query(
    "correlation_constant",
    "SELECT 'a' AS a, 'l_quantity' AS b, NULL::DOUBLE AS r, count(*) AS n FROM lineitem",
)
def _(t):
    """A constant column has no correlation."""
    pairs = relations.correlation_pairs(t.lineitem.select(F.lit(5.0).alias("a"), "l_quantity"))
    return pairs.select("a", "b", "r", "n")
