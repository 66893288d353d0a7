"""Segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments, vectors
from .base import ORDERS_GAPS, query, rounded

FEATURES = ["p_size", "p_retailprice", "p_partkey"]


def _clustered(t):
    return segments.kmeans(t.part, FEATURES, 3)


@query("kmeans")
def _(t):
    return _clustered(t).select("p_partkey", "cluster")


@query("cluster_means")
def _(t):
    return segments.cluster_means(_clustered(t), FEATURES)


@query("cluster_sizes")
def _(t):
    return segments.cluster_sizes(_clustered(t))


@query("pca_project")
def _(t):
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return segments.pca_project(t.lineitem_gaps, features, 2).select("l_orderkey", "l_linenumber", "l_returnflag", "pc1", "pc2")


@query("pca_variance")
def _(t):
    return segments.pca_variance(t.lineitem_gaps, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3)


# Three groups far apart, of a half, a third and a sixth of the rows: k-means must find them, the largest being cluster 0.
GROUP = "CASE WHEN p_partkey % 6 < 3 THEN 0 WHEN p_partkey % 6 < 5 THEN 1 ELSE 2 END"
PLANTED_FEATURES = ["a", "b"]


def _planted(t):
    group = F.expr(GROUP)
    return t.part.select("p_partkey", (group * 1000 + F.col("p_size")).cast("double").alias("a"), ((group % 2) * 1000 + F.col("p_size") % 7).cast("double").alias("b"))


@query("kmeans_planted", f"SELECT p_partkey, CAST({GROUP} AS BIGINT) AS cluster FROM part")
def _(t):
    return segments.kmeans(_planted(t), PLANTED_FEATURES, 3).select("p_partkey", "cluster")


@query("cluster_sizes_planted", f"SELECT CAST({GROUP} AS BIGINT) AS cluster, count(*) AS count FROM part GROUP BY 1")
def _(t):
    return segments.cluster_sizes(segments.kmeans(_planted(t), PLANTED_FEATURES, 3))


@query(
    "cluster_means_planted",
    f"SELECT CAST({GROUP} AS BIGINT) AS cluster, round(avg(({GROUP}) * 1000 + p_size), 2) AS a, round(avg((({GROUP}) % 2) * 1000 + p_size % 7), 2) AS b FROM part GROUP BY 1",
)
def _(t):
    return segments.cluster_means(segments.kmeans(_planted(t), PLANTED_FEATURES, 3), PLANTED_FEATURES)


@query("semantic_clusters_planted", f"SELECT p_partkey, CAST({GROUP} AS BIGINT) AS cluster FROM part")
def _(t):
    rows = _planted(t).select("p_partkey", F.array("a", "b").alias("v"))
    return vectors.semantic_clusters(rows, "v", 3).select("p_partkey", "cluster")


# Two standardised columns with correlation r have the axes (1, 1) and (1, -1) over the root of 2, and variances 1 + r and 1 - r.
TWO = """x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS u, l_extendedprice + 2000 * l_quantity AS v FROM lineitem),
z AS (SELECT *, (u - avg(u) OVER ()) / stddev_pop(u) OVER () AS zu, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS zv FROM x)"""
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _two(t):
    return t.lineitem.select(*KEYS, F.col("l_quantity").alias("u"), (F.col("l_extendedprice") + 2000 * F.col("l_quantity")).alias("v"))


@query("pca_project_two", f"WITH {TWO} SELECT {', '.join(KEYS)}, round((zu + zv) / sqrt(2), 4) + 0 AS pc1, round(abs(zu - zv) / sqrt(2), 4) AS pc2 FROM z")
def _(t):
    found = segments.pca_project(_two(t), ["u", "v"], 2, population=True)
    return found.select(*KEYS, (F.round("pc1", 4) + 0).alias("pc1"), F.round(F.abs("pc2"), 4).alias("pc2"))


@query(
    "pca_variance_two",
    f"""WITH {TWO}, r AS (SELECT corr(u, v) AS r FROM x) SELECT 1::BIGINT AS component, round(50 * (1 + r), 4) AS variance_pct, round(50 * (1 + r), 4) AS cumulative_pct FROM r
    UNION ALL SELECT 2, round(50 * (1 - r), 4), 100.0 FROM r""",
)
def _(t):
    return rounded(segments.pca_variance(_two(t), ["u", "v"], 2), 4, "variance_pct", "cumulative_pct")


@query("numeric_projection_two", f"WITH {TWO} SELECT {', '.join(KEYS)}, round((zu + zv) / sqrt(2), 4) + 0 AS pc1 FROM z")
def _(t):
    return vectors.numeric_projection(_two(t), ["u", "v"], 1, population=True).select(*KEYS, (F.round("pc1", 4) + 0).alias("pc1"))


@query("top_n", f"WITH {ORDERS_GAPS} SELECT * FROM o WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return segments.top_n(t.orders_gaps, "o_totalprice", 25, ["o_orderkey"])


@query("bottom_n", f"WITH {ORDERS_GAPS} SELECT * FROM o WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice, o_orderkey LIMIT 25")
def _(t):
    return segments.bottom_n(t.orders_gaps, "o_totalprice", 25, ["o_orderkey"])


@query(
    "cohort",
    f"""WITH {ORDERS_GAPS}, s AS (SELECT o_orderpriority, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, round(sum(o_totalprice), 2) AS total FROM o
    WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2) SELECT * FROM s""",
)
def _(t):
    return rounded(segments.cohort(t.orders_gaps, "o_orderdate", "o_orderpriority", "o_totalprice", "Q", wide=False), 2, "total")


YEARS = ["1995", "1996", "1997", "1998", "1999", "2000", "2001"]


@query(
    "cohort_wide",
    "SELECT o_orderstatus, "
    + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = {y}), 0), 2) AS \"{y}\"" for y in YEARS)
    + " FROM orders GROUP BY 1",
)
def _(t):
    return rounded(segments.cohort(t.orders, "o_orderdate", "o_orderstatus", "o_totalprice", "Y"), 2, *YEARS)


BANDS = """e AS (SELECT quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.25) AS b, quantile_cont(value, 0.75) AS c, quantile_cont(value, 0.9) AS d FROM events),
b AS (SELECT event_id, value, CASE WHEN value <= a THEN 'Bottom 10%' WHEN value <= b THEN '10-25%' WHEN value <= c THEN '25-75%' WHEN value <= d THEN '75-90%' ELSE 'Top 10%' END AS value_band FROM events, e)"""


@query("percentile_bands", f"WITH {BANDS} SELECT event_id, value_band FROM b")
def _(t):
    return segments.percentile_bands(t.events, "value").select("event_id", "value_band")


@query(
    "band_summary",
    f"""WITH {BANDS} SELECT CASE value_band WHEN 'Bottom 10%' THEN 0 WHEN '10-25%' THEN 1 WHEN '25-75%' THEN 2 WHEN '75-90%' THEN 3 ELSE 4 END::BIGINT AS position,
    value_band AS band, count(*) AS n, min(value) AS "min", max(value) AS "max" FROM b GROUP BY value_band""",
)
def _(t):
    return segments.band_summary(t.events, "value")
