"""Empty tables, single rows, constants, NaN, null keys and odd names."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tallyglass.functions.numeric import normalize_nan
from tallyglass.operators import alerts, charts, computed, dashboard, distributions, profile, roles, segments, timeseries, vectors
from tallyglass.operators.filters import Filter, active_labels, apply_filters, filter_metrics
from tallyglass.plans.quantiles import exact_quantiles
from tallyglass.sources import exports, tables

SCHEMA = "id long, x double, y double, g string, d date"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def single(spark):
    return spark.createDataFrame([(1, 2.5, None, None, dt.date(2024, 2, 29))], SCHEMA)


def test_empty_table(empty):
    assert profile.null_stats(empty).filter("nulls <> 0").count() == 0
    assert profile.duplicate_count(empty).first().duplicates == 0
    assert profile.quality_score(empty).first().score == 100.0
    assert profile.numeric_profile(empty).count() == 0
    assert profile.numeric_stats(empty).count() == 3
    assert profile.categorical_profile(empty).first().top == ""
    assert timeseries.resample(empty, "d", ["x"], "M").count() == 0
    assert charts.top_categories(empty, "g", "x").count() == 0
    assert segments.percentile_bands(empty, "x").count() == 0
    assert computed.rank_column(empty, "x").count() == 0
    assert sum(r["count"] for r in distributions.histogram(empty, "x", 5).collect()) == 0


def test_single_row(single):
    stats = profile.numeric_stats(single, ["x", "y"]).toPandas().set_index("column")
    assert stats.loc["x", "median"] == 2.5 and stats.loc["y", "non_null"] == 0
    assert profile.numeric_profile(single).count() == 0
    month = timeseries.resample(single, "d", ["x"], "M").first()
    assert month.period == dt.date(2024, 2, 29) and month.x == 2.5
    assert computed.scale(single, "x", "minmax").first().x_norm is None


def test_constant_column(spark):
    df = spark.range(40).select("id", F.lit(3.0).alias("x"))
    row = profile.numeric_stats(df, ["x"]).first()
    assert (row["skew"], row["kurt"], row["outliers"]) == (0.0, 0.0, 0)
    assert {r.x_bin for r in computed.bin_equal_width(df, "x", 4).collect()} == {int(pd.cut(np.full(3, 3.0), 4, labels=False)[0])}
    assert {r["count"] for r in distributions.histogram(df, "x", 4).filter("bin = 0").collect()} == {40}
    assert {r.z for r in computed.scale(df, "x", "zscore", "z").collect()} == {None}


def test_nan_counts_as_missing(spark):
    df = normalize_nan(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    assert profile.null_stats(df).first().nulls == 2
    raw = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert apply_filters(raw, [Filter.num("x", 0)]).count() == 1


def test_null_group_keys_are_dropped(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 5.0), ("a", None)], "g string, x double")
    assert [tuple(r) for r in charts.top_categories(df, "g", "x").collect()] == [("a", 1.0)]
    assert charts.value_counts(df, "g", 5).collect()[0]["count"] == 2


@pytest.mark.parametrize("q", [2, 4, 5, 10])
def test_bins_match_pandas(spark, q):
    rng = np.random.default_rng(q)
    x = np.round(rng.exponential(5, 300), 1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    width = computed.bin_equal_width(df, "x", q, "b").orderBy("id").toPandas()["b"].to_numpy()
    np.testing.assert_array_equal(width, pd.cut(x, q, labels=False))
    quantile = computed.bin_quantile(df, "x", q, "b").orderBy("id").toPandas()["b"].to_numpy()
    np.testing.assert_array_equal(quantile, pd.qcut(x, q, labels=False, duplicates="drop"))
    custom = computed.bin_custom(df, "x", [0, 2, 5], "b").orderBy("id").toPandas()["b"].to_numpy(dtype=float)
    np.testing.assert_array_equal(custom, pd.cut(x, [0, 2, 5], labels=False))


@pytest.mark.parametrize(("freq", "rule"), [("D", "D"), ("W", "W"), ("M", "ME"), ("Q", "QE")])
def test_resample_matches_pandas(table, freq, rule):
    orders = table("orders").filter("month(o_orderdate) NOT IN (4, 5)")
    found = timeseries.resample(orders, "o_orderdate", ["o_totalprice"], freq).toPandas()
    expected = orders.toPandas().set_index("o_orderdate")[["o_totalprice"]].resample(rule).sum().reset_index()
    assert [str(p) for p in found["period"]] == [str(p.date()) for p in expected["o_orderdate"]]
    np.testing.assert_allclose(found["o_totalprice"], expected["o_totalprice"])


def test_date_names():
    assert roles.looks_like_date("order_date") and roles.looks_like_date("createdAt") and roles.looks_like_date("o_orderdate")
    assert not roles.looks_like_date("width") and not roles.looks_like_date("sentiment") and not roles.looks_like_date("on_hold")
    assert roles.looks_like_date("width", strict_names=True)


def test_date_coercion(spark):
    df = spark.createDataFrame([("2024-01-05", "x", 2020), ("05/02/2024", "y", 2021), ("junk", "z", 2022)], "day_date string, update string, year int")
    found = roles.coerce_dates(df)
    assert dict(found.dtypes) == {"day_date": "timestamp", "update": "string", "year": "int"}
    assert [r.day_date for r in found.collect()] == [dt.datetime(2024, 1, 5), dt.datetime(2024, 2, 5), None]
    assert dict(roles.coerce_dates(df, strict_names=True).dtypes)["update"] == "timestamp"


def test_roles(spark):
    df = spark.createDataFrame([], "a int, b decimal(9,2), c string, d boolean, e timestamp, f array<float>")
    assert roles.column_roles(df) == roles.Roles(["a", "b"], ["c", "d"], ["e"])


def test_filters(spark):
    df = spark.createDataFrame([("None", 1), (None, 2), ("a.b", 3)], "s string, n int")
    assert apply_filters(df, [Filter.contains("s", "none")]).count() == 1
    assert apply_filters(df, [Filter.contains("s", ".", regex=True)]).count() == 2
    assert apply_filters(df, [Filter.contains("s", ".")]).count() == 1
    assert apply_filters(df, [Filter.isin("n", range(2, 3000))]).count() == 2
    assert filter_metrics(df, []).first().matching == 3
    assert filter_metrics(df, [Filter.isin("n", range(2, 3000))]).first().filtered_out == 1


def test_filters_reach_the_scan(spark):
    chosen = [Filter.num("l_quantity", 10, 20), Filter.isin("l_returnflag", ["A", "N"])]
    kept = tables.read_table(spark, f"{SMALL}/lineitem.parquet", where=[f.condition for f in chosen]).select("l_quantity")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(l_quantity,10.0), LessThanOrEqual(l_quantity,20.0), In" in pushed  # the list itself is cut short in print
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_labels_of_filters():
    assert active_labels([Filter.num("x", 1, 2), Filter.isin("g", "ab")]) == ["x: 1 to 2", "g: 2 selected"]


@pytest.mark.parametrize("odd", [math.inf, -math.inf, math.nan])
def test_infinite_values_and_nan_end_the_search(spark, odd):
    values = [float(i) for i in range(5000)] + [odd] * 3
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    known = sorted(v for v in values if not math.isnan(v))
    found = exact_quantiles(df, {"x": [0.0, 0.25, 0.5, 1.0]})["x"]
    assert found == [known[int(p * (len(known) - 1))] if p in (0.0, 1.0) else pytest.approx(np.quantile(known, p)) for p in (0.0, 0.25, 0.5, 1.0)]
    bins = distributions.histogram(df, "x", 10).collect()
    assert sum(r["count"] for r in bins) == 5000 and max(r.high for r in bins) == 4999.0


def test_a_constant_column_is_no_category(spark):
    df = spark.range(1600).select(F.lit("one").alias("c"), F.col("id").cast("string").alias("g"), F.col("id").cast("double").alias("x"))
    assert dashboard.auto_top_categories(df).first().category == "g"


def test_every_number_can_raise_a_trend_alert(spark):
    df = spark.range(60).selectExpr("date_add(date'2024-01-01', int(id)) AS d", *[f"rand({i}) AS n{i}" for i in range(4)], "id * 1.0D AS rising")
    assert [r.column for r in alerts.alert_trend(df).collect()] == ["rising"]


def test_all_insights_are_kept(spark):
    one_off = [f"IF(id % 5 = 0, id * id * id, 0) * 1.0D AS v{i}" for i in range(12)]
    assert profile.profile_insights(spark.range(400).selectExpr("id", *one_off), normality=False).count() > 12


def test_unknown_keys_are_named(table):
    with pytest.raises(KeyError, match="vec_id -1 does not occur"):
        vectors.vector_of(table("embeddings"), "vec_id", -1, "embedding")


def test_words_of_any_script(spark):
    df = spark.createDataFrame([(1, "Iechä слово"), (2, "iechÄ, СЛОВО!"), (3, "iech")], "id long, text string")
    a, b, c = (r.embedding for r in vectors.embed_text(df, "text").orderBy("id").collect())
    assert a == b != c


def test_an_encoder_of_the_caller(spark):
    def encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    (row,) = vectors.embed_text(spark.createDataFrame([("abc",), (None,)], "text string"), "text", encoder=encoder).collect()
    assert row.embedding == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])


def test_open_and_close_of_equal_times(spark):
    rows = [(i, dt.datetime(2024, 1, 1), float((i * 7) % 11)) for i in range(11)]
    found = {tuple(timeseries.ohlc(spark.createDataFrame(rows, "id long, t timestamp, v double").repartition(n), "t", "v", "D", ["id"]).first()) for n in (1, 4)}
    assert found == {(dt.date(2024, 1, 1), 0.0, 10.0, 0.0, 4.0)}


def test_a_workbook_by_address(spark):
    assert tables.read_workbook(spark, "file:///root/testdata/sf0.001", register=False).keys() >= {"orders", "part"}


def test_exports(spark, table, tmp_path):
    parts = table("part")
    written = exports.export_pivot(parts, str(tmp_path), "p_brand", "p_retailprice", "csv", ["p_partkey", "p_brand"])
    back = tables.read_table(spark, written["rows"], "csv")
    assert back.columns == ["p_partkey", "p_brand"] and back.count() == parts.count()
    book = tables.table_summary({"p": parts})
    assert book.first()["columns"] == 6


def test_single_file_folder_is_a_workbook(spark):
    book = tables.read_workbook(spark, "/root/testdata/sf0.001")
    assert {"orders", "lineitem"} <= set(book) and spark.table("orders").count() == book["orders"].count()


def test_dashboard_without_much_data(spark):
    df = spark.createDataFrame([("a", "u", 1.0, dt.date(2024, 1, 1)), ("b", "u", 2.0, dt.date(2024, 1, 2))], "g string, h string, x double, d date")
    assert {r.label for r in dashboard.auto_top_categories(df).collect()} == {"a", "b"}
    assert dashboard.auto_trend(df, None).columns == ["d", "x"] and dashboard.auto_trend(df).first().x == 3.0


def test_keys_lead_no_dashboard(spark):
    rows = spark.range(1000).selectExpr("id + 1000000 AS o_orderkey", "id + 2000000 AS userId", "IF(id % 2 = 0, 'a', 'b') AS g", "date_add(DATE'2024-01-01', int(id % 7)) AS d", "2.0D AS price")
    assert {(r.measure, r.total) for r in dashboard.auto_top_categories(rows).collect()} == {("price", 1000.0)}
    assert dashboard.auto_trend(rows).columns == ["period", "price"]
    assert dashboard.kpi_cards(rows, 1).first().column == "userId"
    assert dashboard.leading_measure(rows.select("o_orderkey", "g")) == "o_orderkey"


def test_wide_maps_beyond_the_pivot_limit(spark):
    df = spark.range(20_000).selectExpr("id % 2 AS r", "id AS c", "CAST(1 AS DOUBLE) AS v")
    found = charts.value_map(df, "r", "c", "v").selectExpr("r", "size(cells) AS n", "cells[4] AS four").collect()
    assert {(x.r, x.n, x.four) for x in found} == {(0, 10_000, 1.0), (1, 10_000, None)}


def test_skewed_exports_give_even_files(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("id", "rand(1) AS x")
    skewed = rows.filter("id < 180000").coalesce(1).union(rows.filter("id >= 180000").coalesce(1))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        exports.export(skewed, f"{tmp_path}/even", "parquet", even=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/even").groupBy(F.input_file_name().alias("f")).count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) > 1 and max(sizes) <= 1.2 * sum(sizes) / len(sizes)  # not 180,000 and 20,000
    exports.export(skewed, f"{tmp_path}/cut", "parquet", rows_per_file=50_000)
    cut = [r["count"] for r in spark.read.parquet(f"{tmp_path}/cut").groupBy(F.input_file_name().alias("f")).count().collect()]
    assert max(cut) <= 50_000


def test_series_are_checked(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "MOST_PERIODS", 50)
    series = spark.range(60).selectExpr("date_add(DATE'2020-01-01', CAST(id AS INT)) AS period", "id AS x")
    for call in (lambda: timeseries.rolling_average(series, ["x"]), lambda: timeseries.pct_change(series, "x")):
        with pytest.raises(ValueError):
            call()
    assert timeseries.pct_change(series.limit(50), "x").count() == 50
