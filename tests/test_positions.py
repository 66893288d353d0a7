"""Bucketed windows against pandas, with hot values, ties, nulls and small buckets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyglass.operators.computed import RANK_METHODS, lag_column, pct_of_total, rank_column, rolling_column
from tallyglass.plans import joins
from tallyglass.plans.joins import salted_join
from tallyglass.plans.positions import split_by_order

SIZES = [10**6, 25]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 900
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "part": np.where(rng.random(n) < 0.7, "hot", np.where(rng.random(n) < 0.5, "warm", "cold")),
            # A third of all rows share one value.
            "v": np.where(rng.random(n) < 0.33, 7.0, rng.integers(0, 60, n).astype(float)),
        }
    )
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    return pdf, df.repartition(5)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("method", RANK_METHODS)
def test_rank_whole_table(rows, method, ascending, size):
    pdf, df = rows
    found = rank_column(df, "v", method, ascending, id_cols=["id"], rows_per_task=size).toPandas().sort_values("id")
    expected = pdf["v"].rank(method="first" if method == "ordinal" else method, ascending=ascending)
    assert len(found) == len(pdf)
    np.testing.assert_array_equal(found["v_rank"].astype(float).to_numpy(), expected.to_numpy())


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("method", RANK_METHODS)
def test_rank_in_groups(rows, method, size):
    pdf, df = rows
    found = rank_column(df, "v", method, partition_by=["part"], id_cols=["id"], rows_per_task=size).toPandas().sort_values("id")
    expected = pdf.groupby("part")["v"].rank(method="first" if method == "ordinal" else method, ascending=False)
    np.testing.assert_array_equal(found["v_rank"].astype(float).to_numpy(), expected.to_numpy())


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("fn", ["mean", "sum", "std", "min", "max"])
def test_rolling(rows, fn, size):
    pdf, df = rows
    found = rolling_column(df, "v", 4, fn, ["id"], name="r", rows_per_task=size).toPandas().sort_values("id")
    expected = getattr(pdf["v"].rolling(4), fn)()
    np.testing.assert_allclose(found["r"].to_numpy(), expected.to_numpy(), atol=1e-6)


@pytest.mark.parametrize("size", SIZES)
def test_rolling_in_groups_ordered_by_a_hot_value(rows, size):
    pdf, df = rows
    known = pdf.dropna()
    found = rolling_column(df.dropna(), "id", 5, "sum", [("v", False), "id"], ["part"], "r", size).toPandas().sort_values("id")
    ordered = known.sort_values(["v", "id"], ascending=[False, True])
    expected = ordered.groupby("part")["id"].rolling(5).sum().reset_index(level=0, drop=True).sort_index()
    np.testing.assert_allclose(found["r"].to_numpy(dtype=float), expected.to_numpy())


@pytest.mark.parametrize("size", SIZES)
def test_lag_longer_than_a_bucket(rows, size):
    pdf, df = rows
    found = lag_column(df, "v", 40, ["id"], ["part"], "r", size).toPandas().sort_values("id")
    np.testing.assert_array_equal(found["r"].to_numpy(), pdf.groupby("part")["v"].shift(40).to_numpy())


def test_no_bucket_holds_a_hot_value(rows):
    _, df = rows
    split = split_by_order(df, ["v", "id"], rows_per_task=50)
    assert split.divided
    largest = split.rows.groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert largest <= 150


KEYS = {
    "text": "concat('k', lpad(cast(id * 7 % 100 AS string), 3, '0'))",
    "wide integers": "1152921504606846976 + id * 7 % 100",
    "wide decimals": "cast('123456789012345678901.25' AS decimal(30,2)) + id * 7 % 100",
    "dates": "date_add(date'2024-01-01', cast(id * 7 % 100 AS int))",
    "times": "timestamp_ntz'2024-03-10 01:30:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 % 100 AS int))",
    "booleans": "id % 3 = 0",
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("key", KEYS)
def test_ranks_of_any_type_in_any_zone(spark, key, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.range(1500).select("id", F.when(F.col("id") % 10 > 0, F.expr(KEYS[key])).alias("k"))
        for method in RANK_METHODS:
            small, large = (rank_column(df, "k", method, True, id_cols=["id"], rows_per_task=n) for n in (100, 10**6))
            assert sorted(map(tuple, small.select("id", "k_rank").collect())) == sorted(map(tuple, large.select("id", "k_rank").collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_value_of_nine_in_ten_rows(spark):
    df = spark.range(2000).selectExpr("id", "IF(id % 10 = 0, cast(id AS string), 'hot') AS k", "CAST(NULL AS string) AS g")
    for method in RANK_METHODS:
        small, large = (rank_column(df, "k", method, False, ["g"], ["id"], rows_per_task=n) for n in (100, 10**6))
        assert sorted(map(tuple, small.select("id", "k_rank").collect())) == sorted(map(tuple, large.select("id", "k_rank").collect()))


@pytest.mark.parametrize("limit", [0, 10_000])
def test_salted_join_keeps_every_row(rows, limit, monkeypatch):
    pdf, df = rows
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    facts = df.groupBy("part").agg(F.count("*").alias("n"))
    joined = salted_join(df, facts, ["part"], ["id"], hot_rows=100)
    assert joined.count() == len(pdf)
    assert joined.groupBy("part").agg(F.max("n").alias("n"), F.count("*").alias("m")).filter("n <> m").count() == 0


@pytest.mark.parametrize("size", SIZES)
def test_share_of_group(rows, size):
    pdf, df = rows
    found = pct_of_total(df, "v", "part", ["id"], rows_per_task=size).toPandas().sort_values("id")
    expected = pdf["v"] / pdf.groupby("part")["v"].transform("sum") * 100
    np.testing.assert_allclose(found["v_pct"].to_numpy(), expected.to_numpy())
