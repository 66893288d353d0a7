import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyglass.operators.profile import numeric_stats
from tallyglass.plans import quantiles
from tallyglass.plans.quantiles import exact_quantiles, grouped_quantiles, summarize

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(spark, values, bins):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    found = exact_quantiles(df, {"x": PROBABILITIES}, bins)["x"]
    known = pd.Series([v for v in values if v is not None], dtype=float)
    if known.empty:
        assert found == [None] * len(PROBABILITIES)
    else:
        np.testing.assert_allclose(found, known.quantile(PROBABILITIES).to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("bins", [4, 64, 2048])
@pytest.mark.parametrize(
    "values",
    [
        [],
        [None, None],
        [5.0],
        [2.0] * 50,
        [None, 1.0, 2.0, None, 4.0, 10.0],
        list(range(500)),
        [7.0] * 200 + list(range(300)),
        [*np.random.default_rng(1).lognormal(0, 3, 400)],
        [-1e300, 1e300, *range(100)],
        [0.0, -0.0, 1e-300, 1e-200, 1.0],
    ],
    ids=["empty", "null", "one", "constant", "gaps", "range", "hot", "skewed", "extreme", "tiny"],
)
def test_exact(spark, values, bins):
    check(spark, values, bins)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_any_list(spark, values):
    check(spark, values, 4)


@pytest.mark.parametrize("size", [10**6, 100, 10])
def test_grouped(spark, size):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": np.where(rng.random(600) < 0.6, "hot", "b"), "x": np.round(rng.normal(size=600), 1)})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf).selectExpr("g", "nanvl(x, NULL) AS x")
    found = grouped_quantiles(df, ["g"], "x", {"a": 0.1, "m": 0.5, "z": 0.99}, size).toPandas().set_index("g").sort_index()
    expected = pdf.groupby("g")["x"].quantile([0.1, 0.5, 0.99]).unstack()
    np.testing.assert_allclose(found[["a", "m", "z"]].to_numpy(), expected.to_numpy())
    assert found["n"].tolist() == pdf.groupby("g")["x"].count().tolist()


def outside(values, k):
    """Values outside the fences of factor ``k``, as the definition says."""
    known = pd.Series([v for v in values if v is not None], dtype=float)
    q1, q3 = known.quantile(0.25), known.quantile(0.75)
    return int(((known < q1 - k * (q3 - q1)) | (known > q3 + k * (q3 - q1))).sum())


COLUMNS = {
    "skewed": lambda r, n: r.lognormal(0, 2, n),
    "normal": lambda r, n: r.normal(size=n),
    "few": lambda r, n: r.integers(0, 5, n).astype(float),
    "hot": lambda r, n: np.where(r.random(n) < 0.6, 3.0, r.normal(size=n) * 10),
    "constant": lambda r, n: np.full(n, 2.5),
    "even": lambda r, n: r.random(n),
}


@pytest.fixture
def scans(monkeypatch):
    """Every scan that a summary makes."""
    made = []
    for name in ("first_scan", "_count"):
        plain = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *a, plain=plain, name=name, **k: made.append(name) or plain(*a, **k))
    return made


def test_a_profile_takes_two_scans(spark, scans):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({c: f(r, 50_000) for c, f in COLUMNS.items()})
    pdf.loc[::13, "normal"] = np.nan
    stats = numeric_stats(spark.createDataFrame(pdf).repartition(6), fences=(1.5, 4.0)).toPandas().set_index("column")
    assert scans == ["first_scan", "_count"]
    for c in COLUMNS:
        x = pdf[c].dropna()
        np.testing.assert_allclose(stats.loc[c, ["p25", "median", "p75", "p95"]].astype(float), x.quantile([0.25, 0.5, 0.75, 0.95]), rtol=1e-12)
        assert (stats.loc[c, "outliers"], stats.loc[c, "outliers_1"]) == (outside(x, 1.5), outside(x, 4.0))
        np.testing.assert_allclose(stats.loc[c, ["min", "max", "mean", "sum"]].astype(float), [x.min(), x.max(), x.mean(), x.sum()], rtol=1e-9)


@pytest.mark.parametrize("error", [1e-9, 0.02, 0.3])
def test_a_wrong_sketch_costs_scans_only(spark, scans, monkeypatch, error):
    """Bounds far too tight or wide, few bins: the results stay, and every scan narrows the search."""
    monkeypatch.setattr(quantiles, "BUFFER", 8)
    monkeypatch.setattr(quantiles, "POINTS", 16)
    monkeypatch.setattr(quantiles, "RANK_ERROR", error)
    r = np.random.default_rng(4)
    pdf = pd.DataFrame({c: f(r, 3000) for c, f in COLUMNS.items()})
    found = summarize(spark.createDataFrame(pdf), {c: PROBABILITIES for c in pdf}, (1.5, 0.2, 4.0), bins=8)
    for c in pdf:
        np.testing.assert_allclose(found[c].quantiles, pdf[c].quantile(PROBABILITIES), rtol=1e-12)
        assert found[c].outside == [outside(pdf[c], k) for k in (1.5, 0.2, 4.0)]
    assert len(scans) < 14


def test_fences_with_infinite_values(spark):
    values = [-math.inf] * 3 + [math.inf] * 2 + [float(v) for v in range(200)] + [900.0]
    found = summarize(spark.createDataFrame([(v,) for v in values], "x double"), {"x": [0.0, 0.5, 1.0]}, (1.5,))["x"]
    assert found.outside == [outside(values, 1.5)] == [6]
    assert found.quantiles == [-math.inf, float(np.median(values)), math.inf]
    odd = summarize(spark.createDataFrame([(math.inf,), (-math.inf,), (None,)], "x double"), {"x": [0.0, 0.5]}, (1.5,))["x"]
    assert (odd.n, odd.quantiles, odd.outside) == (2, [-math.inf, None], [0])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=40), st.sampled_from([0.0, 0.5, 1.5]))
def test_fences_of_any_list(spark, values, k):
    found = summarize(spark.createDataFrame([(v,) for v in values], "x double"), {"x": [0.25, 0.75]}, (k,))["x"]
    q1, q3 = found.quantiles
    assert found.outside == [sum(v < q1 - k * (q3 - q1) or v > q3 + k * (q3 - q1) for v in values)]
