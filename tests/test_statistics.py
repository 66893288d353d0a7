"""Probabilities against published values, and models against their defining properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyglass.functions.probability import f_upper, incomplete_beta, pearson_p, t_two_sided
from tallyglass.operators import alerts, forest, profile, relations, segments, vectors


def test_tail_probabilities():
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5, abs=1e-12)
    assert t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert f_upper(4.10, 2, 10) == pytest.approx(0.05, abs=1e-3)
    assert pearson_p(0.5, 20) == pytest.approx(0.0178, abs=1e-3)
    assert pearson_p(1.0, 5) == 0.0


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(4)
    n = 400
    a, b = rng.normal(5, 2, n), rng.exponential(3, n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": 2 * a - b + rng.normal(size=n), "k": 5.0, "g": rng.integers(0, 3, n).astype(str)})
    pdf.loc[::9, "b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("b", F.nanvl("b", F.lit(None)))
    return pdf, df.repartition(4)


def test_profile_matches_pandas(numbers):
    pdf, df = numbers
    found = profile.numeric_stats(df, ["a", "b", "c", "k"]).toPandas().set_index("column")
    for c in ["a", "b", "c", "k"]:
        s = pdf[c].dropna()
        expected = [len(s), s.min(), s.max(), s.mean(), s.median(), s.std(), s.sum(), s.skew(), s.kurt(), s.quantile(0.95)]
        actual = found.loc[c, ["non_null", "min", "max", "mean", "median", "std", "sum", "skew", "kurt", "p95"]].astype(float)
        np.testing.assert_allclose(actual, expected, rtol=1e-9, atol=1e-9)


def test_correlations_are_pairwise_complete(numbers):
    pdf, df = numbers
    found = {(r.a, r.b): r for r in relations.correlation_pairs(df, ["a", "b", "c", "k"]).collect()}
    expected = pdf[["a", "b", "c", "k"]].corr()
    for (a, b), r in found.items():
        assert r.n == len(pdf[[a, b]].dropna())
        if "k" in (a, b):
            assert r.r is None
        else:
            assert r.r == pytest.approx(expected.loc[a, b], abs=1e-12)


def test_partial_correlation_equals_residual_method(numbers):
    pdf, df = numbers
    known = pdf[["a", "c", "b"]].dropna()
    design = np.column_stack([np.ones(len(known)), known["b"]])
    residual = [known[v] - design @ np.linalg.lstsq(design, known[v], rcond=None)[0] for v in ("a", "c")]
    found = relations.partial_correlation(df, "a", "c", ["b"]).first()
    assert found.partial_r == pytest.approx(np.corrcoef(*residual)[0, 1], abs=1e-9)
    assert found.p_ref <= found.p_adj or found.p_ref == pytest.approx(found.p_adj, abs=1e-3)


def test_regression_matches_least_squares(numbers):
    pdf, df = numbers
    known = pdf[["c", "a", "b"]].dropna()
    design = np.column_stack([known["a"], known["b"], np.ones(len(known))])
    beta = np.linalg.lstsq(design, known["c"], rcond=None)[0]
    found = relations.linear_regression(df, "c", ["a", "b"]).first()
    assert [found.coef_a, found.coef_b] == pytest.approx(beta[:2], abs=1e-4)
    assert found.intercept == pytest.approx(beta[2], abs=1e-6)
    shares = relations.feature_importance(df, "c", ["a", "b"]).collect()
    assert sum(r.importance_pct for r in shares) == pytest.approx(100)


def test_kmeans_invariants(numbers):
    pdf, df = numbers
    clustered = segments.kmeans(df, ["a", "b"], 3)
    sizes = [r["count"] for r in segments.cluster_sizes(clustered).orderBy("cluster").collect()]
    assert sum(sizes) == pdf[["a", "b"]].dropna().shape[0]
    assert sizes == sorted(sizes, reverse=True)
    again = segments.kmeans(df, ["a", "b"], 3).select("id", "cluster")
    assert again.exceptAll(clustered.select("id", "cluster")).count() == 0
    scaled = segments.feature_vectors(df, ["a", "b"])
    best = segments.best_kmeans(scaled, "_features", 3)
    single = segments.best_kmeans(scaled, "_features", 3, n_init=1)
    assert best.summary.trainingCost <= single.summary.trainingCost + 1e-9


def test_pca_invariants(numbers):
    pdf, df = numbers
    points = segments.pca_project(df, ["a", "b", "c"], 2).toPandas()
    known = pdf[["a", "b", "c"]].dropna()
    z = ((known - known.mean()) / known.std()).to_numpy()
    values, axes = np.linalg.eigh(np.cov(z.T))
    axes = axes[:, ::-1][:, :2] * np.sign(axes[:, ::-1][:, :2][np.abs(axes[:, ::-1][:, :2]).argmax(0), [0, 1]])
    expected = pd.DataFrame(z @ axes, index=pdf.loc[known.index, "id"])
    np.testing.assert_allclose(points.set_index("id").loc[expected.index, ["pc1", "pc2"]].to_numpy(), expected.to_numpy(), atol=1e-8)
    shares = [r.variance_pct for r in segments.pca_variance(df, ["a", "b", "c"], 3).collect()]
    assert shares == sorted(shares, reverse=True) and sum(shares) == pytest.approx(100)


def test_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3))
    x[:12] *= 15
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(4)
    scored = forest.isolation_forest(df, ["id"], ["a", "b", "c"], contamination=0.05)
    summary = forest.anomaly_summary(scored).first()
    assert summary.flagged == 30 and summary.normal == 570
    top = {r.id for r in forest.anomaly_top(scored, ["id"], 12).collect()}
    assert len(top & set(range(12))) >= 10
    again = forest.isolation_forest(df.repartition(7), ["id"], ["a", "b", "c"], contamination=0.05)
    both = scored.select("id", F.col("anomaly_score").alias("s")).join(again.select("id", "anomaly_score"), "id")
    assert both.filter("abs(s - anomaly_score) > 1e-9").count() == 0


@pytest.mark.parametrize("rows, kinds", [(601, 7), (400, 1), (41, 41)])
def test_forest_flags_its_share_of_tied_rows(spark, rows, kinds):
    df = spark.range(rows).selectExpr("id", f"CAST(id % {kinds} AS DOUBLE) AS a", f"CAST(id % {kinds} * 3 AS DOUBLE) AS b").repartition(3)
    scored = forest.isolation_forest(df, ["id"], ["a", "b"], trees=10, contamination=0.05)
    expected = (rows - 1) // 20 + 1
    summary = forest.anomaly_summary(scored).first()
    assert (summary.flagged, summary.normal) == (expected, rows - expected)
    flags = scored.groupBy("is_anomaly").agg(F.min("anomaly_score").alias("low"), F.max("anomaly_score").alias("high"))
    ends = {r.is_anomaly: r for r in flags.collect()}
    assert ends[True].high <= 0 <= ends[False].low


def test_tree_samples_are_uniform_and_bounded(spark):
    rows = spark.range(20000).withColumnRenamed("id", "k")
    drawn = forest.tree_samples(rows, ["k"], 20000, 10, 64, 1)
    sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 64 and min(sizes) >= 55


def test_similar_rows_excludes_the_row_itself(numbers):
    _, df = numbers
    for metric in ("cosine", "euclidean"):
        found = vectors.similar_rows(df, "id", 3, ["a", "b", "c"], 5, metric)
        assert [r.id for r in found.collect()].count(3) == 0 and found.count() == 5


def test_alert_report_is_ranked(numbers):
    _, df = numbers
    report = alerts.alert_report(df, ["id"])
    order = [alerts.SEVERITIES.index(r.severity) for r in report.collect()]
    assert order == sorted(order) and order
    counts = {r.severity: r["count"] for r in alerts.alert_counts(report).collect()}
    assert counts["TOTAL"] == sum(counts[s] for s in alerts.SEVERITIES) == len(order)
    assert alerts.alert_filter(report, ["GOOD"]).filter("severity <> 'GOOD'").count() == 0
