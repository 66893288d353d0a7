"""Segmentation: k-means, principal components, extremes, cohorts and percentile bands."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import period_name
from ..plans.quantiles import exact_quantiles

# Seed and restarts of the clustering.
SEED = 42
RESTARTS = 10
PARALLEL_FITS = 5


def feature_vectors(df: DataFrame, feats: Sequence[str], scaled: bool = True, out: str = "_features", population: bool = False) -> DataFrame:
    """Complete rows with their features as a vector, centred and (by default) of unit variance, that of a sample or of the
    population; constants become 0."""
    x = {f: F.col(f"`{f}`").cast("double") for f in feats}
    complete = df.dropna(subset=list(feats))
    found = complete.agg(*[e for f in feats for e in (F.avg(x[f]), F.stddev_pop(x[f]) if population else F.stddev_samp(x[f]))]).first()
    parts = []
    for i, f in enumerate(feats):
        mean, spread = found[2 * i] or 0.0, found[2 * i + 1] or 0.0
        parts.append((x[f] - F.lit(float(mean))) / F.lit(float(spread) if scaled and spread > 0 else 1.0))
    return complete.withColumn(out, array_to_vector(F.array(*parts)))


def best_kmeans(
    vectors: DataFrame, col: str, k: int, n_init: int = RESTARTS, seed: int = SEED, parallelism: int = PARALLEL_FITS
):
    """The model of least cost over ``n_init`` seeds, the first on a tie.

    ``vectors`` is cached while the seeds are tried; ``parallelism`` fits are submitted at a time.
    """
    data = vectors.select(col).persist()

    def fit(i: int):
        return KMeans(featuresCol=col, predictionCol="cluster", k=k, seed=seed + i).fit(data)

    try:
        data.count()
        with ThreadPoolExecutor(parallelism) as pool:
            fits = list(pool.map(inheritable_thread_target(vectors.sparkSession)(fit), range(n_init)))
        return min(fits, key=lambda m: m.summary.trainingCost)
    finally:
        data.unpersist()


def cluster_order(model) -> list[int]:
    """Model cluster numbers by falling size, then centre, so that numbering does not depend on the seed."""
    sizes, centres = model.summary.clusterSizes, [list(map(float, c)) for c in model.clusterCenters()]
    return sorted(range(len(centres)), key=lambda i: (-sizes[i], centres[i]))


def relabelled(model, col: str = "cluster") -> Column:
    pairs = [F.lit(v) for new, old in enumerate(cluster_order(model)) for v in (old, new)]
    return F.create_map(*pairs)[F.col(col)].cast("long")


def kmeans(
    df: DataFrame, feats: Sequence[str], k: int = 3, n_init: int = RESTARTS, seed: int = SEED
) -> DataFrame:
    """Complete rows with their cluster, 0 being the largest."""
    vectors = feature_vectors(df, feats)
    model = best_kmeans(vectors, "_features", k, n_init, seed)
    return model.transform(vectors).withColumn("cluster", relabelled(model)).drop("_features")


def cluster_means(clustered: DataFrame, feats: Sequence[str], by: str = "cluster") -> DataFrame:
    return clustered.groupBy(by).agg(*[F.round(F.avg(f), 2).alias(f) for f in feats])


def cluster_sizes(clustered: DataFrame, by: str = "cluster") -> DataFrame:
    return clustered.groupBy(by).agg(F.count("*").alias("count"))


def _fit_pca(vectors: DataFrame, col: str, n: int):
    model = PCA(k=n, inputCol=col, outputCol="_pca").fit(vectors)
    loadings = model.pc.toArray()
    # Each axis points to where its largest loading is positive.
    signs = [float(np.sign(loadings[np.argmax(np.abs(loadings[:, i])), i]) or 1.0) for i in range(n)]
    return model, signs


def project(vectors: DataFrame, col: str, n: int) -> DataFrame:
    model, signs = _fit_pca(vectors, col, n)
    axes = vector_to_array("_pca")
    points = model.transform(vectors)
    return points.withColumns({f"pc{i + 1}": axes[i] * signs[i] for i in range(n)}).drop("_pca")


def pca_project(df: DataFrame, feats: Sequence[str], n: int = 2, population: bool = False) -> DataFrame:
    """Complete rows with their first ``n`` principal components of the features, standardised as in :func:`feature_vectors`."""
    return project(feature_vectors(df, feats, population=population), "_features", n).drop("_features")


def pca_variance(df: DataFrame, feats: Sequence[str], n: int = 2) -> DataFrame:
    """Explained variance in percent per component, and the running total."""
    model, _ = _fit_pca(feature_vectors(df, feats), "_features", n)
    shares = [100.0 * float(v) for v in model.explainedVariance.toArray()]
    rows = [(i + 1, s, sum(shares[: i + 1])) for i, s in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows, "component long, variance_pct double, cumulative_pct double")


def array_vectors(df: DataFrame, vec: str, out: str = "_features", centred: bool = False) -> DataFrame:
    """An array column as ML vectors, null arrays left out."""
    rows = df.filter(F.col(vec).isNotNull()).withColumn("_raw", array_to_vector(F.col(vec).cast("array<double>")))
    if not centred:
        return rows.withColumnRenamed("_raw", out)
    scaler = StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=False)
    return scaler.fit(rows).transform(rows).drop("_raw")


def top_n(df: DataFrame, col: str, n: int, id_cols: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).orderBy(F.desc(col), *id_cols).limit(n)


def bottom_n(df: DataFrame, col: str, n: int, id_cols: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).orderBy(F.asc(col), *id_cols).limit(n)


def cohort(
    df: DataFrame, date: str, cat: str, val: str, period: str = "M", wide: bool = True, periods: Sequence[str] | None = None
) -> DataFrame:
    """Sums by category and calendar period; wide form has a column per period, in order, 0 where empty, at most 10,000 of them.

    For any number of periods, ``charts.as_map(cohort(..., wide=False), cat, "period", "total")`` has a map per category.
    """
    rows = df.select(date, cat, val).dropna()
    sums = rows.groupBy(F.col(cat), period_name(F.col(date), period).alias("period")).agg(F.sum(val).alias("total"))
    if not wide:
        return sums
    return sums.groupBy(cat).pivot("period", sorted(periods) if periods else None).agg(F.sum("total")).fillna(0)


# Band limits and labels.
BAND_PROBABILITIES = (0.0, 0.10, 0.25, 0.75, 0.90, 1.0)
BAND_LABELS = ("Bottom 10%", "10-25%", "25-75%", "75-90%", "Top 10%")


def percentile_bands(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Label each value by the percentile band it falls in; a value on an edge takes the lower band."""
    edges = exact_quantiles(df, {col: BAND_PROBABILITIES})[col]
    x = F.col(col).cast("double")
    band = F.when(x.isNull() | F.lit(edges[0] is None), None)
    for label, edge in zip(BAND_LABELS, edges[1:]):
        band = band.when(x <= F.lit(edge), label)
    return df.withColumn(name or f"{col}_band", band)


def band_summary(df: DataFrame, col: str) -> DataFrame:
    """Rows and range per band in band order, empty bands kept."""
    banded = percentile_bands(df.select(col), col, "band").groupBy("band")
    stats = banded.agg(F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max"))
    labels = df.sparkSession.createDataFrame(list(enumerate(BAND_LABELS)), "position long, band string")
    joined = labels.join(stats, "band", "left").select(
        "position", "band", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "min", "max"
    )
    return joined.orderBy("position")
