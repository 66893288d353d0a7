"""Text and numeric vectors: embedding, search, near-duplicates, similar rows."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import equal_width_bin
from ..functions.numeric import cosine, euclidean, norm
from ..plans.bands import RECALL, partners_and_forest
from ..plans.bands import similar_pairs as pairs_by_bands
from ..plans.components import components
from ..plans.joins import salted_join, with_summary
from ..plans.pairs import copy_links, extreme_pairs, fold_copies, similar_representatives, similarity_counts
from ..session import ensure_checkpoint_dir, ship_package
from .segments import RESTARTS, SEED, array_vectors, best_kmeans, pca_project, project, relabelled

# Lengths of the text shown beside a result.
PREVIEW_CHARS = 80
REPRESENTATIVE_CHARS = 100
MATRIX_LIMIT = 200

Encoder = Callable[[list[str]], np.ndarray]


def embed_text(
    df: DataFrame, col: str, dim: int = 384, encoder: Callable[[], Encoder] | None = None, out: str = "embedding", kept: Sequence[str] | None = None
) -> DataFrame:
    """Rows with text, plus a unit vector of it.

    The default is hashed word counts weighted by inverse document frequency. ``encoder`` is a factory
    called once per Python worker task; the function it returns maps a list of texts to a matrix.
    With ``kept``, only these columns stay beside the vector, and words are counted once: the counts are checkpointed for
    both passes, over the frequencies and over the vectors.
    """
    rows = df.filter(F.col(col).isNotNull())
    if encoder is not None:
        ship_package(df.sparkSession)

        @F.pandas_udf("array<double>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = encoder()
            for texts in batches:
                yield pd.Series(list(np.asarray(model(texts.tolist()), dtype=float)))

        encoded = unit_vectors(rows.withColumn(out, encode(F.col(col))), out)
        return encoded if kept is None else encoded.select(*kept, out)
    words = RegexTokenizer(inputCol=col, outputCol="_words", pattern=r"[^\p{L}\p{N}]+").transform(rows)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim).transform(words)
    if kept is not None:
        ensure_checkpoint_dir(df.sparkSession)
        counts = counts.select(*kept, "_counts").checkpoint()
    weighted = IDF(inputCol="_counts", outputCol="_weighted").fit(counts).transform(counts)
    unit = Normalizer(inputCol="_weighted", outputCol="_unit").transform(weighted)
    return unit.withColumn(out, vector_to_array("_unit")).drop("_words", "_counts", "_weighted", "_unit")


def unit_vectors(df: DataFrame, vec: str) -> DataFrame:
    # the length is bound by a lambda of its own, as it would be computed anew for every component
    divided = F.transform(F.array(norm(F.col(vec))), lambda size: F.when(size > 0, F.transform(vec, lambda v: F.try_divide(v.cast("double"), size))))
    return df.withColumn(vec, F.get(divided, F.lit(0)))


def balanced_sum(terms: Sequence[Column]) -> Column:
    """Sum as a shallow expression tree, so that wide vectors stay within code generation."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def vector_search(
    df: DataFrame, query: Sequence[float], k: int, vec: str, id_col: str, metric: str = "cosine"
) -> DataFrame:
    """The ``k`` rows nearest to ``query`` with their score, best first; ties by id.

    The query enters as literals, so scoring is generated code and only ``k`` rows per task are kept.
    """
    q = [float(v) for v in query]
    x = [F.get(F.col(vec), F.lit(i)).cast("double") for i in range(len(q))]
    rows = df.filter(F.size(vec) == len(q))
    if metric == "cosine":
        length = F.sqrt(balanced_sum([v * v for v in x])) * float(np.sqrt(np.dot(q, q)))
        score, order = F.try_divide(balanced_sum([v * w for v, w in zip(x, q)]), length), F.desc_nulls_last("score")
    elif metric == "euclidean":
        score, order = F.sqrt(balanced_sum([(v - w) * (v - w) for v, w in zip(x, q)])), F.asc_nulls_last("score")
    else:
        raise ValueError("metric must be cosine or euclidean")
    return rows.withColumn("score", score).orderBy(order, id_col).limit(k)


def vector_of(df: DataFrame, id_col: str, key, vec: str) -> list[float]:
    """The vector of one row."""
    found = df.filter(F.col(id_col) == key).select(vec).first()
    if found is None or found[0] is None:
        raise KeyError(f"{id_col} {key!r} " + ("does not occur" if found is None else "has no vector"))
    return [float(v) for v in found[0]]


def embedding_projection(
    df: DataFrame, vec: str, id_col: str, n: int = 2, text: str | None = None, label: str | None = None
) -> DataFrame:
    """Principal components of the centred vectors with a text preview and label."""
    points = project(array_vectors(df, vec, centred=True), "_features", n)
    extra = [F.substring(text, 1, PREVIEW_CHARS).alias("preview")] if text else []
    return points.select(id_col, *([label] if label else []), *extra, *[f"pc{i + 1}" for i in range(n)])


def usable_vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """id and vector, scaled to length 1; null where it is null, of length 0, or has a null, NaN or infinite component."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    return unit_vectors(df.select(id_col, F.when(finite, F.col(vec)).alias(vec)), vec)


def near_duplicates(
    df: DataFrame, id_col: str, vec: str, threshold: float = 0.92, text: str | None = None,
    block_rows: int | None = None, pivots: int | None = None,
) -> DataFrame:
    """Every pair with cosine at or above ``threshold``, exact copies folded. The work may be quadratic in the rows.

    ``similar`` lines join the first rows of two different vectors; ``copies_a`` and ``copies_b`` say how
    many rows carry each, so a line stands for their product of row pairs. ``copy`` lines join the first row of a
    vector to each later row with the same vector. Rows without a direction are in no pair;
    :func:`near_duplicate_classes` lists them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # Both are read several times, and the vectors may be costly to make.
    unit = usable_vectors(df, id_col, vec).filter(F.col(vec).isNotNull()).checkpoint()
    folded = fold_copies(unit, id_col, vec).checkpoint()
    return _lines(df, unit, folded, similar_representatives(folded, threshold, block_rows, pivots), id_col, vec, text)


def near_duplicate_candidates(
    df: DataFrame, id_col: str, vec: str, threshold: float = 0.92, text: str | None = None, recall: float = RECALL, seed: int = 0,
    ordered: bool = True,
) -> DataFrame:
    """The lines of :func:`near_duplicates` for pairs that share a band of sign bits, which is near-linear work.

    All lines are right; a pair at the threshold is missing with probability 1 - ``recall``, closer ones less often, copies
    never. Where bands separate so little that comparing all rows is less work, that is done and none is missing.
    Meant for thresholds of 0.8 and more: below, the number of bands grows quickly.
    """
    ensure_checkpoint_dir(df.sparkSession)
    unit = usable_vectors(df, id_col, vec).filter(F.col(vec).isNotNull()).checkpoint()
    folded = fold_copies(unit, id_col, vec).checkpoint()
    return _lines(df, unit, folded, pairs_by_bands(folded, threshold, recall, seed=seed), id_col, vec, text, ordered)


def _lines(df: DataFrame, unit: DataFrame, folded: DataFrame, pairs: DataFrame, id_col: str, vec: str, text: str | None, ordered: bool = True) -> DataFrame:
    similar = pairs.select("id_a", "id_b", F.least("similarity", F.lit(1.0)).alias("similarity"), F.lit("similar").alias("kind"), "copies_a", "copies_b")
    copies = copy_links(unit, folded, id_col, vec).select("id_a", "id_b", F.lit(1.0).alias("similarity"), F.lit("copy").alias("kind"), F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"))
    found = similar.unionByName(copies)
    if text:
        texts = df.select(F.col(id_col).alias("_id"), F.substring(text, 1, PREVIEW_CHARS).alias("_text"))
        for side in ("a", "b"):
            shown = texts.select(F.col("_id").alias(f"id_{side}"), F.col("_text").alias(f"text_{side}"))
            found = found.join(shown, f"id_{side}")
        found = found.select("id_a", "id_b", "similarity", "kind", "copies_a", "copies_b", "text_a", "text_b")
    return found.orderBy(F.desc("similarity"), "id_a", "id_b") if ordered else found


def near_duplicate_classes(
    df: DataFrame, id_col: str, vec: str, threshold: float = 0.92, recall: float = RECALL, seed: int = 0, text: str | None = None
) -> DataFrame:
    """A line per row: id, rep, copies, links, partners, class_id. A group of n near copies gives n lines, not n² pairs.

    With ``text`` a preview of it follows.

    ``rep`` is the first row with the same vector and ``copies`` the rows that carry it, ``links`` the different vectors at or
    above ``threshold``, ``partners`` all other rows at or above it, and ``class_id`` the smallest id that links lead to.
    A row without a direction (null or zero vector, null or infinite component) has no rep, no partners and itself as
    class. Links are found as by :func:`near_duplicate_candidates`. Ids are unique and not null.
    """
    ensure_checkpoint_dir(df.sparkSession)
    unit = usable_vectors(df, id_col, vec).checkpoint()
    folded = fold_copies(unit, id_col, vec).checkpoint()
    found = partners_and_forest(folded, threshold, recall, seed=seed).checkpoint()
    roots = components(found.filter("other IS NOT NULL"), "rep", "other")
    counts = found.filter("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))
    linked = counts.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    # only copies need their vector to find their class, and hashes of 256 bits stand for it, so that no vector moves
    hashes = [F.xxhash64(F.lit(seed), "vec").alias(f"_h{seed}") for seed in range(4)]
    keys = [f"_h{seed}" for seed in range(4)]
    classes = folded.select("rep", "copies", *hashes).join(linked, "rep", "left").select(*keys, "rep", "copies", "links", "partners", F.coalesce("root", "rep").alias("class_id"))
    rows = unit.select(F.col(id_col).alias("_id"), F.col(vec).alias("vec"))
    alone, several = classes.filter("copies = 1").drop(*keys), classes.filter("copies > 1")
    by_vector = salted_join(rows.filter("vec IS NOT NULL").select("_id", *hashes), several, keys, ["_id"]).drop(*keys)
    by_id = alone.withColumn("_id", F.col("rep"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    with_vector = by_id.unionByName(by_vector, allowMissingColumns=True)
    with_vector = with_vector.select("_id", "rep", "copies", count("links").alias("links"), (count("partners") + F.col("copies") - 1).alias("partners"), "class_id")
    nothing = F.lit(0).cast("long")
    without = rows.filter("vec IS NULL").select("_id", F.lit(None).cast(rows.schema["_id"].dataType).alias("rep"), F.lit(1).cast("long").alias("copies"), nothing.alias("links"), nothing.alias("partners"), F.col("_id").alias("class_id"))
    listed = with_vector.unionByName(without).withColumnRenamed("_id", id_col)
    if text is None:
        return listed
    return listed.join(df.select(id_col, F.substring(text, 1, PREVIEW_CHARS).alias("preview")), id_col)


def text_copies(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_a, id_b): the first row of a text and each later row with the same text, so n copies give n - 1 lines.

    Texts are compared by their SHA-256, the only thing shuffled beside the ids. Ids are unique; rows without text are in no line.
    """
    rows = df.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id_b"), F.sha2(text, 256).alias("_hash"))
    first = rows.groupBy("_hash").agg(F.min("id_b").alias("id_a"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return salted_join(rows, first, ["_hash"], ["id_b"]).filter("id_a <> id_b").select("id_a", "id_b")


def pair_weight() -> Column:
    """Row pairs a line of :func:`near_duplicates` stands for; the copy lines of n copies share n(n-1)/2."""
    return F.when(F.col("kind") == "similar", F.col("copies_a") * F.col("copies_b")).otherwise(F.col("copies_a") / 2.0)


def similarity_histogram(pairs: DataFrame, bins: int = 20) -> DataFrame:
    """Row pairs per equal-width similarity bin. The pairs are found once and checkpointed, as both the ends and the bins need them."""
    ensure_checkpoint_dir(pairs.sparkSession)
    pairs = pairs.select("similarity", "kind", "copies_a", "copies_b").checkpoint()
    ends = pairs.agg(F.struct(F.min("similarity").alias("low"), F.max("similarity").alias("high")))
    bin_ = equal_width_bin(F.col("similarity"), F.col("_e.low"), F.col("_e.high"), bins)
    binned = with_summary(pairs, "_e", ends).withColumn("bin", bin_)
    counts = binned.groupBy("bin").agg(F.sum(pair_weight()).cast("long").alias("count"))
    every = pairs.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def near_duplicate_histogram(
    df: DataFrame, id_col: str, vec: str, threshold: float = 0.92, bins: int = 20, block_rows: int | None = None, pivots: int | None = None
) -> DataFrame:
    """:func:`similarity_histogram` of :func:`near_duplicates`, counted where the pairs are found; none of them is kept."""
    ensure_checkpoint_dir(df.sparkSession)
    unit = usable_vectors(df, id_col, vec).filter(F.col(vec).isNotNull())
    folded = fold_copies(unit, id_col, vec).checkpoint()
    counts, _, _ = similarity_counts(folded, threshold, bins, block_rows, pivots)
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("weight", F.lit(0).cast("long")).alias("count"))


def semantic_clusters(df: DataFrame, vec: str, k: int = 4, n_init: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """k-means on the vectors as they are; cluster 0 is the largest."""
    vectors = array_vectors(df, vec)
    model = best_kmeans(vectors, "_features", k, n_init, seed)
    return model.transform(vectors).withColumn("cluster", relabelled(model)).drop("_features")


def cluster_representatives(
    df: DataFrame, vec: str, id_col: str, by: str = "cluster", n: int = 3, text: str | None = None
) -> DataFrame:
    """The ``n`` rows nearest to the mean vector of each cluster, with the cluster's size."""
    rows = df.filter(F.col(vec).isNotNull() & F.col(by).isNotNull())
    as_vector = array_to_vector(F.col(vec).cast("array<double>"))
    centres = rows.groupBy(by).agg(Summarizer.mean(as_vector).alias("_c"), F.count("*").alias("size"))
    centres = centres.select(by, vector_to_array("_c").alias("_centre"), "size")
    near = salted_join(rows, centres, [by], [id_col]).withColumn("distance", euclidean(F.col(vec), F.col("_centre")))
    order = Window.partitionBy(by).orderBy("distance", id_col)
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    extra = [F.substring(text, 1, REPRESENTATIVE_CHARS).alias("preview")] if text else []
    return ranked.select(by, F.col("rank").cast("long").alias("rank"), id_col, "distance", "size", *extra)


def standardize(df: DataFrame, feats: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Complete rows with each feature centred and divided by its population spread (0 where that is 0)."""
    complete = df.dropna(subset=list(feats))
    x = {f: F.col(f"`{f}`").cast("double") for f in feats}
    stats = complete.agg(
        F.struct(*[e for i, f in enumerate(feats) for e in (F.avg(x[f]).alias(f"m{i}"), F.stddev_pop(x[f]).alias(f"s{i}"))])
    )
    scaled = {
        f"{prefix}{f}": F.coalesce(F.try_divide(x[f] - F.col(f"_s.m{i}"), F.col(f"_s.s{i}")), F.lit(0.0)) for i, f in enumerate(feats)
    }
    return with_summary(complete, "_s", stats).withColumns(scaled).drop("_s")


def similar_rows(
    df: DataFrame, id_col: str, key, feats: Sequence[str], k: int = 5, metric: str = "cosine"
) -> DataFrame:
    """Whole rows nearest to the row ``key`` in the standardised features, the row itself left out."""
    z = [f"z_{f}" for f in feats]
    scaled = standardize(df, feats)
    query = {c: F.col(f"_q.{c}") for c in z}
    rows = with_summary(scaled, "_q", scaled.filter(F.col(id_col) == key).select(F.struct(*z)))
    if metric == "cosine":
        along = balanced_sum([F.col(c) * query[c] for c in z])
        lengths = F.sqrt(balanced_sum([F.col(c) * F.col(c) for c in z])) * F.sqrt(balanced_sum([query[c] * query[c] for c in z]))
        score, order = F.coalesce(F.try_divide(along, lengths), F.lit(0.0)), F.desc("score")
    elif metric == "euclidean":
        score = F.sqrt(balanced_sum([(F.col(c) - query[c]) * (F.col(c) - query[c]) for c in z]))
        order = F.asc("score")
    else:
        raise ValueError("metric must be cosine or euclidean")
    ranked = rows.filter(F.col(id_col) != key).withColumn("score", score).orderBy(order, id_col).limit(k)
    return ranked.select(F.round("score", 4).alias("score"), *df.columns)


def match_profile(
    df: DataFrame, id_col: str, key, feats: Sequence[str], k: int = 5, metric: str = "cosine", shown: int = 3
) -> DataFrame:
    """Original feature values of the query row (rank 0) and its ``shown`` best matches, one row per feature."""
    if len(feats) < 3:
        raise ValueError("a profile needs at least three features")
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    matches = similar_rows(df, id_col, key, feats, k, metric).orderBy(order, id_col).limit(shown)
    ranked = matches.withColumn("rank", F.row_number().over(Window.orderBy(order, id_col)).cast("long"))
    query = df.filter(F.col(id_col) == key).withColumn("rank", F.lit(0).cast("long"))
    kept = ["rank", *dict.fromkeys([id_col, *feats])]
    both = query.select(*kept).unionByName(ranked.select(*kept))
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in feats)
    return both.selectExpr("rank", f"`{id_col}`", f"stack({len(feats)}, {pairs}) AS (feature, value)")


def numeric_projection(df: DataFrame, feats: Sequence[str], n: int = 2, population: bool = False) -> DataFrame:
    return pca_project(df, feats, n, population)


def similarity_matrix(
    df: DataFrame, id_col: str, feats: Sequence[str], m: int = 50, label: str | None = None, ids: Sequence | None = None
) -> DataFrame:
    """Cosine of every two of the rows with the given ids in the standardised features; without ids, of the first ``m`` (at most ``MATRIX_LIMIT``)."""
    if ids is None and not 2 <= m <= MATRIX_LIMIT:
        raise ValueError(f"m must be between 2 and {MATRIX_LIMIT}")
    name = F.col(label).cast("string") if label else F.col(id_col).cast("string")
    z = F.array(*[F.col(f"z_{f}") for f in feats])
    scaled = standardize(df, feats)
    named = scaled.orderBy(id_col).limit(m) if ids is None else scaled.filter(F.col(id_col).isin(list(ids)))
    first = named.select(F.col(id_col).alias("id"), name.alias("label"), z.alias("z"))
    # At most MATRIX_LIMIT rows or those named, folded into one and unfolded twice.
    folded = first.agg(F.collect_list(F.struct("id", "label", "z")).alias("rows"))
    rows = folded.select("rows", F.explode("rows").alias("a"))
    cells = rows.select(F.col("a.id").alias("id_a"), F.col("a.label").alias("label_a"), F.col("a.z").alias("z"), F.explode("rows").alias("o"))
    return cells.select(
        "id_a", "label_a", F.col("o.id").alias("id_b"), F.col("o.label").alias("label_b"),
        F.coalesce(cosine(F.col("z"), F.col("o.z")), F.lit(0.0)).alias("similarity"),
    )


def similar_pairs(matrix: DataFrame, n: int = 10, largest: bool = True) -> DataFrame:
    """The ``n`` most or least similar pairs of a similarity matrix, each once."""
    order = F.desc("similarity") if largest else F.asc("similarity")
    return matrix.filter("id_a < id_b").orderBy(order, "id_a", "id_b").limit(n)


def similar_pairs_of_all(
    df: DataFrame, id_col: str, feats: Sequence[str], n: int = 10, largest: bool = True, label: str | None = None
) -> DataFrame:
    """The ``n`` most or least similar pairs of all complete rows in the standardised features, each once. Ids are unique."""
    ensure_checkpoint_dir(df.sparkSession)
    name = F.col(label).cast("string") if label else F.col(id_col).cast("string")
    z = F.array(*[F.col(f"z_{f}") for f in feats])
    length = F.sqrt(balanced_sum([F.col(f"z_{f}") * F.col(f"z_{f}") for f in feats]))
    unit = F.transform(z, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))
    rows = standardize(df, feats).select(F.col(id_col).alias("id"), name.alias("label"), unit.alias("vec")).checkpoint()
    found = extreme_pairs(rows.select("id", "vec"), n, largest)
    for side in ("a", "b"):
        found = rows.select(F.col("id").alias(f"id_{side}"), F.col("label").alias(f"label_{side}")).join(F.broadcast(found), f"id_{side}")  # n rows
    return found.select("id_a", "label_a", "id_b", "label_b", "similarity")
