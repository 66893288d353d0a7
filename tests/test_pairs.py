"""The pair search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.operators.vectors import near_duplicate_candidates, near_duplicate_classes, near_duplicate_histogram, near_duplicates, pair_weight, similarity_histogram, similarity_matrix, text_copies
from tallyglass.plans import bands, pairs
from tallyglass.plans.bands import forest
from tallyglass.plans.components import components
from tallyglass.plans.pairs import extreme_pairs, pair_bounds


def brute(x, threshold):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= threshold}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    # Cluster 0 is crowded, and a third of all rows are copies of one vector.
    x = centres[np.where(rng.random(240) < 0.5, 0, rng.integers(0, 6, 240))] + 0.25 * rng.normal(size=(240, 12))
    x[rng.random(240) < 0.33] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    return x, df.repartition(4)


@pytest.mark.parametrize(("block_rows", "pivots"), [(2048, None), (10, 1), (10, 7), (40, 16)])
@pytest.mark.parametrize("threshold", [0.97, 0.8, 0.2])
def test_all_pairs_are_found(clustered, threshold, block_rows, pivots):
    x, df = clustered
    lines = near_duplicates(df, "id", "v", threshold, block_rows=block_rows, pivots=pivots).collect()
    folded = {}
    for i, row in enumerate(x):
        folded.setdefault(tuple(row), []).append(i)
    first = {ids[0]: ids for ids in folded.values()}
    found = set()
    for line in lines:
        if line.kind == "copy":
            assert line.id_b in first[line.id_a]
        else:
            found |= {tuple(sorted((a, b))) for a in first[line.id_a] for b in first[line.id_b]}
    for ids in first.values():
        found |= {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]}
    assert found == brute(x, threshold)
    assert len([ln for ln in lines if ln.kind == "copy"]) == sum(len(v) - 1 for v in first.values())
    assert len({(ln.id_a, ln.id_b) for ln in lines}) == len(lines)


def test_weights_count_row_pairs(clustered):
    x, df = clustered
    lines = near_duplicates(df, "id", "v", 0.8)
    total = lines.selectExpr("*").withColumn("w", pair_weight()).agg({"w": "sum"}).first()[0]
    assert total == len(brute(x, 0.8))
    assert sum(r["count"] for r in similarity_histogram(lines).collect()) == len(brute(x, 0.8))


@pytest.mark.parametrize("largest", [True, False])
def test_extreme_pairs_of_all_rows(spark, largest):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 4))
    x[[290, 295]] = x[280]
    x[299] = -x[285]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = extreme_pairs(spark.createDataFrame(list(zip(range(300), x.tolist())), "id long, vec array<double>"), 7, largest, block_rows=90, at_once=32).collect()
    a, b = np.triu_indices(300, 1)
    score = np.round((x @ x.T)[a, b], 12)
    want = np.lexsort((b, a, -score if largest else score))[:7]
    assert [(p.id_a, p.id_b) for p in got] == list(zip(a[want], b[want]))
    assert np.allclose([p.similarity for p in got], score[want])


def test_matrix_of_named_ids(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 11)) for i in range(500)], "id long, u double, v double")
    got = similarity_matrix(df, "id", ["u", "v"], ids=[3, 250, 499]).collect()
    assert {(p.id_a, p.id_b) for p in got} == {(i, j) for i in (3, 250, 499) for j in (3, 250, 499)}


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize(("spread", "cells"), [(0.05, 40), (3.0, 12), (0.3, 1)])
def test_extreme_pairs_by_bounds(spark, largest, spread, cells):
    r = np.random.default_rng(8)
    x = r.normal(size=(30, 6))[r.integers(0, 30, 900)] + spread * r.normal(size=(900, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[[3, 500]] = 0
    x[700] = x[12]
    rows = spark.createDataFrame(list(zip(range(900), x.tolist())), "id long, vec array<double>")
    opened = []
    got = extreme_pairs(rows, 12, largest, block_rows=100, at_once=64, cells=cells, opened=opened).collect()
    a, b = np.triu_indices(900, 1)
    score = np.round((x @ x.T)[a, b], 12)
    want = np.lexsort((b, a, -score if largest else score))[:12]
    assert [(p.id_a, p.id_b) for p in got] == list(zip(a[want], b[want]))
    assert np.allclose([p.similarity for p in got], score[want], atol=1e-11)


@pytest.mark.parametrize("largest", [True, False])
def test_clustered_data_open_few_cell_pairs(spark, largest):
    r = np.random.default_rng(9)
    x = r.normal(size=(60, 16))[r.integers(0, 60, 6000)] + 0.02 * r.normal(size=(6000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    opened = []
    extreme_pairs(spark.createDataFrame(list(zip(range(6000), x.tolist())), "id long, vec array<double>"), 10, largest, cells=60, opened=opened)
    assert opened[0] < 0.1 * opened[1]


def test_extreme_pairs_of_few_rows(spark):
    schema = "id long, vec array<double>"
    assert extreme_pairs(spark.createDataFrame([], schema), 5).count() == 0
    assert extreme_pairs(spark.createDataFrame([(1, [1.0, 0.0])], schema), 5).count() == 0
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], schema)
    assert [(p.id_a, p.id_b, p.similarity) for p in extreme_pairs(zeros, 5).collect()] == [(1, 2, 0.0), (1, 3, 0.0), (2, 3, 0.0)]


def test_pair_bounds_hold():
    r = np.random.default_rng(10)
    centres = r.normal(size=(8, 5))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[np.repeat(np.arange(8), 40)] + r.normal(size=(320, 5)) * np.repeat(r.uniform(0.01, 1, 8), 40)[:, None]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.repeat(np.arange(8), 40)
    radii = np.array([np.arccos(np.clip(x[own == c] @ centres[c], -1, 1)).max() for c in range(8)])
    for i, j, low, high in zip(*pair_bounds(centres, radii)):
        cosines = x[own == i] @ x[own == j].T
        assert (cosines <= high).all() and (cosines >= low).all()


@pytest.mark.parametrize(("block_rows", "pivots"), [(None, None), (30, 1), (25, 6)])
@pytest.mark.parametrize("threshold", [0.9, 0.3])
def test_histogram_without_the_pairs(clustered, threshold, block_rows, pivots):
    _, df = clustered
    expected = {r.bin: r["count"] for r in similarity_histogram(near_duplicates(df, "id", "v", threshold)).collect()}
    got = {r.bin: r["count"] for r in near_duplicate_histogram(df, "id", "v", threshold, block_rows=block_rows, pivots=pivots).collect()}
    assert got == expected and sum(got.values()) > 1000


def test_histogram_of_nothing_and_of_copies(spark):
    for rows, counts in (([(0, [1.0, 0.0]), (1, [0.0, 1.0])], []), ([(i, [1.0, 0.0]) for i in range(5)], [10])):
        found = near_duplicate_histogram(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.9).collect()
        assert len(found) == 20 and [r["count"] for r in found if r["count"]] == counts


def test_what_is_held_at_once_is_bounded(spark):
    import pandas as pd

    r = np.random.default_rng(12)
    x = r.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pdf = pd.DataFrame({"rep": range(3000), "vec": list(x), "copies": 1})
    sizes = [len(out) for out in pairs._placer(x[:256], 2.1)([pdf])]  # every row goes to all cells up to its own
    assert sum(sizes) > 250_000 and max(sizes) <= pairs.PLACED_AT_ONCE
    for rows in (100, 10**5, 10**7, 10**9):
        block = pairs.rows_of_block(rows, 128)
        assert block * 128 * 8 <= pairs.BLOCK_BYTES and (rows > 10**5 or rows / block <= pairs.BLOCKS)


def test_labels_are_the_smallest_of_what_is_joined():
    labels = pairs.join_labels(np.arange(9), np.array([7, 3, 8, 2]), np.array([3, 8, 5, 6]))
    assert labels.tolist() == [0, 1, 2, 3, 4, 3, 2, 3, 3]


def test_copies_of_texts_without_words(spark):
    texts = ["a b", "", "a b", None, "...", "", "a  b", None, "...", "a b", "A b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    assert {(r.id_a, r.id_b) for r in text_copies(df, "id", "t").collect()} == {(0, 2), (0, 9), (1, 5), (4, 8)}


# --- candidates by bands -----------------------------------------------------------------------------------------------
def near_copies(n, d, seed, groups=40, noise=0.06):
    """Random vectors, groups of near and exact copies, one crowded group, and rows without a direction."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for g in range(groups):
        x[r.integers(n, size=3)] = x[g] + noise * r.normal(size=(3, d))
    x[: n // 10] = x[0] + noise * r.normal(size=(n // 10, d))
    x[n // 2 : n // 2 + 30] = x[n // 2]
    return x


def as_rows(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + list(extra), "id long, v array<double>")


def test_bands_find_nearly_all_pairs_and_no_others(spark):
    x = near_copies(1500, 16, 1)
    df = as_rows(spark, x).repartition(4)
    exact = {(p.id_a, p.id_b): p for p in near_duplicates(df, "id", "v", 0.92).collect()}
    found = {(p.id_a, p.id_b): p for p in near_duplicate_candidates(df, "id", "v", 0.92).collect()}
    assert set(found) <= set(exact) and len(found) >= 0.98 * len(exact) > 3000
    for key, line in found.items():
        other = exact[key]
        assert abs(line.similarity - other.similarity) < 1e-12
        assert (line.kind, line.copies_a, line.copies_b) == (other.kind, other.copies_a, other.copies_b)


def test_recall_at_the_threshold(spark):
    """Pairs at hardly more than the threshold, the hardest ones."""
    r = np.random.default_rng(2)
    a = r.normal(size=(800, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=(800, 32))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.vstack([a, 0.9201 * a + np.sqrt(1 - 0.9201**2) * b])
    found = near_duplicate_candidates(as_rows(spark, x), "id", "v", 0.92)
    assert 0.96 * 800 <= found.filter("id_b = id_a + 800").count() <= found.count()


def test_classes_agree_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(bands.partners_and_forest, "__defaults__", (bands.RECALL, 50, 0))
    x = near_copies(900, 12, 3)
    extra = [(5000, None), (5001, [0.0] * 12), (5002, [float("inf")] + [1.0] * 11), (5003, [None] + [1.0] * 11), (5004, [float("nan")] * 12)]
    df = as_rows(spark, x, extra)
    got = {r.id: r for r in near_duplicate_classes(df, "id", "v", 0.92).collect()}
    assert len(got) == 905
    for i in range(5000, 5005):
        assert (got[i].rep, got[i].copies, got[i].links, got[i].partners, got[i].class_id) == (None, 1, 0, 0, i)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.92
    first = {}
    reps = [first.setdefault(tuple(v), i) for i, v in enumerate(x)]
    labels = np.arange(900)
    while (new := np.array([labels[near[i]].min() for i in range(900)])).tolist() != labels.tolist():
        labels = new
    for i in range(900):
        partners = np.flatnonzero(near[i] | (np.array(reps) == reps[i]))
        assert got[i].rep == reps[i] and got[i].copies == reps.count(reps[i])
        assert got[i].partners == len(partners) - 1 and got[i].links == len({reps[p] for p in partners}) - 1
        assert got[i].class_id == labels[i]


def word_like(n, d, seed):
    """Vectors that nearly all point the same way, so that bands hold large parts of them."""
    r = np.random.default_rng(seed)
    x = r.gamma(0.6, size=d) + r.random((n, 1)) * r.gamma(0.4, size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("string_ids", [False, True])
def test_exact_partners_of_crowded_vectors(spark, monkeypatch, string_ids):
    monkeypatch.setattr(pairs, "COSINES_AT_ONCE", 5000)
    x = word_like(700, 24, 3)
    # at 0.92 but for the rounding of floats
    x[600:650] = 0.0
    x[600:650, 0], x[650:, 0] = 1.0, 0.92 + np.linspace(-1e-8, 1e-8, 50)
    x[600:650, 1:], x[650:, 1:] = 0.0, 0.0
    x[600:650, 1] = np.arange(50) * 1e-12
    x[650:, 1] = np.sqrt(1 - x[650:, 0] ** 2)
    name = (lambda i: f"k{i:04}") if string_ids else int
    folded = spark.createDataFrame([(name(i), v.tolist(), i % 3 + 1) for i, v in enumerate(x)], f"rep {'string' if string_ids else 'long'}, vec array<double>, copies long")
    near = x @ x.T >= 0.92
    np.fill_diagonal(near, False)
    found = pairs.partners_and_roots(folded.repartition(3).checkpoint(), 0.92, 150).toPandas()
    counts = found[found["other"].isna()].groupby("rep")[["links", "partners"]].sum()
    weights = np.arange(700) % 3 + 1
    unsure = (np.abs(x @ x.T - 0.92) < 1e-14).any(axis=1)  # the order of addition decides
    for i in np.flatnonzero(~unsure):
        got = tuple(counts.loc[name(i)]) if name(i) in counts.index else (0, 0)
        assert got == (near[i].sum(), (near[i] * weights).sum()), i
    labels = np.arange(700)
    linked = found[found["other"].notna()]
    number = {name(i): i for i in range(700)}
    labels = pairs.join_labels(labels, linked["rep"].map(number).to_numpy(), linked["other"].map(number).to_numpy())
    assert labels.tolist() == pairs.join_labels(np.arange(700), *np.nonzero(near)).tolist()


def test_crowded_bands_give_way_to_all_pairs(spark):
    crowded = as_rows(spark, word_like(6000, 32, 4)).selectExpr("id AS rep", "v AS vec", "1L AS copies").checkpoint()
    assert bands.all_pairs_are_less(crowded, 0.92, 0.98, 2048, 0)
    r = np.random.default_rng(5).normal(size=(30_000, 8))
    apart = np.zeros((30_000, 256))
    apart[np.arange(30_000)[:, None], (np.arange(30_000)[:, None] * 7 + np.arange(8) * 31) % 256] = r
    apart = as_rows(spark, apart / np.linalg.norm(apart, axis=1, keepdims=True)).selectExpr("id AS rep", "v AS vec", "1L AS copies").checkpoint()
    assert not bands.all_pairs_are_less(apart, 0.99, 0.9, 2048, 0)


def test_bands_and_all_pairs_agree(spark):
    folded = as_rows(spark, near_copies(800, 12, 7)[80:]).selectExpr("id AS rep", "v AS vec", "1L AS copies")
    folded = folded.withColumn("vec", F.expr("transform(vec, x -> x / sqrt(aggregate(vec, 0D, (s, y) -> s + y * y)))")).dropDuplicates(["vec"]).checkpoint()
    exact, by_bands = ({(p.id_a, p.id_b) for p in bands.similar_pairs(folded, 0.92, exact=e).collect()} for e in (True, False))
    assert by_bands <= exact and len(by_bands) >= 0.98 * len(exact) > 20


def test_classes_with_previews(spark):
    df = spark.createDataFrame([(0, "x" * 100, [1.0, 0.0]), (1, "y", [1.0, 0.1]), (2, None, None)], "id long, t string, v array<double>")
    got = {r.id: r for r in near_duplicate_classes(df, "id", "v", 0.92, text="t").collect()}
    assert {i: (r.preview, r.links, r.class_id) for i, r in got.items()} == {0: ("x" * 80, 1, 0), 1: ("y", 1, 0), 2: (None, 0, 2)}


def test_pairs_of_a_histogram_are_found_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        calls.add(1)
        yield from batches

    lines = spark.createDataFrame([(0.5, "similar", 1, 1), (0.9, "similar", 2, 3)], "similarity double, kind string, copies_a long, copies_b long").coalesce(1)
    found = similarity_histogram(lines.mapInPandas(counted, lines.schema)).collect()
    assert calls.value == 1 and {r.bin: r["count"] for r in found if r["count"]} == {0: 1, 19: 6}


def test_lengths_are_computed_once_a_row(spark):
    """A vector's work grows with its components, not with their square."""
    from tallyglass.operators.vectors import usable_vectors

    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("inf"), 1.0])], "id long, v array<double>")
    assert {r.id: r.v for r in usable_vectors(df, "id", "v").collect()} == {0: [0.6, 0.8], 1: None, 2: None, 3: None, 4: None}
    plan = usable_vectors(df, "id", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(") == 1 and "transform(array(SQRT(" in plan  # not inside the function of a component


def test_classes_of_odd_tables(spark):
    schema = "id long, v array<double>"
    assert near_duplicate_classes(spark.createDataFrame([], schema), "id", "v").count() == 0
    lone = near_duplicate_classes(spark.createDataFrame([(3, [1.0, 2.0])], schema), "id", "v").first()
    assert (lone.rep, lone.links, lone.partners, lone.class_id) == (3, 0, 0, 3)
    alike = near_duplicate_classes(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], schema), "id", "v").collect()
    assert {(r.rep, r.copies, r.links, r.partners, r.class_id) for r in alike} == {(0, 50, 0, 49, 0)}


def test_most_rows_do_not_move(spark):
    """Of unrelated vectors, few share a band; when rows double, what the bands bring together doubles too."""
    sent = []
    for n in (4000, 8000):
        r = np.random.default_rng(4)
        x = r.normal(size=(n, 64))
        x[n - n // 10 :] = x[: n // 10] + 0.1 * r.normal(size=(n // 10, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        folded = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "rep long, vec array<double>, copies long")
        sent.append(bands._meetings(folded.checkpoint(), 0.92, 0.98, 2048, 0).count())
    assert sent[1] < 2.5 * sent[0]


def test_forest_joins_what_the_matrix_joins():
    r = np.random.default_rng(5)
    for _ in range(50):
        hit = r.random((12, 15)) < 0.1
        joined = forest(hit)
        assert len(joined) <= 26 and all(hit[i, j] for i, j in joined)

        def groups(links):
            labels = list(range(27))
            for i, j in links:
                labels = [labels[12 + j] if x == labels[i] else x for x in labels]
            return {frozenset(k for k in range(27) if labels[k] == x) for x in labels}

        assert groups(joined) == groups(zip(*np.nonzero(hit)))


def test_components_by_stars(spark):
    r = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    found = {row.id: row.root for row in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    root = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert found == {x: y for x, y in root.items() if x != y}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- all pairs of stored blocks ----------------------------------------------------------------------------------------
@pytest.mark.parametrize("threshold", [-0.5, 0.3, 0.92, 0.999])
def test_similar_rows_of_two_blocks(monkeypatch, threshold):
    monkeypatch.setattr(pairs, "CUT_ROWS", 13)
    monkeypatch.setattr(pairs, "COMPARED_AT_ONCE", 100)
    x, y = word_like(150, 16, 8), near_copies(120, 16, 9, groups=4)
    y = np.vstack([x[:40] + 0.01, y, -x[:5]])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    found = [(i, j) for a, b, _ in pairs.similar_rows(x.astype(np.float32), y.astype(np.float32), threshold) for i, j in zip(a, b)]
    cosines = x @ y.T
    assert len(found) == len(set(found)) and {(i, j) for i, j in zip(*np.nonzero(cosines >= threshold + 1e-6))} <= set(found)
    assert all(cosines[i, j] >= threshold - 1e-6 for i, j in found)


@pytest.mark.parametrize("block_rows", [40, 5000])
def test_a_row_meets_all_blocks_and_leaves_as_few_lines(spark, block_rows):
    """However many blocks there are, vectors are not sent to their meetings, and lines do not grow with these."""
    x = word_like(700, 24, 3)
    folded = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "rep long, vec array<double>, copies long").checkpoint()
    found = pairs.partners_and_roots(folded, 0.92, block_rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    lines = found.toPandas()
    near = x @ x.T >= 0.92
    np.fill_diagonal(near, False)
    counts = lines[lines["other"].isna()].set_index("rep")["links"]
    assert counts.index.is_unique and counts.to_dict() == {i: n for i, n in enumerate(near.sum(axis=1)) if n}
    assert (near.sum(axis=1) > 0).sum() > 350 and len(lines) <= 2.2 * len(x)


def test_vectors_do_not_move_to_find_classes(spark, monkeypatch):
    from tallyglass.plans import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(0, [0.0, 1.0]), (1, [-0.0, 2.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0, 0.001])], "id long, v array<double>")
    classes = near_duplicate_classes(df.repartition(3), "id", "v", 0.92)
    plan = classes._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and not any("vec" in line for line in plan.splitlines() if "Join" in line)
    got = {r.id: (r.rep, r.copies, r.links, r.partners, r.class_id) for r in classes.collect()}
    assert got == {0: (0, 3, 0, 2, 0), 1: (0, 3, 0, 2, 0), 3: (0, 3, 0, 2, 0), 2: (2, 1, 1, 1, 2), 5: (5, 1, 1, 1, 2), 4: (None, 1, 0, 0, 4)}


def test_words_are_counted_once_for_the_vectors_of_some_columns(spark):
    from tallyglass.operators.vectors import embed_text

    texts = ["a b c", "a b", "", None, "b b d", "...", "a b c"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id long, t string, u string").repartition(2)
    whole, some = embed_text(df, "t", 16), embed_text(df, "t", 16, kept=["id"])
    assert some.columns == ["id", "embedding"] and "_words" in whole._jdf.queryExecution().logical().toString()
    assert "words" not in some._jdf.queryExecution().logical().toString()
    assert {r.id: r.embedding for r in some.collect()} == {r.id: r.embedding for r in whole.collect()}


def test_bands_that_send_rows_many_times_give_way(spark, monkeypatch):
    """Bands that are less work, but of many blocks each: what they write would grow with the square of the rows."""
    monkeypatch.setattr(bands, "STORED_COMPONENT_WORK", 1.0)
    rows = as_rows(spark, word_like(1200, 32, 4)).selectExpr("id AS rep", "v AS vec", "1L AS copies").checkpoint()
    assert [bands.all_pairs_are_less(rows, 0.92, 0.98, block, 0, stored=True) for block in (2048, 50)] == [False, True]
