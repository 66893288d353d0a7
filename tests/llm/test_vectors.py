"""Vector operators against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tallyglass.llm import bit_codes as bc
from tallyglass.llm import multiprobe as mp
from tallyglass.llm import vectors

ODD = [None, [], [0.0, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [1.0, 2.0]]


def clusters(seed=0, n=900, d=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    near = centres[r.integers(0, 12, n // 3)] + r.normal(size=(n // 3, d)) * r.choice([0.02, 0.3], size=(n // 3, 1))
    return np.concatenate([r.normal(size=(n - len(near), d)), near]) * r.uniform(0.1, 9, size=(n, 1))


def brute_links(ids, x, threshold=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    root = np.arange(len(ids))
    while True:
        new = np.array([min([root[i], *root[linked[i]]]) for i in range(len(ids))])
        if (new == root).all():
            break
        root = new
    return linked.sum(axis=1), np.array(ids)[root]


def brute_nearest(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(np.array(ids) % every == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        out[ids[i]] = [(ids[j], scores[j]) for j in np.lexsort((ids, -scores))[: min(k, len(ids) - 1)]]
    return out


def test_plan_reaches_the_recall():
    for n in (10, 10_000, 10**9):
        bits, tables = bc.plan(n, 0.9, 0.995)
        assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables >= 0.995


def test_estimates_are_unbiased_and_within_bounds():
    r = np.random.default_rng(0)
    d = 64
    o = r.normal(size=(2000, d))
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    q = 0.9 * o + math.sqrt(1 - 0.81) * np.array([w / np.linalg.norm(w) for w in (v - (v @ u) * u for u, v in zip(o, r.normal(size=o.shape)))])
    turn = vectors.rotation(d, 5)
    signs, f = bc.codes(o, [turn])
    estimate = np.einsum("nd,nd->n", np.where(signs, 1, -1), q @ turn) / math.sqrt(d) / f
    spread = math.sqrt(1 - 0.81) * np.sqrt(1 - f**2) / f / math.sqrt(d - 1)
    assert abs(estimate.mean() - 0.9) < 0.005
    assert (np.abs(estimate - 0.9) > bc.DEVIATIONS * spread).mean() < 0.001
    assert 0.8 < np.std((estimate - 0.9) / spread) < 1.2


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bc, "BLOCK", 20)  # so that buckets are cut
    x = clusters()
    ids = list(range(1000, 1000 + len(x)))
    got = {r.vec_id: r for r in bc.near_vectors(spark.createDataFrame(list(zip(ids, x.tolist())), "vec_id long, embedding array<double>"), recall=0.9999).collect()}
    links, component = brute_links(ids, x)
    assert links.sum() > 1000
    assert [got[i].n_links for i in ids] == links.tolist()
    assert [got[i].component_id for i in ids] == component.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings(spark, table):
    rows = table("embeddings").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    planted = x[:40] + np.random.default_rng(1).normal(size=(40, x.shape[1])) * 0.02
    every = spark.createDataFrame([(i, v) for i, v in zip([*ids, *range(5000, 5040)], [*x.tolist(), *planted.tolist()])], "vec_id long, embedding array<double>")
    links, component = brute_links([*ids, *range(5000, 5040)], np.concatenate([x, planted]))
    got = {r.vec_id: r for r in bc.near_vectors(every).collect()}
    assert sum(got[i].n_links for i in got) >= 0.98 * links.sum() > 0
    assert sum(got[i].component_id == c for i, c in zip([*ids, *range(5000, 5040)], component)) >= len(got) - 1


def test_link_edges(spark):
    schema = "vec_id long, embedding array<double>, hash string, node string, n_links string"
    v, w = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(i, o) for i, o in enumerate(ODD)] + [(10, v), (11, v), (12, [3.0, 0.1, 0.0, 0.0]), (12, w), (12, w), (None, w), (13, [1e300, 0.0, 0.0, 1e300])]
    got = bc.near_vectors(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    out = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect())
    want = [(-1, 2, 12, False), *[(i, 0, i, True) for i in range(len(ODD))], (10, 2, 10, True), (11, 2, 10, False), (12, 2, 10, False)]
    assert out == want + [(12, 2, 12, True), (12, 2, 12, True), (13, 0, 13, True)]
    empty = spark.createDataFrame([], schema)
    assert bc.near_vectors(empty).count() == 0
    assert bc.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0][1:] == (0, 1, True)


def test_probes_come_by_falling_probability_and_cover_it():
    tables = mp.Tables(10_000, 16, 0)
    query = mp.directions(np.random.default_rng(2).normal(size=(1, 16)))[0]
    seen, befores = set(), []
    for cell, before in tables.probes(query, 0, 0.4):
        seen.add(cell)
        befores.append(before)
    steps = np.diff(befores)
    assert len(seen) == len(befores) and (np.diff(steps) <= 1e-12).all() and befores[-1] > 0.999


@pytest.mark.parametrize("k", [5, 20])
def test_recall(spark, monkeypatch, k):
    monkeypatch.setattr(mp, "BLOCK", 16)
    x = clusters(3)
    ids = np.arange(len(x)) * 5
    got = defaultdict(list)
    rows = mp.nearest(spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "vec_id long, embedding array<double>"), k=k).collect()
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(ids, x, 20, k)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        true = dict(best)
        hits += len(true.keys() & dict(got[q]).keys())
        assert got[q] == sorted(got[q], key=lambda t: (-t[1], t[0])) and len(got[q]) == k
        assert all(abs(x[i // 5] @ x[q // 5] - s) < 1e-9 for i, s in got[q])
    assert hits >= 0.93 * k * len(want)


def test_search_edges(spark):
    schema = "vec_id long, embedding array<double>, bucket string, rank string"
    rows = [(i, o) for i, o in enumerate(ODD)] + [(20, [1.0, 0.0, 0.0, 0.0]), (40, [2.0, 0.0, 0.0, 0.0]), (41, [2.0, 0.0, 0.0, 0.0]), (43, [-1.0, 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (41, [2.0, 0.0, 0.0, 0.0])]
    got = mp.nearest(spark.createDataFrame([(*r, "a", "b") for r in rows], schema), missing=0.0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    out = sorted(map(tuple, got.collect()))
    assert out == [(20, 1, 40, 2.0), (20, 2, 41, 2.0), (20, 3, 43, -1.0), (40, 1, 41, 4.0), (40, 2, 20, 2.0), (40, 3, 43, -2.0)]
    assert mp.nearest(spark.createDataFrame([], schema)).count() == 0
    assert mp.nearest(spark.createDataFrame([(7, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def recall(spark, ids, x, k=20):
    got = defaultdict(set)
    for r in mp.nearest(spark.createDataFrame(list(zip(ids, x.tolist())), "vec_id long, embedding array<double>"), k=k).collect():
        got[r.query_id].add(r.vec_id)
    want = {q: {i for i, _ in best} for q, best in brute_nearest(ids, x, 20, k).items()}
    assert all(len(got[q]) == len(best) for q, best in want.items())
    return {q: len(got[q] & best) / len(best) for q, best in want.items()}


def test_few_candidates_are_all_found(spark):
    for seed in range(3):
        x = np.random.default_rng(seed).normal(1, 0.5, size=(20, 8))
        assert set(recall(spark, list(range(0, 400, 20)), x).values()) == {1.0}


def test_recall_of_skewed_tables(spark):
    r = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    dense = np.repeat(unit(r.normal(size=(24, 32))), 50, axis=0)
    x = np.concatenate([unit(dense + r.normal(size=dense.shape) * 0.01), unit(r.normal(size=(800, 32)))])
    ids = list(range(0, 5 * len(x), 5))
    per_query = recall(spark, ids, x)
    sparse = [v for q, v in per_query.items() if q >= 5 * len(dense)]
    assert np.mean(list(per_query.values())) >= 0.95 and np.mean(sparse) >= 0.9
