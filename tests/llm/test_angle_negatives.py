"""Hard negatives against brute force on odd and clustered vectors; the bounds against exact scores."""

import math

import numpy as np
import pytest

from tallyglass.llm import angle_negatives
from tallyglass.llm.angle_negatives import angles_to, mine, references, score_bounds

SCHEMA = "vec_id long, embedding array<double>, label int, k int, v int, id int, cell int"


def brute(rows, every=100, positives=5, negatives=5, low=80, high=100, scale=256):
    """(id, vector, label) rows; by the definition, in Python's whole numbers."""
    sizes = {}
    whole = []
    for i, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) or abs(x) * scale >= 2**31 for x in v):
            continue
        v = [math.floor(scale * float(x)) for x in v]
        if sum(x * x for x in v) < 2**62:
            whole.append((i, v, label))
            sizes[len(v)] = sizes.get(len(v), 0) + 1
    size = min(sizes, key=lambda s: (-sizes[s], s), default=0)
    whole = [r for r in whole if len(r[1]) == size]
    key = lambda r: (-r[1], r[0] is not None, r[0] or 0)
    out = []
    for n, (anchor, q, label) in enumerate(whole):
        if anchor is None or anchor % every:
            continue
        scored = [(i, sum(a * b for a, b in zip(q, v)), lab) for m, (i, v, lab) in enumerate(whole) if m != n]
        for p_id, p_score, _ in sorted((r for r in scored if r[2] == label), key=key)[:positives]:
            within = [r for r in scored if r[2] != label and low * p_score <= 100 * r[1] <= high * p_score]
            out += [(anchor, p_id, rank, r[0], p_score, r[1]) for rank, r in enumerate(sorted(within, key=key)[:negatives], 1)]
    return out


def found(df):
    return [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, 2, 3, 4) for i, v, label in rows], SCHEMA)


def agree(spark, rows, **options):
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    want = brute(rows, **options)
    assert sorted(found(mine(frame(spark, rows), **options)), key=order) == sorted(want, key=order)
    return len(want)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("ROWS", 64), ("LEAST", 16), ("ANCHORS", 8), ("TILE", 3), ("CHUNK", 16), ("CHUNK_AT_FIRST", 4)):
        monkeypatch.setattr(angle_negatives, name, value)


def clustered(n, d, centres, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d))
    own = rng.integers(centres, size=n)
    v = (middle[own] + spread * rng.normal(size=(n, d))) * rng.uniform(0.2, 2, size=(n, 1))
    return [(i, v[i].tolist(), int(own[i] % 4 if rng.random() < 0.7 else rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("d,centres,spread", [(3, 5, 0.2), (16, 8, 0.5), (64, 1, 5.0), (2, 2, 0.01)])
def test_equals_brute_force(spark, small_blocks, d, centres, spread):
    assert agree(spark, clustered(700, d, centres, d, spread), every=20) > 100


def test_many_anchor_groups(spark, small_blocks):
    assert agree(spark, clustered(400, 8, 6, 3), every=2) > 1000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (0, [0.1, 0.9], 2), (100, [0.0, 0.0], 1), (None, [0.5, 0.4], 1), (None, [0.5, 0.4], 3)]
    rows += [(200, None, 1), (300, [nan, 1.0], 1), (400, [1.0, None], 1), (500, [inf, 0.0], 2), (600, [], 1), (700, [1.0, 2.0, 3.0], 1), (800, [1.0, 1.0], None)]
    rows += [(i, [0.5, 0.45], 2) for i in range(1, 12)] + [(i, [0.5, 0.45], 2) for i in range(1, 4)]
    rows += [(900, [-0.3, -0.4], 4), (901, [0.3, 0.4], 4), (902, [1e300, 1.0], 4), (903, [8e6, 8e6], 4), (1000, [8e6, -7e6], 4), (-100, [0.001, -0.001], 1)]
    assert agree(spark, rows) > 20


def test_nothing_to_do(spark):
    assert found(mine(frame(spark, []))) == []
    assert found(mine(frame(spark, [(100, [1.0], 1)]))) == []
    assert found(mine(frame(spark, [(100, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2)]))) == [(100, 1, 1, 2, 0, 0)]


def test_a_third_of_all_rows_alike(spark, small_blocks):
    rows = clustered(300, 6, 4, 9) + [(i, [0.3] * 6, 2) for i in range(1000, 1150)]
    assert agree(spark, rows, every=50) > 50


def test_bounds_hold_every_score():
    rng = np.random.default_rng(4)
    for d in (2, 5, 64):
        x = np.floor(256 * np.vstack([rng.normal(size=(300, d)), np.zeros((1, d)), rng.normal(size=(40, d)) * 1e4]))
        q = np.floor(256 * (x[:50] / 256 + rng.normal(size=(50, d)) * rng.choice([0, 1e-3, 1], size=(50, 1))))
        lengths = [np.sqrt((m * m).sum(axis=1)) for m in (x, q)]
        found = references(x, 0)
        angles = [angles_to(m, n, found) for m, n in zip((x, q), lengths)]
        for some in (slice(0, 1), slice(3, 4), slice(10, 20)):
            a, n = angles[1][some], lengths[1][some]
            lower, upper = score_bounds(angles[0], lengths[0], a.min(axis=0), a.max(axis=0), n.min(), n.max())
            scores = q[some] @ x.T
            assert (scores <= upper).all() and (scores >= lower).all()


def test_clustered_vectors_are_filtered(monkeypatch):
    """On tight clusters most rows are never scored."""
    import pyarrow as pa

    rows = clustered(4000, 16, 12, 8, 0.05)
    v = np.floor(256 * np.array([r[1] for r in rows]))
    lengths = np.linalg.norm(v, axis=1)
    directions = references(v, 0)
    table = pa.table({"id": pa.array(range(4000)), "k": pa.array(range(4000)), "label": pa.array([r[2] for r in rows]), "v": pa.array(v.tolist()), "length": lengths, "angles": pa.array(angles_to(v, lengths, directions).tolist())})
    block, anchors = angle_negatives.Block(table), angle_negatives.Block(table.slice(0, 200))
    scored = []
    plain = angle_negatives.Block.scores
    monkeypatch.setattr(angle_negatives.Block, "scores", lambda self, a, tile, at: scored.append(len(tile) * len(at)) or plain(self, a, tile, at))
    tops = {i: s for i, _, s in angle_negatives.best_of(block, anchors, 5)}
    assert sum(scored) < 0.35 * 4000 * 200
    del scored[:]
    windows = [[(p, math.ceil(0.8 * x), int(x)) for p, x in enumerate(tops[i], 1)] for i in range(200)]
    list(angle_negatives.below_positives(block, anchors, windows, 5))
    assert sum(scored) < 0.7 * 4000 * 200


def test_same_with_repeated_ids_and_clashing_names(spark):
    rows = clustered(120, 4, 3, 5)
    agree(spark, [(i % 30 * 10, v, label) for i, v, label in rows])
