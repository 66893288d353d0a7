"""Signatures against probability Jaccard, classes against brute force, hubs and chains of components."""

import itertools
import random

import numpy as np
import pytest

from tallyglass.llm import near_copies as nc
from tallyglass.llm.components import components

SCHEMA = "doc_id long, text string, node string, class_id string, signature string"


def brute_jaccard(a, b):
    a, b = (dict(zip(x[0].tolist(), x[1].tolist())) for x in (a, b))
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in set(a) & set(b))


def brute_classes(rows, threshold=0.8):
    """Smallest id of the class of every text."""
    texts = sorted({t or "" for _, t in rows})
    bags = {t: nc.shingles(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        if len(bags[a][0]) and len(bags[b][0]) and set(bags[a][0].tolist()) & set(bags[b][0].tolist()):
            if nc.probability_jaccard(bags[a], bags[b]) >= threshold:
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None:
            key = find(t or "")
            least[key] = min(i, least.get(key, i))
    return {(i, t): least.get(find(t or "")) for i, t in rows}


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def altered(r, base, n):
    out = list(base)
    for k in r.sample(range(len(out)), n):
        out[k] = words(r, 1)[0]
    return out


def test_shingles_are_counted():
    h, n = nc.shingles("A b c d e f a B c d e f")
    assert sorted(n.tolist()) == [1, 1, 1, 1, 2, 2] and np.all(np.diff(h.astype(object)) > 0)
    assert len(nc.shingles("one two")[0]) == 1 and len(nc.shingles(" \n ")[0]) == 0
    assert nc.shingles("one two")[0] != nc.shingles("two one")[0]


def test_probability_jaccard_equals_its_definition():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = ((np.unique(r.integers(0, 30, 20).astype(np.uint64)),) for _ in range(2))
        a, b = ((*x, r.integers(1, 5, len(x[0]))) for x in (a, b))
        assert nc.probability_jaccard(a, b) == pytest.approx(brute_jaccard(a, b))


def test_many_similarities_at_once():
    r = np.random.default_rng(5)
    for _ in range(40):
        bags = [(h, r.integers(1, 1 + r.integers(1, 4), len(h))) for h in (np.unique(r.integers(0, 25, 22).astype(np.uint64)) for _ in range(9))]
        exact = [nc.probability_jaccard(bags[0], b) for b in bags[1:]]
        for found, want in zip(nc.similarities(bags[0], bags[1:], 0.6), exact):
            assert found == pytest.approx(want) or (found == 0 and want < 0.6)


def test_registers_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        a = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
        b = np.unique(np.r_[a[r.random(len(a)) < 0.9], r.integers(0, 2**63, 30).astype(np.uint64)])
        bags = (a, r.integers(1, 4, len(a))), (b, r.integers(1, 4, len(b)))
        x, y = nc.signatures(list(bags))
        errors.append((x == y).mean() - nc.probability_jaccard(*bags))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_signatures_do_not_depend_on_the_batch():
    r = random.Random(2)
    bags = [nc.shingles(" ".join(words(r, n))) for n in (1, 5, 6, 50, 3000, 0)]
    together = nc.signatures(bags)
    assert all(np.array_equal(together[i], nc.signatures([b])[0]) for i, b in enumerate(bags))


def corpus():
    r = random.Random(3)
    rows, base = [], words(r, 200)
    rows += [(i, " ".join(altered(r, base, 3))) for i in range(60)]  # many near copies of one text
    chain = words(r, 200)
    for i in range(100, 112):  # each like the one before, the ends unlike
        rows.append((i, " ".join(chain)))
        chain = altered(r, chain, 3)
    rows += [(200 + i, " ".join(words(r, 80))) for i in range(30)]
    passage = words(r, 60)
    rows += [(300 + i, " ".join(words(r, 60) + passage)) for i in range(20)]  # share half of their text only
    rows += [(400 + i, rows[i][1]) for i in range(30)]  # exact copies
    return rows


def test_classes_equal_brute_force(spark, table, monkeypatch):
    monkeypatch.setattr(nc, "BLOCK", 20)
    rows = corpus() + [(1000 + r.doc_id, r.text) for r in table("documents").collect()]
    got = nc.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes(rows)
    texts = dict(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == {i: want[i, t] for i, t in texts.items()}
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_one_row_of_each_class_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    kept = nc.keep_first(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes(rows).values()))


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    long = " ".join(words(random.Random(4), 30_000))
    rows = [(None, "a b"), (1, None), (2, ""), (3, long), (4, long + " tail"), (5, "a b"), (5, "a b"), (6, "A  B"), (None, "alone"), (7, " ")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.class_id, r.kept) for r in nc.find(docs).collect() if r.class_id is not None)
    assert got == [(0, 5, False), (1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (5, 5, True), (5, 5, True), (6, 5, False), (7, 7, True)]
    kept = sorted((r.doc_id or 0, r.text) for r in nc.keep_first(docs).collect())
    assert kept == [(0, "alone"), (1, None), (3, long), (5, "a b"), (7, " ")]
    empty = spark.createDataFrame([], SCHEMA)
    assert nc.find(empty).count() == 0 and nc.keep_first(empty).count() == 0


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(400, 480)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in links for x in (a, b) if a != b and x != find(x)}
    assert {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


@pytest.mark.parametrize("ids", ["distinct", "null", "same"])
def test_null_and_repeated_ids_stay_linear(spark, monkeypatch, ids):
    """Every text that is compared is read once, whatever the ids."""
    read = []
    plain = nc.in_workers

    def counted(df, fn, schema):
        if schema.startswith("node binary, h binary"):
            read.append(df.count())
        return plain(df, fn, schema)

    monkeypatch.setattr(nc, "in_workers", counted)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(120):
        text = " ".join([*words, f"tail{i % 60}"])
        rows.append(({"distinct": i, "null": None, "same": 5}[ids], text))
    out = nc.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 120 and len({r.class_id for r in out}) == 1
    assert 0 < sum(read) <= 3 * 60
