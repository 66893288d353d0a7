"""Poisson replication against its definition."""

import hashlib
import math
from collections import Counter

import pytest
from oracle import compare

from tallyglass.llm import mixing


def drawn(key, rate, seed=0):
    parts = math.ceil(rate / mixing.LARGEST_PART)
    total = 0
    for j in range(1, parts + 1):
        u = (int(hashlib.md5(f"{seed}:{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rate / parts)
        c = p
        while c < u and k < mixing.TERMS:
            k += 1
            p *= rate / parts / k
            c += p
        total += k
    return total


def test_equals_sql(spark, duck, table):
    assert compare(mixing.mix(table("documents")), duck, mixing.SQL) is None


def test_counts_follow_the_definition(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS source", "'x' AS copy_no", "1 AS u")
    got = mixing.mix(docs, {"a": 30.0, None: 1.0}, total=31_000, seed=7)
    assert got.columns == ["doc_id", "source", "u", "copy_no", "shuffle_key"]
    rows = got.collect()
    counts = Counter(r.doc_id for r in rows)
    for i in range(3000):
        assert counts[i] == (drawn(i, 30.0, 7) if i % 3 == 0 else drawn(i, 1.0, 7) if i % 3 == 2 else 0)
    assert abs(sum(counts.values()) - 31_000) < 1000
    assert sorted(r.copy_no for r in rows if r.doc_id == 0) == list(range(1, counts[0] + 1))


def test_the_order_is_mixed_and_repeats(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "IF(id < 1000, 'a', 'b') AS source")
    first, second = [[(r.doc_id, r.copy_no) for r in mixing.mix(docs).collect()] for _ in range(2)]
    assert first == second
    half = [i for i, _ in first][: len(first) // 2]
    assert 0.4 < sum(i < 1000 for i in half) / len(half) < 0.6


def test_edges(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(None, None, None), (5, None, ""), (5, None, "")], schema), total=300).collect()
    counts = Counter(r.doc_id for r in rows)
    assert counts[5] == 2 * drawn("5", 100.0) and counts[None] == drawn("", 100.0)
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([], schema), {"a": 0.0})


def test_many_sources_are_joined_without_broadcast(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id AS doc_id", "CAST(id % 7 AS string) AS source")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want
