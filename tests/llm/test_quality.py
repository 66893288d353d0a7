"""Held-out accuracy, the additive form, edges."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyglass.llm import quality as q

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, predicted string"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = q.train(docs, labels)
    assert model.pairs
    got = q.score(docs, model)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert q.keep(docs, model).count() == got.agg(F.sum("predicted")).first()[0]


def test_held_out_labels_and_other_columns_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    changed = labels.withColumn("quality", F.when(q.fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = q.train(docs, labels, sample=150), q.train(docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit("y")), changed, sample=150)
    assert all(np.array_equal(s, t) for s, t in zip(a.tables, b.tables))


def test_an_interaction_is_found():
    r = np.random.default_rng(0)
    x = r.uniform(size=(4000, len(q.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.4)).astype(float)
    model = q.fit(x[:3000], y[:3000], rounds=20)
    assert model.pairs[0] == (2, 7)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_scores_are_sums_of_looked_up_numbers():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, len(q.FEATURES)))
    model = q.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), rounds=10, pair_rounds=10)
    for row, margin in zip(x[:50], model.margin(x[:50])):
        total = model.intercept + sum(t[sum(v > e)] for v, e, t in zip(row, model.edges, model.tables))
        total += sum(t[sum(row[i] > a), sum(row[j] > b)] for (i, j), (a, b), t in zip(model.pairs, model.pair_edges, model.pair_tables))
        assert abs(total - margin) < 1e-9


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    rows = [(None, "a b", "", ""), (1, None, "", ""), (2, "", "", ""), (3, "word " * 200_000, "", ""), (4, " \n ", "", ""), (4, " \n ", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = q.train(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"))
    got = q.score(docs, none)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert sorted((r.doc_id or 0, r.predicted) for r in got.collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 1)]
    assert q.keep(docs, none).collect() == docs.collect()
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    assert q.score(docs, q.train(docs, labels)).count() == 6
    empty = spark.createDataFrame([], SCHEMA)
    assert q.score(empty, q.train(empty, labels)).count() == 0
