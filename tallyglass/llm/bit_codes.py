"""Near-duplicate vectors by binary codes of randomly rotated vectors (after RaBitQ, Gao and Long, 2024).

A unit vector o, rotated at random, is coded by the signs of its components; s is the unit vector of those signs. The
stored factor f = <s, o> corrects the code: <s, q> / f is an unbiased estimate of <o, q> for any unit q. Its deviation
is sqrt(1 - <o, q>^2) sqrt(1 - f^2) / f times a component of a random unit vector, so its bounds are known. Only pairs
whose bounds reach the threshold are computed exactly.

Pairs to look at share a bucket: some bits of the code in one of several tables, as many as keep buckets small, in as
many tables as the wanted recall at the threshold takes. Large buckets are cut into blocks and blocks are compared
pairwise; a pair is counted in the first table in which it shares a bucket, and tasks hand on counts and spanning links
only, never lists of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .base import in_workers, materialize
from .components import components
from .vectors import as_lists, matrix, rotation, usable

#: Vectors a bucket holds on average, and at most in one block.
BUCKET, BLOCK = 256, 1024
#: Deviations allowed for before a pair is dropped unseen: a link is missed so with a probability of 3e-6.
DEVIATIONS = 4.5


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a bucket and tables. At the threshold, a bit agrees with probability 1 - angle / pi."""
    bits = max(2, round(math.log2(max(1, n) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def codes(unit: np.ndarray, rotations: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Signs (rows by all bits) of every rotation, and the factor of the first."""
    turned = [unit @ r for r in rotations]
    factor = np.abs(turned[0]).sum(axis=1) / math.sqrt(unit.shape[1])
    return np.concatenate(turned, axis=1) > 0, factor


def bucket_of(signs: np.ndarray, table: int, bits: int) -> np.ndarray:
    own = signs[:, table * bits : (table + 1) * bits]
    return np.packbits(own, axis=1) @ (1 << 8 * np.arange((bits + 7) // 8, dtype=np.int64))


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position each of n positions is linked with, over any number of links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def links_in(group: pa.Table, threshold: float, bits: int, size: int, turn: np.ndarray) -> pa.Table:
    """Per vector of two blocks (or of one): the weight of its links found here first, and a spanning link."""
    table, i, j = (group.column(c)[0].as_py() for c in ("table", "i", "j"))
    g, node, copies = (group.column(c).to_numpy() for c in ("g", "node", "copies"))
    unit = matrix(group.column("unit"))
    signs = np.unpackbits(np.frombuffer(b"".join(group.column("signs").to_pylist()), np.uint8).reshape(len(g), -1), axis=1)[:, :size].astype(bool)
    factor = group.column("factor").to_numpy()
    left, right = np.flatnonzero(g == i), np.flatnonzero(g == j)
    d = unit.shape[1]
    estimate = (np.where(signs[left, :d], 1.0, -1.0) @ (unit[right] @ turn).T) / math.sqrt(d) / factor[left, None]
    spread = math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, d - 1))
    x, y = np.nonzero(estimate >= threshold - DEVIATIONS * spread[left, None] - 1e-9)
    x, y = left[x], right[y]
    once = node[x] < node[y] if i == j else np.ones(len(x), bool)
    x, y = x[once], y[once]
    exact = np.concatenate([np.einsum("kd,kd->k", unit[x[k : k + 65536]], unit[y[k : k + 65536]]) for k in range(0, len(x), 65536)] or [np.zeros(0)])
    x, y = x[exact >= threshold], y[exact >= threshold]
    for earlier in range(table):
        apart = bucket_of(signs[x], earlier, bits) != bucket_of(signs[y], earlier, bits)
        x, y = x[apart], y[apart]
    links = np.bincount(x, copies[y], len(g)) + np.bincount(y, copies[x], len(g))
    order = np.argsort(node)  # spanning links lead to the smallest node
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    root = node[order][spanning(len(g), rank[x], rank[y])][rank]
    linked = links > 0
    return pa.table({"node": pa.array(node[linked]), "links": pa.array(links[linked].astype(np.int64)), "root": pa.array(root[linked])})


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.995, seed: int = 0
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Vectors are linked if their cosine, in doubles, is at least ``threshold`` (above 0); a link right at the threshold is
    looked at with probability ``recall``, closer ones more surely, and what is looked at is decided exactly. ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest id that links lead to, ``kept`` tells whether
    that is the row's own. Vectors that take no part (see ``usable``) have no links and are their own component. Equal
    vectors are linked with each other, also those of rows with the same id; a null id never names a component, and a row
    with one is not kept. Other columns are not carried along.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    every = usable(rows, id_col, vector_col).withColumn("hash", F.when(F.col("v").isNotNull(), F.md5(F.array_join("v", ","))))
    distinct = every.filter("v IS NOT NULL").groupBy("hash").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = materialize(distinct.withColumn("node", F.xxhash64("hash", F.lit(seed))), "nodes")
    n, d = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    bits, tables = plan(n, threshold, recall)
    size = bits * tables
    ship_package(rows.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = [rotation(d, seed + k) for k in range(-(-size // d))]
        for batch in (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000)):
            v = matrix(batch.column("v"))
            v = v / np.abs(v).max(axis=1, keepdims=True)  # lest squares overflow or vanish
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            signs, factor = codes(unit, turns)
            raw = np.packbits(signs, axis=1)
            fixed = [batch.column("node"), batch.column("copies"), as_lists(unit), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(factor)]
            for table in range(tables):
                own = [pa.array(np.full(len(v), table, np.int32)), pa.array(bucket_of(signs, table, bits), pa.int64())]
                yield pa.RecordBatch.from_arrays(own + fixed, ["table", "bucket", "node", "copies", "unit", "signs", "factor"])

    kinds = "table int, bucket long, node long, copies long, unit array<double>, signs binary, factor double"
    if n:
        in_tables = materialize(nodes.select("node", "copies", "v").mapInArrow(coded, kinds), "codes")
        sizes = materialize(in_tables.groupBy("table", "bucket").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        cut = in_tables.join(sizes, ["table", "bucket"]).withColumn("g", F.pmod(F.col("node"), blocks).cast("int"))
        cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"i": F.least("g", "o"), "j": F.greatest("g", "o")})
        width, turn = -(-size // d) * d, rotation(d, seed)
        found = cut.drop("o", "m").groupBy("table", "bucket", "i", "j").applyInArrow(
            lambda t: links_in(t, threshold, bits, width, turn), "node long, links long, root long"
        )
        found = materialize(found, "found")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.select("node", "root"), "node", "root").withColumnRenamed("id", "node")
        known = nodes.select("hash", "node", "id", "copies").join(links, "node", "left").join(roots, "node", "left")
        known = materialize(known.withColumn("root", F.coalesce("root", "node")), "known")
        least = materialize(known.groupBy("root").agg(F.min("id").alias("component_id")), "least")
        known = known.join(least, "root").select("hash", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    else:
        known = nodes.select("hash", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = every.select("id", "hash").join(materialize(known, "known"), "hash", "left")
    component = F.when(F.col("hash").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


#: What :func:`near_vectors` gives for ``embeddings`` if no link is missed, for DuckDB.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
    AND list_sum(list_transform(embedding, lambda x: abs(x)::DOUBLE)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.a = c.id) AS n_links, component_id, id = component_id AS kept FROM c
"""
