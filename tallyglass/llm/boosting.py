"""Gradient-boosted trees on binned features, small enough to ship to every task.

:func:`fit` takes arrays, :func:`fit_table` a DataFrame of any size: the rows stay in Spark, tasks add up gradients per node,
feature and bin, and only these sums, bounded by the bins, reach the driver, which chooses the splits.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import in_workers


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def bin_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges at quantiles, midway between neighbouring distinct values; a value equal to an edge lies below it."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    cuts = np.unique(np.quantile(values, np.arange(1, bins) / bins, method="inverted_cdf"))
    after = distinct[np.minimum(np.searchsorted(distinct, cuts, "right"), len(distinct) - 1)]
    return np.unique((cuts + after) / 2)


@dataclasses.dataclass
class Tree:
    """A full tree of fixed depth: node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        return self.walk(x, int(np.log2(len(self.value))))

    def walk(self, x: np.ndarray, level: int) -> np.ndarray:
        """The place of every row among the nodes of a level."""
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(level):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return node - (2**level - 1)


@dataclasses.dataclass
class BoostedTrees:
    base: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.value[tree.leaves(x)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0
) -> BoostedTrees:
    """Newton boosting of the logistic loss; a split needs a Hessian of ``least`` on both sides."""
    edges = [bin_edges(x[:, f], bins) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    positive = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = BoostedTrees(float(np.log(positive / (1 - positive))), [])
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = sigmoid(margin)
        tree = grow(binned, edges, p - y, np.maximum(p * (1 - p), 1e-6), depth, ridge, least)
        tree.value *= rate
        margin += tree.value[tree.leaves(x)]
        model.trees.append(tree)
    return model


def gains(left_g: np.ndarray, left_h: np.ndarray, all_g: float, all_h: float, ridge: float, least: float) -> np.ndarray:
    """What a split after each bin lowers the loss by; 0 where a side is too light."""
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    gain[(left_h < least) | (all_h - left_h < least)] = 0
    return gain


def grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> Tree:
    inner, width = 2**depth - 1, max(map(len, edges)) + 1
    feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    node = np.zeros(len(g), dtype=np.int64)
    for k in range(inner):
        rows = np.flatnonzero(node == k)
        best = (1e-9, None)
        for f, e in enumerate(edges if len(rows) else []):
            if not len(e):
                continue
            left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], width))[: len(e)]
            left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], width))[: len(e)]
            gain = gains(left_g, left_h, g[rows].sum(), h[rows].sum(), ridge, least)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], (f, at))
        right = np.zeros(len(rows), dtype=bool)
        if best[1]:
            f, at = best[1]
            feature[k], threshold[k] = f, edges[f][at]
            right = binned[rows, f] > at
        node[rows] = 2 * k + 1 + right
    leaf = node - inner
    value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
    return Tree(feature, threshold, value)


# --- tables of any size ---
#: Borders of the cells that non-negative values are put into: 32 a unit below 8, one a unit below 64, then 8 an octave.
GRID = np.concatenate([(np.arange(256) + 0.5) / 32, np.arange(8, 64) + 0.5, 64 * 2 ** (np.arange(1, 161) / 8)])
#: A value of each cell.
VALUES = np.r_[GRID, np.inf]
#: Gradients are added up as whole multiples of 1 / UNIT, so that the sums do not depend on the order of addition.
UNIT = float(1 << 20)
COUNTED = "cells binary, held boolean, n long, positives long"


def packed(rows: np.ndarray, positive: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    """Examples as counts per vector of cells, in the columns of ``COUNTED``."""
    cells = np.searchsorted(GRID, rows, "left").astype("<u2")
    keys = np.concatenate([cells, held[:, None].astype("<u2")], axis=1)
    keys, at = np.unique(keys.view(f"V{2 * keys.shape[1]}").ravel(), return_inverse=True)
    keys = [k.tobytes() for k in keys]
    columns = [pa.array([k[:-2] for k in keys], pa.binary()), pa.array([k[-2:] != b"\0\0" for k in keys], pa.bool_())]
    columns += [pa.array(np.bincount(at).astype(np.int64)), pa.array(np.bincount(at, positive).astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["cells", "held", "n", "positives"])


def matrix(batch: pa.RecordBatch, column: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype).reshape(batch.num_rows, -1)


def numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def cell_edges(counts: np.ndarray, bins: int) -> np.ndarray:
    """The last cell of every bin but the top one: as :func:`bin_edges`, of cells with counts."""
    occupied = np.flatnonzero(counts)
    cuts = occupied[:-1]
    if len(occupied) > bins:
        below = np.cumsum(counts)
        cuts = np.unique(np.searchsorted(below, np.arange(1, bins) / bins * below[-1], "left"))
        cuts = cuts[cuts < occupied[-1]]
    after = occupied[np.searchsorted(occupied, cuts, "right")]
    return (cuts + after - 1) // 2


def sums_of(rows: DataFrame, fn, key: str, *values: str) -> dict[int, list[int]]:
    """Whole numbers per key, added up over all tasks; ``fn`` bounds the keys."""
    made = in_workers(rows, fn, ", ".join([f"{key} int", *(f"{v} long" for v in values)]))
    return {r[0]: list(r[1:]) for r in made.groupBy(key).agg(*[F.sum(v).alias(v) for v in values]).collect()}


def fit_table(
    counted: DataFrame, width: int, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0
) -> BoostedTrees | None:
    """:func:`fit` on the rows of ``counted`` (columns of ``COUNTED``, read several times) that are not held out; None without any.

    Every row counts. Edges of bins are quantiles up to the cells of ``GRID``. Rows equal after binning are one row with a count;
    each level of each tree is one pass over those. The driver gets the counts of ``width`` features' cells and bins.
    """
    used = counted.filter(~F.col("held"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * len(VALUES) + 2)
        for batch in batches:
            x, n = matrix(batch, "cells", "<u2"), numbers(batch, "n")
            for f in range(width):
                total[f * len(VALUES) : (f + 1) * len(VALUES)] += np.bincount(x[:, f], n, len(VALUES))
            total[-2:] += [n.sum(), numbers(batch, "positives").sum()]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], ["cell", "n"])

    found = sums_of(used, cells, "cell", "n")
    total = np.array([found.get(i, [0])[0] for i in range(width * len(VALUES) + 2)])
    if not total[-2]:
        return None
    edges = [cell_edges(total[f * len(VALUES) : (f + 1) * len(VALUES)], bins) for f in range(width)]

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, "cells", "<u2")
            binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)
            keys = pa.array([row.tobytes() for row in binned], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, batch.column("n"), batch.column("positives")], ["bins", "n", "positives"])

    binned = in_workers(used, to_bins, "bins binary, n long, positives long").groupBy("bins")
    binned = binned.agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    binned = binned.coalesce(min(64, counted.sparkSession.sparkContext.defaultParallelism))  # many passes over few rows

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = [matrix(batch, "bins", "u1"), numbers(batch, "n"), numbers(batch, "positives")]
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()]) for part in block], ["bins", "n", "positives"])

    # an RDD, as every level of every tree is a job of its own, and those of data frames take several times as long to plan
    blocks = in_workers(binned, to_blocks, "bins binary, n binary, positives binary").rdd
    blocks = blocks.map(lambda b: (*b, 0.0)).persist(StorageLevel.MEMORY_AND_DISK)
    positive = np.clip(total[-1] / total[-2], 1e-3, 1 - 1e-3)
    model = BoostedTrees(float(np.rint(np.log(positive / (1 - positive)) * UNIT) / UNIT), [])  # thresholds are bins until the end
    recent, old = BoostedTrees(model.base, []), None  # the trees that are not in the margins of the blocks
    for i in range(trees):
        tree = grow_table(blocks, recent, edges, depth, ridge, least, bins)
        # multiples of 1 / UNIT, so that a margin is the same in whatever order it is added up
        tree.value = np.rint(tree.value * rate * UNIT) / UNIT
        model.trees.append(tree)
        recent.trees.append(tree)
        if old:
            old.unpersist()
            old = None
        if i % 10 == 9:
            old, blocks = blocks, blocks.map(lambda b, recent=recent: (*b[:3], b[3] + recent.margin(unpacked(b)[0]))).persist(StorageLevel.MEMORY_AND_DISK)
            recent = BoostedTrees(0.0, [])
    if old:
        old.unpersist()
    blocks.unpersist()
    for tree in model.trees:
        tree.threshold = np.array([GRID[edges[f][int(t)]] if np.isfinite(t) else np.inf for f, t in zip(tree.feature, tree.threshold)])
    return model


def unpacked(block: tuple[bytes, bytes, bytes, np.ndarray | float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, n, positives) of a block."""
    n, positives = (np.frombuffer(b, np.int64) for b in block[1:3])
    return np.frombuffer(block[0], np.uint8).reshape(len(n), -1), n, positives


def grow_table(blocks: RDD, model: BoostedTrees, edges: list[np.ndarray], depth: int, ridge: float, least: float, bins: int) -> Tree:
    """The next tree, level by level; its thresholds are bins. ``model`` adds to the margins of the blocks."""
    inner, width = 2**depth - 1, len(edges)
    tree = Tree(np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(inner + 1))
    for level in range(depth):
        nodes = 2**level

        def gradients(part: Iterator[tuple], level=level, nodes=nodes) -> Iterator[np.ndarray]:
            sums = np.zeros((2, nodes * width * bins))
            for block in part:
                x, n, positives = unpacked(block)
                p = sigmoid(block[3] + model.margin(x))
                g = np.rint((n * p - positives) * UNIT)
                h = np.rint(n * np.maximum(p * (1 - p), 1e-6) * UNIT)
                at = tree.walk(x, level) * width * bins
                for f in range(width):
                    sums += [np.bincount(at + f * bins + x[:, f], w, sums.shape[1]) for w in (g, h)]
            yield sums

        sums = blocks.mapPartitions(gradients).reduce(np.add) / UNIT  # at most 64 partitions of bounded sums
        for k, (g, h) in enumerate(sums.reshape(2, nodes, width, bins).swapaxes(0, 1)):
            all_g, all_h = g[0].sum(), h[0].sum()
            best, left = 1e-9, (all_g, all_h)
            for f, e in enumerate(edges if all_h else []):
                left_g, left_h = np.cumsum(g[f])[: len(e)], np.cumsum(h[f])[: len(e)]
                gain = gains(left_g, left_h, all_g, all_h, ridge, least)
                if len(e) and gain.max() > best:
                    at = int(np.argmax(gain))
                    best, left = gain[at], (left_g[at], left_h[at])
                    tree.feature[nodes - 1 + k], tree.threshold[nodes - 1 + k] = f, at
            if level == depth - 1:
                tree.value[2 * k : 2 * k + 2] = -left[0] / (left[1] + ridge), -(all_g - left[0]) / (all_h - left[1] + ridge)
    return tree
