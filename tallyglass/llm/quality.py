"""A quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one feature at a time, so their sum is a lookup table per feature; the strongest
interactions get tables of two features the same way. A score is then the sum of a few looked-up numbers, taken for a
whole batch of texts at once.
"""

from __future__ import annotations

import dataclasses
import itertools
import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, in_workers, pick, pieces
from .boosting import bin_edges, sigmoid

FEATURES = (
    "log_words word_length distinct_words top_word repeated_neighbours log_words_per_line distinct_lines upper lower digits"
    " blanks stops marks symbols capital_words all_capital_words end_marks marked_words long_words"
).split()
#: Classes of bytes; bytes of characters outside ASCII count as lower-case letters, which most of them are.
CLASSES = np.zeros(256, dtype=np.int64)
for _class, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n\v\f", b".,;:", b"!?", b"\"'()-")):
    CLASSES[list(_bytes)] = _class + 1
CLASSES[128:] = 2


def features(text: str) -> list[float]:
    """Shape of the whole text, without any word of its own; an empty text is all zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, lines = len(words), [line for line in text.split("\n") if line]
    counts = Counter(words)
    raw = text.encode()
    kinds = np.bincount(CLASSES, np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256), 8) / len(raw)
    ends = Counter(map(operator.itemgetter(-1), words))
    heads = Counter(map(operator.itemgetter(0), words))
    marked = sum(k for c, k in ends.items() if not c.isalnum() and c not in ".,;:?\"')")
    return [
        np.log1p(n), sum(map(len, words)) / n, len(counts) / n, max(counts.values()) / n,
        sum(map(operator.eq, words, itertools.islice(words, 1, None))) / n,
        np.log1p(n / len(lines)), len(set(lines)) / len(lines),
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[0],
        sum(k for c, k in heads.items() if c.isupper()) / n, sum(map(str.isupper, words)) / n,
        sum(k for c, k in ends.items() if c in ".?!") / n, marked / n, sum(len(w) > 12 for w in words) / n,
    ]


@dataclasses.dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[tuple[np.ndarray, np.ndarray]]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, f], "left")]
        for (i, j), (a, b), table in zip(self.pairs, self.pair_edges, self.pair_tables):
            out += table[np.searchsorted(a, x[:, i], "left"), np.searchsorted(b, x[:, j], "left")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and position of the best cut of a run of bins; position k cuts after bin k."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, -1
    gains = gain(left_g, left_h) + gain(g.sum() - left_g, h.sum() - left_h) - gain(g.sum(), h.sum())
    gains[(left_h < least) | (h.sum() - left_h < least)] = 0.0
    at = int(np.argmax(gains))
    return float(gains[at]), at


def shallow_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Values by bin of a tree of at most three leaves."""
    value = np.zeros(len(g))
    bounds = [0, len(g)]
    for _ in range(2):
        found = [(*best_cut(g[a:b], h[a:b], least), a) for a, b in itertools.pairwise(bounds)]
        best, at, start = max(found)
        if best <= 0:
            break
        bounds = sorted([*bounds, start + at + 1])
    for a, b in itertools.pairwise(bounds):
        value[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1.0)
    return value


def quadrants(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts a grid once in each direction."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    parts = []
    for c in (cg, ch):
        low = c[:-1, :-1]
        row, col = c[:-1, -1:] - low, c[-1:, :-1] - low
        parts.append((low, row, col, c[-1, -1] - low - row - col))
    gains = sum(gain(a, b) for a, b in zip(*parts)) - gain(cg[-1, -1], ch[-1, -1])
    gains[np.minimum.reduce(parts[1]) < least] = 0.0
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    if gains[i, j] <= 0:
        return 0.0, np.zeros(g.shape)
    low, row, col, rest = (-a[i, j] / (b[i, j] + 1.0) for a, b in zip(*parts))
    upper = np.where(np.arange(g.shape[1]) <= j, low, row)
    lower = np.where(np.arange(g.shape[1]) <= j, col, rest)
    return float(gains[i, j]), np.where(np.arange(g.shape[0])[:, None] <= i, upper, lower)


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.1, pairs: int = 6, pair_bins: int = 12, pair_rounds: int = 60, least: float = 2.0, pair_least: float = 0.05
) -> AdditiveModel:
    """Cyclic boosting of the logistic loss, first of single features, then of the ``pairs`` strongest interactions.

    A leaf needs a Hessian of ``least``, or ``pair_least`` in the tables of pairs, which see what single features leave.
    Without any rows every text scores 1: nothing is known against it.
    """
    width = x.shape[1]
    edges = [bin_edges(x[:, f], bins) if len(x) else np.zeros(0) for f in range(width)]
    if not len(y):
        return AdditiveModel(40.0, edges, [np.zeros(1) for _ in edges], [], [], [])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], [], [])
    binned = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(margin)
        return p - y, np.maximum(p * (1 - p), 1e-9)

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            size = len(edges[f]) + 1
            step = rate * shallow_tree(np.bincount(binned[f], g, size), np.bincount(binned[f], h, size), least)
            model.tables[f] += step
            margin += step[binned[f]]

    coarse_edges = [bin_edges(x[:, f], pair_bins) for f in range(width)]
    coarse = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(coarse_edges)]

    def grid(i: int, j: int, weights: np.ndarray) -> np.ndarray:
        shape = len(coarse_edges[i]) + 1, len(coarse_edges[j]) + 1
        return np.bincount(coarse[i] * shape[1] + coarse[j], weights, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    strength = {(i, j): quadrants(grid(i, j, g), grid(i, j, h), pair_least)[0] for i, j in itertools.combinations(range(width), 2)}
    model.pairs = [p for p in sorted(strength, key=lambda p: (-strength[p], p))[:pairs] if strength[p] > 0]
    model.pair_edges = [(coarse_edges[i], coarse_edges[j]) for i, j in model.pairs]
    model.pair_tables = [np.zeros((len(a) + 1, len(b) + 1)) for a, b in model.pair_edges]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * quadrants(grid(i, j, g), grid(i, j, h), pair_least)[1]
            model.pair_tables[k] += step
            margin += step[coarse[i], coarse[j]]
    return model


def fold(id_: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 4, held_out: int = 2, sample: int = 20_000, seed: int = 0,
) -> AdditiveModel:
    """Fit on labelled documents outside the held-out fold: all of them, or the first ``sample`` by hash of their ids.

    Rows with a null id or label are no examples. An id with several labels has their majority (1 in a draw).
    """
    marks = pick(labels, id=id_col, y=label_col).filter("id IS NOT NULL AND y IS NOT NULL").filter(fold(F.col("id"), folds) != held_out)
    marks = marks.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    marks = marks.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(marks), "id")  # at most `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [list(map(float, features(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    found = in_workers(rows.select("text", "y"), run, "x array<double>, y double").limit(2 * sample).toPandas()
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y = found["y"].to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    return fit(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, least: float = 0.7) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score`` from 0 to 1, ``predicted`` (1 from ``least`` on).

    A null text is an empty one. Null ids stay null and count as empty texts for the fold. Other columns are not carried along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole)):
            x = np.array([features(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], ["id", "score"])

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return in_workers(rows, run, f"id {kind}, score double").select(
        F.col("id").alias(id_col), (fold(F.col("id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, model: AdditiveModel, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``least``; a null text is an empty one."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, at)):
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= least))

    return in_workers(docs, run, docs.schema)
