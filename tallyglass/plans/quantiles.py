"""Exact quantiles, and what depends on them, without sorting or gathering a column.

``summarize`` reads the columns twice, in Arrow batches. The first scan takes moments and a mergeable quantile sketch per
column; the sketch is never trusted with an answer, it gives an interval of values around every wanted order statistic
and fence. The second scan counts the values of these segments in cells and those between them as a whole, each cell
with its own minimum and maximum: ranks and counts at a fence are exact wherever a cell has one value. Where one has not, or
where the sketch was off, the cell is the segment of a further scan, 2048 times narrower; no scan returns more than a
bounded number of cells. Infinite values are counted apart, so that every segment has a finite width; NaN counts as missing.

``grouped_quantiles`` finds order statistics per group from (group, value) counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .joins import salted_join
from .positions import ROWS_PER_TASK, split_by_order

BINS = 2048
# Wider tables are searched some columns at a time; every column is still read only by its own passes.
COLUMNS_PER_PASS = 40
#: Values in a buffer of a task's sketch, points a task hands on per column, and about four times the standard error of the
#: ranks read from them. A wrong bound costs a scan, not the result.
BUFFER, POINTS = 4096, 2048
RANK_ERROR = 0.0015
#: Groups in which the tasks' points are merged first.
SLOTS = 32


@dataclass(eq=False)
class _Segment:
    """Values from ``low`` to ``high``: about ``inside`` rows, counted in cells or value by value."""

    low: float
    high: float
    inside: float


@dataclass(eq=False)
class _Search:
    """What is wanted of a column and known about it. Ranks count its finite values from 0."""

    probabilities: list[float]
    fences: list[float]
    start: Mapping

    def __post_init__(self):
        self.n, self.low, self.high, self.minus, self.plus = (self.start[k] for k in ("n", "low", "high", "minus", "plus"))
        self.finite = self.n - self.minus - self.plus
        wanted = [*self.probabilities, *((0.25, 0.75) if self.fences else ())]
        ranks = {k - self.minus for p in wanted for k in _ranks(p, self.n)} if self.n else set()
        self.known: dict[int, float] = {k: -math.inf if k < 0 else math.inf for k in ranks if not 0 <= k < self.finite}
        self.bounds: dict[int, tuple[float, float]] = {}
        self.inside: dict[int, float] = {}
        for k in ranks - self.known.keys():
            if k == 0 or self.low == self.high:
                self.known[k] = self.low
            elif k == self.finite - 1:
                self.known[k] = self.high
            else:
                p = (k + 0.5) / self.finite
                self.bounds[k] = (self.read(p - RANK_ERROR, False), self.read(p + RANK_ERROR, True))
                self.inside[k] = 3 * RANK_ERROR * self.finite
        self.outside: list[list[int | None]] = [[None, None] for _ in self.fences]
        self.limits = [[(self.low, self.high)] * 2 for _ in self.fences]
        self.place_fences()

    def read(self, p: float, above: bool) -> float:
        """The nearest value on the outer side of rank ``p`` that was read from the sketch, else the end of the values."""
        pairs = zip(self.start["ranks"], self.start["points"] or ())
        outer = [v for r, v in pairs if (r >= p if above else r <= p)]
        value = (self.high if above else self.low) if not outer else outer[0] if above else outer[-1]
        return min(max(value, self.low), self.high)

    def quantile(self, p: float) -> float | None:
        if not self.n:
            return None
        return _interpolate(p, self.n, lambda k: self.known[k - self.minus])

    def range_of(self, p: float) -> tuple[float, float]:
        """Bounds of a quantile from what is known so far."""
        ranks = [k - self.minus for k in _ranks(p, self.n)]
        if all(k in self.known for k in ranks):
            value = self.quantile(p)
            return (math.nan, math.nan) if value is None else (value, value)
        ends = [(self.known[k],) * 2 if k in self.known else self.bounds[k] for k in ranks]
        return min(e[0] for e in ends), max(e[1] for e in ends)

    def place_fences(self) -> None:
        """Bounds of the fences; those beyond all values, or not finite, are settled."""
        if not self.fences or not self.n:
            self.outside = [[0, 0] for _ in self.fences]
            return
        (a, b), (c, d) = self.range_of(0.25), self.range_of(0.75)
        exact = self.ranks_known
        for i, k in enumerate(self.fences):
            below = (a - k * (c - a),) * 2 if exact else _widened(a * (1 + k) - k * d, b * (1 + k) - k * c)
            above = (c + k * (c - a),) * 2 if exact else _widened(c * (1 + k) - k * b, d * (1 + k) - k * a)
            for side, (low, high) in enumerate((below, above)):
                if self.outside[i][side] is not None:
                    continue
                if exact and not math.isfinite(low):
                    self.outside[i][side] = 0
                    continue
                low, high = (self.low if not math.isfinite(low) else low), (self.high if not math.isfinite(high) else high)
                past = self.minus if side == 0 else self.plus
                if not self.finite or (high <= self.low if side == 0 else low >= self.high):
                    self.outside[i][side] = past
                elif low > self.high if side == 0 else high < self.low:
                    self.outside[i][side] = past + self.finite
                self.limits[i][side] = (low, high)

    def segments(self) -> list[_Segment]:
        """Disjoint segments in order that hold all that is open."""
        spans = [(*self.bounds[k], self.inside[k]) for k in self.bounds if k not in self.known]
        wide = 12 * RANK_ERROR * self.finite
        for limits, outside in zip(self.limits, self.outside):
            spans += [(max(low, self.low), min(high, self.high), wide) for (low, high), done in zip(limits, outside) if done is None]
        # cut at every end, so that what is known best of a stretch decides how finely it is counted and bounds only tighten
        ends = sorted({e for low, high, _ in spans for e in (low, high)})
        points = {low for low, high, _ in spans if low == high}
        cut = [_Segment(ends[0], ends[0], 0)] if ends and ends[0] in points else []
        for low, high in zip(ends, ends[1:]):
            held = [inside for a, b, inside in spans if a <= low and high <= b and a < b]
            cut += [_Segment(low, high, min(held))] if held else []
            cut += [_Segment(high, high, 0)] if high in points and not held else []
        return cut

    def learn(self, cells: pd.DataFrame) -> None:
        """Take the cells of a scan, in order of value."""
        n, low, high = (cells[c].to_numpy() for c in ("n", "low", "high"))
        upto = n.cumsum()
        for k in [k for k in self.bounds if k not in self.known]:
            at = int(np.searchsorted(upto, k, side="right"))
            self.bounds[k], self.inside[k] = (float(low[at]), float(high[at])), int(n[at])
            if low[at] == high[at] or k == upto[at] - n[at]:
                self.known[k] = float(low[at])
            elif k == upto[at] - 1:
                self.known[k] = float(high[at])
        self.place_fences()
        exact = self.ranks_known
        for i, sides in enumerate(self.limits):
            for side, (t, _) in enumerate(sides):
                if not exact or self.outside[i][side] is not None:
                    continue
                split = (low < t) & (high >= t) if side == 0 else (low <= t) & (high > t)
                sure = int(n[high < t].sum()) + self.minus if side == 0 else int(n[low > t].sum()) + self.plus
                at = np.flatnonzero(split)
                if not len(at):
                    self.outside[i][side] = sure
                elif n[at[0]] == 2:
                    self.outside[i][side] = sure + 1
                else:
                    self.limits[i][side] = (t, t)

    @property
    def ranks_known(self) -> bool:
        return all(k in self.known for k in self.bounds)

    @property
    def open(self) -> bool:
        return not self.ranks_known or any(o is None for both in self.outside for o in both)


def _widened(low: float, high: float) -> tuple[float, float]:
    slack = 1e-9 * max(abs(low), abs(high)) if math.isfinite(low) and math.isfinite(high) else 0.0
    return low - slack, high + slack


def _ranks(p: float, n: int) -> tuple[int, int]:
    at = p * (n - 1)
    return math.floor(at), math.ceil(at)


def _interpolate(p: float, n: int, value: Callable[[int], float]) -> float | None:
    low, high = _ranks(p, n)
    a, b, part = value(low), value(high), p * (n - 1) - low
    if a == b or not part:
        return a
    if math.isinf(a) or math.isinf(b):
        return None if math.isinf(a) and math.isinf(b) else a if math.isinf(a) else b
    return a + (b - a) * part


@dataclass
class ColumnSummary:
    """Values that are neither null nor NaN, quantiles in the order asked for, values outside the fence of each factor, and
    min, max, mean, std, sum, skew and kurt, the last two corrected for bias."""

    n: int
    quantiles: list[float | None]
    outside: list[int]
    moments: dict[str, float | None]


def exact_quantiles(
    df: DataFrame, probabilities: Mapping[str, Sequence[float]], bins: int = BINS
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each numeric column, nulls and NaN ignored; null between -Infinity and Infinity."""
    return {c: s.quantiles for c, s in summarize(df, probabilities, bins=bins).items()}


def summarize(df: DataFrame, probabilities: Mapping[str, Sequence[float]], fences: Sequence[float] = (), bins: int = BINS) -> dict[str, ColumnSummary]:
    """Per numeric column: moments, exact quantiles, and the number of values further than each of ``fences`` times the
    quartile distance outside the quartiles (none where a quartile is infinite)."""
    found: dict[str, ColumnSummary] = {}
    names = list(probabilities)
    for first in range(0, len(names), COLUMNS_PER_PASS):
        some = names[first : first + COLUMNS_PER_PASS]
        asked = {p for c in some for p in probabilities[c]} | ({0.25, 0.75} if fences else set())
        start = first_scan(df, some, sorted(asked))
        searches = {c: _Search(list(probabilities[c]), list(fences), start[c]) for c in some}
        before = None
        while any(s.open for s in searches.values()):
            segments = {c: s.segments() for c, s in searches.items() if s.open}
            state = {(c, g.low, g.high) for c, gs in segments.items() for g in gs}
            if state == before:
                raise RuntimeError("a scan has not narrowed the search")
            before = state
            counted = _count(df, segments, bins)
            for c in segments:
                searches[c].learn(counted[c])
        for c in some:
            s = searches[c]
            found[c] = ColumnSummary(s.n, [s.quantile(p) for p in probabilities[c]], [sum(o) for o in s.outside], start[c]["moments"])
    return found


class Sketch:
    """Buffers of sorted values; a full one hands on every second value, which then counts twice as much."""

    def __init__(self, seed: int):
        self.rng, self.levels = np.random.default_rng(seed), [np.zeros(0)]

    def add(self, values: np.ndarray) -> None:
        self.levels[0] = np.concatenate([self.levels[0], values])
        level = 0
        while len(self.levels[level]) >= 2 * BUFFER:
            full = np.sort(self.levels[level])
            even = len(full) // 2 * 2
            if level + 1 == len(self.levels):
                self.levels.append(np.zeros(0))
            self.levels[level + 1] = np.concatenate([self.levels[level + 1], full[self.rng.integers(2) : even : 2]])
            self.levels[level] = full[even:]
            level += 1 if len(self.levels[level]) < 2 * BUFFER else 0

    def points(self) -> np.ndarray:
        values = np.concatenate(self.levels)
        return equal_points(values, np.concatenate([np.full(len(v), 2.0**k) for k, v in enumerate(self.levels)]))


def equal_points(values: np.ndarray, weights: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Values at the given shares of the weight, by default at ``POINTS`` even ones (all values if there are fewer)."""
    if at is None and len(values) <= POINTS and (weights == weights[:1]).all():
        return np.sort(values)
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    at = (np.arange(POINTS) + 0.5) / POINTS if at is None else at
    return values[order][np.minimum(np.searchsorted(upto, at * upto[-1]), len(values) - 1)]


def merged_moments(parts: Sequence[Sequence[float]]) -> list[float]:
    """(n, mean, sums of squared, cubed and fourth differences from it) of parts together (Pébay, 2008)."""
    n, mean, m2, m3, m4 = 0.0, 0.0, 0.0, 0.0, 0.0
    for k, other, s2, s3, s4 in parts:
        if not k:
            continue
        both, d = n + k, other - mean
        d_n = d / both
        m4 += s4 + d * d_n**3 * n * k * (n * n - n * k + k * k) + 6 * d_n * d_n * (n * n * s2 + k * k * m2) + 4 * d_n * (n * s3 - k * m3)
        m3 += s3 + d * d_n * d_n * n * k * (n - k) + 3 * d_n * (n * s2 - k * m2)
        m2 += s2 + d * d_n * n * k
        mean, n = mean + d_n * k, both
    return [n, mean, m2, m3, m4]


def as_double(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


FIRST = "c int, slot int, n long, low double, high double, minus long, plus long, total double, mean double, m2 double, m3 double, m4 double, points array<double>"


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, column in enumerate(batch.columns):
        v = column.to_numpy(zero_copy_only=False)
        yield i, v[~np.isnan(v)]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's summary of every column."""
    seed = TaskContext.get().partitionId() if TaskContext.get() else 0
    state: dict[int, dict] = {}
    for batch in batches:
        for i, v in _arrays(batch):
            s = state.setdefault(i, {"minus": 0, "plus": 0, "low": math.inf, "high": -math.inf, "total": 0.0, "parts": [], "sketch": Sketch(seed * 1000 + i)})
            x = v[np.isfinite(v)]
            s["minus"] += int((v == -math.inf).sum())
            s["plus"] += int((v == math.inf).sum())
            if not len(x):
                continue
            s["low"], s["high"], s["total"] = min(s["low"], x.min()), max(s["high"], x.max()), s["total"] + float(x.sum())
            with np.errstate(over="ignore", invalid="ignore"):
                d = x - x.mean()
                s["parts"] = [merged_moments([*s["parts"], (len(x), float(x.mean()), float((d * d).sum()), float((d**3).sum()), float((d**4).sum()))])]
            s["sketch"].add(x)
    rows = []
    for i, s in state.items():
        n, mean, m2, m3, m4 = s["parts"][0] if s["parts"] else (0.0,) * 5
        points = s["sketch"].points().tolist() if n else []
        rows.append((i, seed % SLOTS, int(n), s["low"], s["high"], s["minus"], s["plus"], s["total"], mean, m2, m3, m4, points))
    if rows:
        yield _first_batch(rows)


def _first_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), *[pa.float64()] * 5, pa.list_(pa.float64())]
    names = [f.split(" ")[0] for f in FIRST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _merged(found: pa.Table) -> pa.Table:
    """The summaries of one column as one."""
    rows = found.to_pylist()
    held = [r for r in rows if r["n"]]
    with np.errstate(over="ignore", invalid="ignore"):
        n, mean, m2, m3, m4 = merged_moments([(r["n"], r["mean"], r["m2"], r["m3"], r["m4"]) for r in held])
    points = []
    if held:
        values = np.concatenate([r["points"] for r in held])
        points = equal_points(values, np.concatenate([np.full(len(r["points"]), r["n"] / len(r["points"])) for r in held])).tolist()
    low, high = min((r["low"] for r in rows), default=math.inf), max((r["high"] for r in rows), default=-math.inf)
    own = (rows[0]["c"], 0, int(n), low, high, *(sum(r[k] for r in rows) for k in ("minus", "plus")), math.fsum(r["total"] for r in rows) if all(math.isfinite(r["total"]) for r in rows) else sum(r["total"] for r in rows))
    return pa.Table.from_batches([_first_batch([(*own, mean, m2, m3, m4, points)])])


def first_scan(df: DataFrame, names: Sequence[str], asked: Sequence[float]) -> dict[str, dict]:
    """One scan over all columns: size, ends, infinite values, moments, and values around the quantiles ``asked`` for."""
    ship_package(df.sparkSession)
    values = df.select(*[as_double(c).alias(f"v{i}") for i, c in enumerate(names)])
    tasks = values.mapInArrow(_sketched, FIRST)
    # the tasks' points are merged in slots, so that no group grows with all tasks
    rows = tasks.groupBy("c", "slot").applyInArrow(_merged, FIRST).groupBy("c").applyInArrow(_merged, FIRST).collect()
    ranks = sorted({min(1.0, max(0.0, p + e)) for p in asked for e in (-1.5 * RANK_ERROR, 1.5 * RANK_ERROR)})
    empty = {"n": 0, "low": None, "high": None, "minus": 0, "plus": 0, "points": None, "ranks": ranks, "moments": _moments(0, None, None, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)}
    found = {c: dict(empty) for c in names}
    for r in rows:
        low, high = (r["low"], r["high"]) if r["n"] else (None, None)
        points = equal_points(np.array(r["points"]), np.ones(len(r["points"])), np.array(ranks)).tolist() if r["n"] else None
        found[names[r["c"]]] |= {"n": r["n"] + r["minus"] + r["plus"], "low": low, "high": high, "minus": r["minus"], "plus": r["plus"], "points": points,
                                 "moments": _moments(r["n"], low, high, r["minus"], r["plus"], r["total"], r["mean"], r["m2"], r["m3"], r["m4"])}
    return found


def _moments(n, low, high, minus, plus, total, mean, m2, m3, m4) -> dict[str, float | None]:
    """The statistics of a column from its sums; infinite values make them infinite or undefined."""
    out: dict[str, float | None] = dict.fromkeys(("min", "max", "mean", "std", "skew", "kurt"))
    out["sum"] = 0.0
    if minus or plus:
        total = math.nan if minus and plus else -math.inf if minus else math.inf
        whole = n + minus + plus
        out |= {"min": -math.inf if minus else low if n else math.inf, "max": math.inf if plus else high if n else -math.inf, "mean": total, "sum": total}
        out |= {"std": math.nan if whole > 1 else None, "skew": math.nan if whole > 2 else None, "kurt": math.nan if whole > 3 else None}
        return out
    if not n:
        return out
    out |= {"min": low, "max": high, "mean": total / n, "sum": total, "std": math.sqrt(max(m2, 0.0) / (n - 1)) if n > 1 else None}
    if low == high:
        return out | {"skew": 0.0 if n > 2 else None, "kurt": 0.0 if n > 3 else None}
    variance = m2 / n
    if n > 2:
        out["skew"] = m3 / n / variance**1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    if n > 3:
        out["kurt"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / n / variance**2 - 3) + 6)
    return out


CELLS = "c int, zone int, cell double, n long, low double, high double"


def _count(df: DataFrame, segments: Mapping[str, list[_Segment]], bins: int) -> dict[str, pd.DataFrame]:
    """One scan: per column, the cells (n, low, high) in order of value that together hold all finite values."""
    names = list(segments)
    ship_package(df.sparkSession)
    cuts = []
    for c in names:
        own = segments[c]
        # 0: the segment is one value or counted value by value
        many = [0 if g.low == g.high or g.inside <= bins else bins * 4 if g.inside <= 8 * bins else bins for g in own]
        cuts.append((np.array([g.low for g in own]), np.array([g.high for g in own]), np.array(many, dtype=float)))
    values = df.select(*[as_double(c).alias(f"v{i}") for i, c in enumerate(names)])
    cells = values.mapInArrow(_counter(cuts), CELLS).groupBy("c", "zone", "cell")
    cells = cells.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = cells.select("c", "n", "low", "high").toPandas().sort_values(["c", "low"])  # at most the bins of every segment
    return {c: found[found["c"] == i] for i, c in enumerate(names)}


def _counter(cuts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def folded(zone: np.ndarray, x: np.ndarray, n: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, many: np.ndarray):
        """Rows of equal (zone, cell) as one: zone, cell, n, low, high."""
        at = zone // 2
        inner = zone % 2 == 1
        seg = np.minimum(at, max(0, len(lows) - 1))
        # halved, so that the width of a segment over the whole double range stays finite
        width = np.where(highs[seg] > lows[seg], highs[seg] / 2 - lows[seg] / 2, 1.0)
        cell = np.where(inner, np.where(many[seg] > 0, np.floor((x / 2 - lows[seg] / 2) / width * many[seg]), x), 0.0) + 0.0
        order = np.lexsort((cell, zone))
        zone, cell, x, n, high = zone[order], cell[order], x[order], n[order], high[order]
        first = np.flatnonzero(np.r_[True, (np.diff(zone) != 0) | (np.diff(cell) != 0)])
        return zone[first], cell[first], np.add.reduceat(n, first), np.minimum.reduceat(x, first), np.maximum.reduceat(high, first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i, v in _arrays(batch):
                lows, highs, many = cuts[i]
                x = v[np.isfinite(v)]
                if not len(x):
                    continue
                at = np.searchsorted(highs, x, side="left")
                seg = np.minimum(at, len(highs) - 1)
                zone = 2 * at + ((at < len(highs)) & (x >= lows[seg]))
                zone, cell, n, low, high = folded(zone, x, np.ones(len(x), dtype=np.int64), x, lows, highs, many)
                held.setdefault(i, []).append((zone, low, n, high))
                if sum(len(h[0]) for h in held[i]) > 1 << 18:
                    held[i] = [_joined(held[i], folded, cuts[i])]
        for i, parts in held.items():
            zone, low, n, high = _joined(parts, folded, cuts[i])
            lows, highs, many = cuts[i]
            zone, cell, n, low, high = folded(zone, low, n, high, lows, highs, many)
            arrays = [pa.array(np.full(len(n), i, np.int32)), pa.array(zone.astype(np.int32)), pa.array(cell), pa.array(n), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(arrays, ["c", "zone", "cell", "n", "low", "high"])

    return count


def _joined(parts: list[tuple], folded, cut) -> tuple:
    zone, low, n, high = (np.concatenate(p) for p in zip(*parts))
    zone, _, n, low, high = folded(zone, low, n, high, *cut)
    return zone, low, n, high


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    probabilities: Mapping[str, float],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per group with the named quantiles and the non-null count ``n``; rows with a null key are left out."""
    keys = list(by)
    counts = (
        df.select(*keys, F.col(column).cast("double").alias("_x"))
        .dropna()
        .groupBy(*keys, "_x")
        .agg(F.count("*").alias("_w"))
    )
    split = split_by_order(counts, ["_x"], keys, rows_per_task)
    running = F.sum("_w").over(split.window())
    if split.divided:
        rows = split.attach(split.rows, split.offsets(F.sum("_w"))).withColumn("_cum", running + F.col("_start"))
    else:
        rows = split.rows.withColumn("_cum", running)
    totals = counts.groupBy(*keys).agg(F.sum("_w").alias("n"))
    rows = salted_join(rows, totals, keys, ["_x"], rows_per_task) if split.divided else rows.join(totals, keys)
    picks = []
    for name, p in probabilities.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_cum") - F.col("_w") <= rank) & (rank < F.col("_cum"))
            picks.append(F.max(F.when(hit, F.col("_x"))).alias(f"_{name}_{side}"))
    found = rows.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    outs = []
    for name, p in probabilities.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*keys, "n", *outs)
