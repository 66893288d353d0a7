"""Bin numbers as plain sums of comparisons, so they stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges_below(x: Column, edges: Sequence[float | Column]) -> Column:
    """How many edges lie strictly below ``x`` (null for null)."""
    hits = [(x > e).cast("long") for e in edges]
    return reduce(lambda a, b: a + b, hits)


def right_closed_bin(x: Column, edges: Sequence[float | Column]) -> Column:
    """Index of the interval ``(e_i, e_i+1]`` holding ``x``; null outside the edges."""
    index = edges_below(x, edges) - 1
    return F.when((index >= 0) & (index < len(edges) - 1), index)


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Left-closed histogram bin 0..bins-1 with the maximum in the last bin; all in bin 0 if low = high."""
    position = F.floor((x - low) / (high - low) * bins)
    return F.when(x.isNull(), None).when(high == low, F.lit(0).cast("long")).otherwise(F.least(F.lit(bins - 1).cast("long"), position))
