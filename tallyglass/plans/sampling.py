"""Row samples. ``head`` keeps the first rows by key; ``hash`` keeps the rows with the smallest key hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import Order, order_pairs, sort_columns


def key_hash(id_cols: Sequence[str], seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in id_cols])


def sample_rows(df: DataFrame, n: int | None, order_by: str | Order, mode: str = "head", seed: int = 0) -> DataFrame:
    """``n`` rows, or without it all of them in no order."""
    if mode not in ("head", "hash"):
        raise ValueError("mode must be 'head' or 'hash'")
    if n is None:
        return df
    pairs = order_pairs(order_by)
    if mode == "head":
        return df.orderBy(*sort_columns(pairs)).limit(n)
    ids = [c for c, _ in pairs]
    return df.orderBy(key_hash(ids, seed), *[F.col(c) for c in ids]).limit(n)
