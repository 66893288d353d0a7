"""Positional windows over groups of any size.

A plain ``Window`` sorts each of its groups in one task. That is right while every
group is small. Where one group is hot (or there is no grouping at all, so that the
whole table is the group), Spark's range partitioning cuts the rows, ordered by the
groups and all order keys, into as many ranges as their number takes. A range is a
bucket: the window runs per group and bucket, and a short frame of offsets carries
the position from bucket to bucket. Keys are compared as they are, of whatever type.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

ROWS_PER_TASK = 2_000_000

Order = Sequence[str | tuple[str, bool]]


def order_pairs(order_by: str | Order) -> list[tuple[str, bool]]:
    """Normalise ``"a"``, ``["a", ("b", False)]`` to (name, ascending) pairs."""
    items = [order_by] if isinstance(order_by, str) else list(order_by)
    return [(o, True) if isinstance(o, str) else (o[0], bool(o[1])) for o in items]


def sort_columns(pairs: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in pairs]


@dataclass
class Split:
    """Rows tagged with ordered buckets, plus what is needed to stitch the buckets together."""

    rows: DataFrame
    parts: list[str]
    order: list[tuple[str, bool]]
    divided: bool

    @property
    def keys(self) -> list[str]:
        return [*self.parts, "_bucket"] if self.divided else self.parts

    def window(self) -> WindowSpec:
        return Window.partitionBy(*[F.col(k) for k in self.keys]).orderBy(*sort_columns(self.order))

    def offsets(self, size: Column) -> DataFrame:
        """Per group and bucket: its size, the total before it and whether another bucket follows."""
        sizes = self.rows.groupBy(*self.keys).agg(size.cast("long").alias("_size"))
        w = Window.partitionBy(*self.parts).orderBy("_bucket")
        before = F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return sizes.select(*self.keys, "_size", before.alias("_start"), F.lead("_size").over(w).isNotNull().alias("_more"))

    def attach(self, rows: DataFrame, frame: DataFrame) -> DataFrame:
        return join_null_safe(rows, frame, self.keys)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the keys are kept once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def split_by_order(
    df: DataFrame, order_by: str | Order, partition_by: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK
) -> Split:
    """Buckets of about ``rows_per_task`` rows where a group is larger than that.

    Rows that agree in all order keys share a bucket, so the keys should be unique in a large group. The tagged rows are
    checkpointed: the borders come from a sample, and a second evaluation might draw another.
    """
    order, parts = order_pairs(order_by), list(partition_by)
    if parts:
        total, largest = df.groupBy(*parts).agg(F.count("*").alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    else:
        total = largest = df.count()
    if (largest or 0) <= rows_per_task:
        return Split(df, parts, order, False)
    ensure_checkpoint_dir(df.sparkSession)
    ranges = [F.col(p).asc_nulls_first() for p in parts] + sort_columns(order)
    cut = df.repartitionByRange(math.ceil(total / rows_per_task), *ranges)
    return Split(cut.withColumn("_bucket", F.spark_partition_id().cast("long")).checkpoint(), parts, order, True)


def window_column(
    df: DataFrame,
    name: str,
    build: Callable[[WindowSpec], Column],
    order_by: str | Order,
    partition_by: Sequence[str] = (),
    reach: int = 0,
    needs: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``build(window)``, a window expression that looks at most ``reach`` rows back at columns ``needs``."""
    split = split_by_order(df, order_by, partition_by, rows_per_task)
    if not split.divided:
        return df.withColumn(name, build(split.window()))
    rows = split.attach(split.rows, split.offsets(F.count("*")))
    rows = rows.withColumn("_pos", F.col("_start") + F.row_number().over(split.window()))
    keys, parts = split.keys, split.parts
    # The last ``reach`` rows of a bucket are repeated in front of the later buckets they reach into.
    tail = rows.filter(F.col("_more") & (F.col("_start") + F.col("_size") - F.col("_pos") < reach))
    reached = F.explode(F.sequence(F.col("_pos"), F.col("_pos") + reach - 1)).alias("_start")
    tail = tail.select(*parts, *needs, "_pos", reached)
    starts = split.offsets(F.count("*")).filter(F.col("_start") > 0).select(*keys, "_start")
    halo = join_null_safe(tail, starts, [*parts, "_start"]).select(*keys, *needs, "_pos", F.lit(True).alias("_halo"))
    body = rows.select(*df.columns, "_bucket", "_pos", F.lit(False).alias("_halo"))
    both = body.unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_pos")
    return both.withColumn(name, build(w)).filter(~F.col("_halo")).select(*df.columns, name)
