"""Equi-join of rows to one-row-per-key facts in which a few keys may own a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import ROWS_PER_TASK

SALTS = 256
#: Facts of up to this many rows, counted first, are broadcast; the other rows then stay where they are.
BROADCAST_ROWS = 10_000


def salted_join(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], spread_by: Sequence[str], hot_rows: int = ROWS_PER_TASK
) -> DataFrame:
    """Inner join on non-null ``keys``, which are unique in ``facts``.

    Few facts are broadcast. Otherwise key sizes are counted, and where a key has more than ``hot_rows`` rows, these are
    spread over salts by the hash of ``spread_by`` and its fact is repeated once per salt. The broadcast list of such
    keys has less than one entry for each ``hot_rows`` rows.
    """
    keys = list(keys)
    if facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), keys)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= hot_rows:
        return rows.join(facts, keys)
    hot = F.broadcast(sizes.filter(F.col("_n") > hot_rows).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(SALTS))).otherwise(0)
    left = rows.join(hot, keys, "left").withColumn("_salt", salt.cast("long")).drop("_hot")
    last = F.when(F.col("_hot"), F.lit(SALTS - 1)).otherwise(0).cast("long")
    right = facts.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return left.join(right.drop("_hot"), [*keys, "_salt"]).drop("_salt")


def with_summary(rows: DataFrame, name: str, summary: DataFrame) -> DataFrame:
    """Attach the only value of a one-row summary to every row, as a single scalar subquery."""
    return rows.withColumn(name, summary.scalar())
