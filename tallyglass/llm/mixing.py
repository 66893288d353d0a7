"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Every document is repeated Poisson(rate of its source) times, so each source reaches its target share in expectation
while the decision for a document needs nothing but its own id: the uniform number comes from a hash of id and seed,
and the count is the inverse of the Poisson distribution at it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import salted_join, with_summary

#: A rate above this is drawn as a sum of equal parts, each with its own uniform number, so exp(-rate) never vanishes.
LARGEST_PART = 8.0
#: Terms of the distribution kept for a part; beyond them a mean of 8 leaves less than 1e-30.
TERMS = 64
#: The table of rates has a row per source; up to this many rows (counted first) it is broadcast.
BROADCAST_SOURCES = 10_000


def uniform(seed: int, key: Column, draw: Column) -> Column:
    """A number in (0, 1) with 52 random bits from the md5 of seed, key and draw."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key, draw.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_table(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... for a Poisson variable."""
    first = F.exp(-mean)
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all")),
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            (a["sum"] + a["p"] * mean / k).alias("sum"),
            F.concat(a["all"], F.array(a["sum"] + a["p"] * mean / k)).alias("all"),
        ),
    )
    return steps["all"]


def source_key(source: Column) -> Column:
    """Sources as text; the missing source is a source of its own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def mix(
    docs: DataFrame,
    weights: Mapping[object, float] | None = None,
    total: float | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    seed: int = 0,
    copy_col: str = "copy_no",
    order_col: str = "shuffle_key",
) -> DataFrame:
    """All columns of ``docs`` with each row repeated, plus ``copy_col`` (from 1) and ``order_col``, in random order.

    ``weights`` maps sources to non-negative target shares, which are scaled to sum to one; sources it does not name get
    none. Without it all sources weigh the same. ``total`` is the expected number of rows (default: as many as there
    are). A null source is one more source (key ``None``). Rows with the same id share their draw; a null id is drawn
    as an empty one. Sources of weight 0 vanish; an empty table stays empty. Columns of the input named like
    ``copy_col`` or ``order_col`` are replaced.
    """
    if weights is not None and (any(w < 0 for w in weights.values()) or not sum(weights.values())):
        raise ValueError("weights must be non-negative and not all zero")
    rates = source_rates(docs, weights, total, source_col)
    key, order = "__mix_key", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.drop(copy_col, order_col).withColumn(key, source_key(F.col(f"`{source_col}`")))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(rates), key)
    else:
        rows = salted_join(rows, rates, [key], [id_col])
    draws = F.transform(F.sequence(F.lit(1), F.col("__mix_parts")), lambda j: uniform(seed, order, j))
    below = F.transform(draws, lambda u: F.size(F.filter(F.col("__mix_table"), lambda c: c < u)))
    copies = F.aggregate(below, F.lit(0), lambda a, n: a + n)
    repeated = (
        rows.withColumn("__mix_copies", copies)
        .drop(key, "__mix_table", "__mix_parts")
        .filter("__mix_copies > 0")
        .withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
        .drop("__mix_copies")
    )
    shuffled = repeated.withColumn(order_col, F.md5(F.concat_ws(":", F.lit(f"order {seed}"), order, F.col(f"`{copy_col}`"))))
    # the key is random, so hashing it deals the rows evenly, and sorting by it leaves no trace of the input's order
    return shuffled.repartition(F.col(f"`{order_col}`")).sortWithinPartitions(order_col)


def source_rates(docs: DataFrame, weights: Mapping[object, float] | None, total: float | None, source_col: str) -> DataFrame:
    """Per source with a positive rate: its key, the table of one part and the number of parts."""
    counts = docs.groupBy(source_key(F.col(f"`{source_col}`")).alias("__mix_key")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        named = [F.lit(x) for s, w in weights.items() for x in ("-" if s is None else f"+{s}", float(w))]
        weight = F.coalesce(F.try_element_at(F.create_map(*named), F.col("__mix_key")), F.lit(0.0))
    counts = counts.withColumn("w", weight)
    counts = with_summary(counts, "all_w", counts.agg(F.sum("w")))
    counts = counts.withColumn("all_n", F.lit(float(total))) if total is not None else with_summary(counts, "all_n", counts.agg(F.sum("n")))
    rate = F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")
    rates = counts.filter("w > 0").withColumn("rate", rate).filter("rate > 0")
    parts = F.ceil(F.col("rate") / LARGEST_PART).cast("int")
    rates = rates.withColumn("__mix_parts", parts)
    return rates.select("__mix_key", "__mix_parts", poisson_table(F.col("rate") / F.col("__mix_parts")).alias("__mix_table"))


#: What :func:`mix` gives for ``documents`` with equal weights, for DuckDB.
SQL = """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / count(*) OVER () * sum(n) OVER () / n AS rate FROM s),
p AS (SELECT source, ceil(rate / 8)::INT AS parts, rate / ceil(rate / 8) AS mean FROM r),
terms AS (SELECT source, parts, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS pmf FROM p, generate_series(0, 63) AS g(k)),
cdf AS (SELECT source, parts, k, sum(pmf) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
draws AS (
  SELECT d.doc_id, d.source, (('0x' || substr(md5('0:' || d.doc_id || ':' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS j)),
counted AS (
  SELECT doc_id, sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM draws.source AND c < u))::BIGINT AS copies
  FROM draws GROUP BY doc_id)
SELECT d.*, copy_no::INT AS copy_no, md5('order 0:' || d.doc_id || ':' || copy_no) AS shuffle_key
FROM documents d JOIN counted USING (doc_id), LATERAL (SELECT unnest(range(1, copies + 1)) AS copy_no)
"""
