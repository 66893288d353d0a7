"""What the operators share: registration of queries, column picking, shared scratch tables, worker set-up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns under internal names, so that no other column of the input can clash."""
    return df.select(*[F.col(f"`{source}`").alias(alias) for alias, source in names.items()])


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of every row; a null text is an empty one."""
    return pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder all executors share and read back: lineage is cut and later plans know the size."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the filter in :func:`likely`, in bitmaps of 32,768 bits: 4 MB whatever the data.
FILTER_BITS = 1 << 25


def likely(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose ``key`` is among ``wanted_key``, and some others, without moving any rows.

    A broadcast bitmap of hashes, bounded by ``FILTER_BITS``, thins out ``rows`` before they are shuffled for a join.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = wanted.select(place(wanted_key).alias("p")).select(F.shiftright("p", 15).alias("__slot"), (F.col("p") % 32768).alias("b"))
    bitmaps = bits.groupBy("__slot").agg(F.bitmap_construct_agg("b").alias("__bits"))
    kept = rows.withColumn("__place", place(key)).withColumn("__slot", F.shiftright("__place", 15))
    kept = kept.join(F.broadcast(bitmaps), "__slot")  # at most FILTER_BITS / 32768 rows
    bit = (F.col("__place") % 32768).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return kept.filter(byte.bitwiseAND(F.expr("shiftleft(1, CAST(__place % 8 AS INT))")) != 0).select(*rows.columns)


def in_workers(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package importable in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of text, or of one row where that is longer."""
    start = 0
    offsets = pc.binary_length(batch.column(text)).to_pylist()
    size = 0
    for i, n in enumerate(offsets):
        size += n or 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
