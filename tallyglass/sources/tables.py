"""Reading single tables and named collections of tables."""

from __future__ import annotations

import pathlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import normalize_nan

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    header: bool = True,
    where: Sequence[Column] = (),
) -> DataFrame:
    """One table with NaN normalised to null. Without a schema, CSV types are inferred by a pass over the data.

    Conditions in ``where`` apply to the rows as stored, before NaN is replaced, so that they reach the scan.
    """
    fmt = fmt or FORMATS.get(pathlib.PurePath(path.rstrip("/")).suffix, "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", header).option("inferSchema", schema is None)
    rows = reader.format(fmt).load(path)
    for condition in where:
        rows = rows.filter(condition)
    return normalize_nan(rows)


def read_workbook(spark: SparkSession, tables: Mapping[str, str] | str, register: bool = True) -> dict[str, DataFrame]:
    """Several tables by name: a mapping to paths, or a folder with one table per file. Each also becomes a view."""
    if isinstance(tables, str):
        tables = {pathlib.PurePath(p).stem: p for p in listed(spark, tables) if pathlib.PurePath(p).suffix in FORMATS}
    book = {name: read_table(spark, path) for name, path in tables.items()}
    if register:
        for name, df in book.items():
            df.createOrReplaceTempView(name)
    return book


def listed(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder of any file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().toString() for f in found)


def table_summary(book: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of every table."""
    out = None
    for name, df in book.items():
        part = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("long").alias("columns")
        )
        out = part if out is None else out.unionByName(part)
    return out
