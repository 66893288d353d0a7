"""Writing results. Every export is a partitioned Spark write; nothing passes through the driver."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeseries import aggregate


#: Rows of a file at most.
ROWS_PER_FILE = 5_000_000


def export(
    df: DataFrame, path: str, fmt: str = "csv", cols: Sequence[str] | None = None, mode: str = "overwrite",
    rows_per_file: int = ROWS_PER_FILE, even: bool = False,
) -> str:
    """Write the rows, or the columns named. ``even`` deals them anew first, so that skewed or tiny partitions give files of
    about the advisory partition size (a shuffle); no file has more than ``rows_per_file`` rows either way.
    """
    rows = df.select(*cols) if cols else df
    writer = (rows.hint("rebalance") if even else rows).write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def pivot_sums(df: DataFrame, cat: str, num: str) -> DataFrame:
    return df.filter(F.col(cat).isNotNull()).groupBy(cat).agg(aggregate(num, "sum").alias("total"))


def export_pivot(df: DataFrame, folder: str, cat: str, num: str, fmt: str = "csv", cols: Sequence[str] | None = None) -> dict[str, str]:
    """The rows and, beside them, the sums of ``num`` by ``cat``."""
    return {
        "rows": export(df, f"{folder}/rows", fmt, cols),
        "pivot": export(pivot_sums(df, cat, num), f"{folder}/pivot", fmt),
    }


def with_table_name(alerts: DataFrame, table: str) -> DataFrame:
    return alerts.select(F.lit(table).alias("table"), "severity", "category", "title", "body", "recommendation", "column")


def export_alerts(alerts: DataFrame, folder: str, table: str, fmt: str = "csv", day: dt.date | None = None) -> str:
    """Alert report under a dated path."""
    stamp = (day or dt.date.today()).strftime("%Y%m%d")
    return export(with_table_name(alerts, table), f"{folder}/alerts_{table}_{stamp}", fmt)
