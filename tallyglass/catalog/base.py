"""Registration of queries and shared pieces of their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Filter, apply_filters
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path(name), "parquet")

    def where(self, name: str, filters: Sequence[Filter]) -> DataFrame:
        """Read with filters that the scan sees; those on long lists follow as joins."""
        rows = read_table(self.spark, self.path(name), "parquet", where=[f.condition for f in filters if f.members is None])
        return apply_filters(rows, [f for f in filters if f.members is not None])

    def raw(self, name: str) -> DataFrame:
        """As stored, so that filters reach the scan."""
        return self.spark.read.parquet(self.path(name))

    @property
    def lineitem_gaps(self) -> DataFrame:
        """lineitem with missing discounts and return flags."""
        return self.lineitem.withColumns(
            {
                "l_discount": F.expr("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END"),
                "l_returnflag": F.expr("CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END"),
            }
        )

    @property
    def orders_gaps(self) -> DataFrame:
        """orders with missing prices and priorities."""
        return self.orders.withColumns(
            {
                "o_totalprice": F.expr("CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END"),
                "o_orderpriority": F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END"),
            }
        )


LINEITEM_GAPS = """li AS (SELECT * REPLACE (
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS l_returnflag) FROM lineitem)"""
ORDERS_GAPS = """o AS (SELECT * REPLACE (
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM orders)"""

LINEITEM_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()
LINEITEM_NUMERIC = LINEITEM_COLUMNS[:8]
MEASURES = LINEITEM_COLUMNS[4:8]


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def union_all(selects: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(selects)
