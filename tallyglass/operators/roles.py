"""Column roles, date coercion and the table banner."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")

# The name fragments that mark a date column.
DATE_NAME_FRAGMENTS = "date|time|dt|year|month|_at|_on"
_DATE_WORDS = re.compile(r"^(date|time)|(date|time|dt|year|month)$", re.I)


@dataclass(frozen=True)
class Roles:
    numeric: list[str]
    categorical: list[str]
    date: list[str]

    def of(self, name: str) -> str | None:
        return next((r for r in ("numeric", "categorical", "date") if name in getattr(self, r)), None)


def column_roles(df: DataFrame) -> Roles:
    """Roles from the schema alone; columns of other types (arrays, maps) have none."""
    def pick(*kinds):
        return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]

    return Roles(
        numeric=pick(T.NumericType),
        categorical=pick(T.StringType, T.BooleanType),
        date=pick(T.DateType, T.TimestampType, T.TimestampNTZType),
    )


def roles_frame(df: DataFrame) -> DataFrame:
    roles = column_roles(df)
    rows = [(i, c, roles.of(c) or "other") for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position long, column string, role string")


def words_of(name: str) -> list[str]:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).split("_")


def looks_like_key(name: str) -> bool:
    """Whether the last word of the name is ``id`` or ends with ``key``, so that the column's sum means nothing."""
    last = words_of(name)[-1].lower()
    return last == "id" or last.endswith("key")


def looks_like_date(name: str, strict_names: bool = False) -> bool:
    """By whole word parts, or with ``strict_names`` by any fragment anywhere in the name."""
    if strict_names:
        return re.search(DATE_NAME_FRAGMENTS, name, re.I) is not None
    first, *rest = words_of(name)
    return any(_DATE_WORDS.search(p) for p in (first, *rest)) or any(p.lower() in ("at", "on") for p in rest)


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def coerce_dates(df: DataFrame, formats: Sequence[str] = DATE_FORMATS, strict_names: bool = False) -> DataFrame:
    """Parse date-named string columns; text no format fits becomes null.

    A column in which no value parses at all is left alone, unless ``strict_names`` is set.
    Numeric columns are never touched.
    """
    names = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and looks_like_date(f.name, strict_names)
    ]
    if names and not strict_names:
        parsed = df.agg(*[F.count(parse_date(F.col(c), formats)) for c in names]).first()
        names = [c for c, hits in zip(names, parsed) if hits]
    return df.withColumns({c: parse_date(F.col(c), formats) for c in names}) if names else df


def with_computed(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Attach computed columns, given as Column or SQL text."""
    return df.withColumns({n: F.expr(e) if isinstance(e, str) else e for n, e in columns.items()})


def table_banner(df: DataFrame) -> DataFrame:
    """One row: size, columns per role, leading names per role, quality score and grade."""
    from .profile import quality_score

    roles = column_roles(df)
    score = F.col("score")
    # Grade limits of the quality score.
    grade = F.when(score >= 90, "good").when(score >= 70, "fair").otherwise("poor")
    return quality_score(df).select(
        F.col("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(len(roles.numeric)).cast("long").alias("n_numeric"),
        F.lit(len(roles.categorical)).cast("long").alias("n_categorical"),
        F.lit(len(roles.date)).cast("long").alias("n_date"),
        F.lit(", ".join(roles.numeric[:4])).alias("numeric_names"),
        F.lit(", ".join(roles.categorical[:3])).alias("categorical_names"),
        F.lit(", ".join(roles.date[:1])).alias("date_names"),
        score,
        grade.alias("grade"),
    )
