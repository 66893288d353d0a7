"""Registered queries: every operator applied to the given tables, with its SQL equivalent where one exists."""

from . import charts, computed, filters, profile, relations, segments, vectors, alerts  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
