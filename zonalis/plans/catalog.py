"""All registered queries on the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import fields_queries, search_queries, skill_queries, surrogate_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "fields_queries", "search_queries", "skill_queries", "surrogate_queries"]
