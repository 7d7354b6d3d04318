"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import assembly, evaluation, gates, ladder, leads, pages, places, policies, streams, tables, text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
