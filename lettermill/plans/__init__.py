"""Queries by theme; importing the package registers them all."""

from . import answers, bodies, browse, content, context, ingest, mail, relations, search, temporal  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
