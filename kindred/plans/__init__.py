"""Registered queries: operators bound to the driver tables, each with its SQL where SQL can say it."""

from . import curation, retrieval, tables
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "curation", "retrieval", "tables"]
