"""Queries of the temporal and signal operators, with their SQL."""

from __future__ import annotations

from tidemark.plans import aggregates, creation, functions, joins, lifetimes, patterns, sequences, signals, wider
from tidemark.plans.tables import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "creation", "functions", "joins", "lifetimes", "patterns", "sequences", "signals", "wider"]
