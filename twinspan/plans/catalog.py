"""Every query of the engine by name, with its SQL twin where there is one."""

from __future__ import annotations

from . import call_queries, cigar_queries, format_queries, interval_queries, model_queries, pool_queries, stat_queries, variant_queries, whole_queries

_PARTS = (interval_queries, call_queries, cigar_queries, format_queries, stat_queries, model_queries, variant_queries, whole_queries, pool_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
