"""Every query by name, and its SQL."""

from __future__ import annotations

from . import comparison, extract_queries, normalise_queries, protocol_queries, registry_queries, report_queries, sequence_queries, stream_queries

_MODULES = (comparison, registry_queries, sequence_queries, report_queries, normalise_queries, protocol_queries, extract_queries, stream_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
