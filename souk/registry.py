"""Registered queries and their SQL."""

from __future__ import annotations

from souk.plans import brand_queries, decision_queries, group_queries, history_queries, label_queries, market_queries, payload_queries, recompute_queries, regroup_queries, report_queries, scan_queries, stream_queries, text_queries, upkeep_queries

_MODULES = (market_queries, recompute_queries, history_queries, text_queries, group_queries, decision_queries, report_queries, payload_queries, stream_queries, scan_queries, regroup_queries, label_queries, brand_queries, upkeep_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
