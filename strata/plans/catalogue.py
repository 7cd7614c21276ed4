"""The registered queries of the library and the SQL each must equal."""

from __future__ import annotations

from strata.plans import detail_queries, graph_queries, history_queries, ledger_queries, ledger_sink_queries, map_queries, oracle_queries, reading_queries, source_queries, text_queries, version_queries

_PARTS = (history_queries, text_queries, ledger_queries, graph_queries, reading_queries, source_queries, detail_queries, oracle_queries, ledger_sink_queries, version_queries, map_queries)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL: dict = {k: v for p in _PARTS for k, v in p.SQL.items()}
