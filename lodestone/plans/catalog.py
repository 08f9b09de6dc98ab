"""Every named query of the engine with the SQL it must agree with."""

from __future__ import annotations

from lodestone.plans import eval_queries, evidence_queries, fact_queries, file_queries, filter_queries, library_queries, quote_queries, search_queries, store_queries, text_queries, tree_queries

_PARTS = (search_queries, fact_queries, eval_queries, text_queries, evidence_queries, tree_queries, store_queries, filter_queries, file_queries, library_queries, quote_queries)
QUERIES: dict = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
