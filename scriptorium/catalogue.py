"""Queries over the driver's tables, by name, and the same in SQL."""

from __future__ import annotations

from scriptorium.plans import book_queries, emit_queries, eval_queries, heading_queries, layout_queries, more_queries, page_queries, scalar_queries, structure_queries, text_queries

_MODULES = [text_queries, structure_queries, more_queries, scalar_queries, page_queries, layout_queries, book_queries, heading_queries, eval_queries, emit_queries]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
