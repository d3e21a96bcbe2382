"""All queries by name, and the SQL that checks them."""

from . import export_queries, layout_queries, reading_queries, source_queries, text_queries

_MODULES = (layout_queries, text_queries, source_queries, export_queries, reading_queries)
QUERIES: dict = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
