"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from landweave.llm import queries_records, queries_texts

_MODULES = [queries_records, queries_texts]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
