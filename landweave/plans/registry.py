"""All queries of the core and their SQL."""

from __future__ import annotations

from landweave.plans import cascade, control_texts, evaluation, files, flagship as _flagship, pipeline, places, reports, spatial, supervision, texts

_MODULES = [_flagship, places, spatial, evaluation, texts, supervision, pipeline, control_texts, cascade, files, reports]
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
flagship = _flagship.flagship
