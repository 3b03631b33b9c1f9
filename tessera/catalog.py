"""All registered queries of the engine with their SQL twins."""

from __future__ import annotations

from tessera.plans import context, graph, index, lifecycle, recall, source, store

MODULES = (recall, graph, store, source, context, lifecycle, index)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "recall_blend"
