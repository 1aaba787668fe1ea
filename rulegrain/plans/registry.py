"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ["text_queries", "graph_queries", "table_queries", "question_queries", "profile_queries", "artifact_queries", "record_queries", "store_queries", "stream_queries"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"rulegrain.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
