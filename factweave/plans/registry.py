"""Named queries, their SQL, and the rows of the operator inventory that they cover."""

from __future__ import annotations

import importlib

FLAGSHIP = "hybrid_search_all"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, list[int]] = {}

#: Modules that register queries when they are imported.
MODULES = ["facts", "versions", "corpus", "extraction", "retrieval", "vectors", "consolidation", "graph", "entities", "governance", "streams", "ingestion", "claims", "values", "lineage", "structure", "language", "pairs", "answers", "checks", "graphs", "linking", "indexed"]


def query(name: str, covers: list[int], sql: str | None = None):
    """Registers a function of (spark, sf_dir); sql gives the same rows in DuckDB."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        COVERS[name] = covers
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"factweave.plans.{module}")
