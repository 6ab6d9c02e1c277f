"""Registry of named queries: a Spark plan plus, where SQL can say the same,
the DuckDB text that checks it.

Each query takes (spark, sf_dir) and returns a lazy DataFrame over the whole
test tables.  Float outputs are rounded half-up so that both engines agree
to the last printed digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from countframe.plans import (  # noqa: F401
        q_embedding,
        q_evaluation,
        q_invariants,
        q_mapping,
        q_models,
        q_neighbors,
        q_preprocess,
        q_qc,
    )
