"""Names of the subpackage's contract queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its twin, None where SQL cannot state it."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all():
    from . import (alignment, archive, embeddings, interaction, jaccard, lexical, line_runs,  # noqa: F401
                   mixing, packing, pii, sharding, suffixes, toxicity)
    return QUERIES, ORACLES
