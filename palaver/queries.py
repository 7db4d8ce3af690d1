"""Every query of the core, by name, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .stage import ship

MODULES = [
    "plans.pipeline", "operators.signals", "operators.texts", "sources.transcripts", "operators.privacy", "operators.people", "operators.dynamics", "operators.grounding", "operators.evaluation",
    "operators.retrieval", "operators.logs", "operators.results", "operators.reports", "operators.records", "operators.schema_drift", "plans.prompts",
]


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return f(spark, folder)

    return run


def gather(modules: list[str], package: str) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """QUERIES and SQL of the named modules, joined."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql: dict[str, str] = {}
    for name in modules:
        m = import_module(f".{name}", package)
        queries |= {k: _shipped(f) for k, f in m.QUERIES.items()}
        sql |= m.SQL
    return queries, sql
