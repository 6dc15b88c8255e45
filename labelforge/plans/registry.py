"""Named queries and their DuckDB oracle SQL.

A query is ``f(spark, sf_dir) -> DataFrame`` over the given tables; its
oracle, when the operator is SQL-expressible, is registered next to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BENCH: list[str] = []


def query(name: str, sql: str | None = None, bench: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        if bench:
            BENCH.append(name)
        return fn
    return deco


def load_all() -> None:
    """Import every query module (registration happens at import)."""
    from labelforge.plans import (q_core, q_split, q_pseudo, q_align, q_consistency,  # noqa: F401
                                  q_rebalance, q_eval, q_sources, q_stream, q_recipes)
