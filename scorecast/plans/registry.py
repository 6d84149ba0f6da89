"""Registry of named queries: key -> (Spark callable, optional DuckDB oracle SQL).

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole mapped
tables. Oracle SQL runs on DuckDB views named after the driver's tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorecast.session import bound_tasks, ensure_session_defaults
from scorecast.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``key``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_session_defaults(spark)
            t = Tables.for_dir(spark, sf_dir)
            bound_tasks(spark, t.input_bytes)
            return fn(t)

        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = run
        if oracle is not None:
            ORACLE[key] = oracle
        return fn

    return deco


def load_all() -> None:
    # Importing the query modules fills the registry.
    from scorecast.plans import q_fixtures, q_groups, q_leaderboard, q_predictions  # noqa: F401
    from scorecast.plans import q_quality, q_schedule, q_scoring, q_streaming, q_users, q_writes  # noqa: F401
