"""Registered queries: each pairs a Spark plan over the driver tables with the
equivalent DuckDB SQL (the oracle).  ``__spark_entry__`` exposes both maps.

The SQL restates the model bindings of ``plans.bindings`` as CTEs, so every
oracle string runs on its own against the raw driver views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query name used twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def with_ctes(*names: str) -> str:
    """WITH clause for the named binding CTEs (dependencies first)."""
    from .oracle_sql import CTE
    parts = [f"{n} AS ({CTE[n].strip()})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"


def load_all() -> None:
    """Import every module that registers queries."""
    from . import queries_views  # noqa: F401
    from . import queries_ingest  # noqa: F401
    from . import queries_actions  # noqa: F401
    from . import queries_replies  # noqa: F401
    from . import queries_mail  # noqa: F401
    from . import queries_memory  # noqa: F401
    from . import queries_dispatch  # noqa: F401
    from . import queries_streams  # noqa: F401
