"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the operator is SQL-expressible, its DuckDB SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import with_views

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return deco


def r6(c: Column | str) -> Column:
    """Metrics are rounded to 6 decimals at the very end (oracle rule)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> None:
    """Import every query module (each registers on import)."""
    import importlib
    for mod in ("q_eval", "q_select", "q_groups", "q_fusion", "q_stats", "q_text", "q_arrays", "q_io", "q_stream"):
        try:
            importlib.import_module(f"{__package__}.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{mod}":
                raise
