"""Query registry.

``@register(name, sql)`` records a Spark builder ``f(spark, sf_dir) ->
DataFrame`` and, when the operator is SQL-expressible, its DuckDB twin over
the raw driver views.  Both sides alias every computed column identically.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their ``@register`` calls run."""
    from . import q_dialogue, q_extract, q_score, q_evaluate, q_bundle, q_classify, q_io, q_stream  # noqa: F401
