"""Joins with small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # a counted side of at most this many short rows may be broadcast


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df for a join, broadcast only if it has at most ``rows`` rows.

    The optimizer's estimate follows the file an aggregate comes from, not its few
    rows: a catalog of a handful of types would meet the turns in a shuffle by
    type, a handful of tasks for all turns.  So the rows are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
