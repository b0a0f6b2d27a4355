"""Repeatable pseudo-randomness keyed by row content.

``rand()`` depends on partitioning and ``xxhash64`` has no twin outside Spark;
md5 of a ``:``-joined key gives the same draw at any partitioning and in the
DuckDB oracle.  Only pass integer or string columns (their text forms agree).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _key(seed, cols) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.concat_ws(":", *parts)


def md5_int(seed, *cols) -> Column:
    """First 32 bits of md5(seed:cols...) as a non-negative long."""
    return F.conv(F.substring(F.md5(_key(seed, cols)), 1, 8), 16, 10).cast("long")


def md5_uniform(seed, *cols) -> Column:
    """Uniform draw in [0, 1)."""
    return md5_int(seed, *cols) / F.lit(TWO32)


def md5_bucket(seed, n, *cols) -> Column:
    """Bucket in [0, n)."""
    return F.pmod(md5_int(seed, *cols), F.lit(n) if not isinstance(n, Column) else n)


def sql_md5_int(seed, *exprs: str) -> str:
    """DuckDB twin of :func:`md5_int` over SQL expressions."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT"


def sql_md5_uniform(seed, *exprs: str) -> str:
    return f"({sql_md5_int(seed, *exprs)} / 4294967296.0)"
