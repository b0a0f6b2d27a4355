"""Text helpers shared by operators (native column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "#price"                              # FIXED VALUE: price marker of a rendered turn
PRICE_RE = r"^#price \$([0-9]+(\.[0-9]+)?)"


WHITESPACE = " \t\n\r\x0b\x0c"


def strip_ws(c) -> Column:
    """Python-style ``strip()`` of ASCII whitespace (a plain trim, no regex)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(WHITESPACE))


def sql_strip_ws(e: str) -> str:
    return f"trim({e}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def price_after_marker(c) -> Column:
    """Integer price stated after the first ``#price``; NULL when the marker
    is missing or that first one is not followed by ``$`` and a number (a
    later marker is never looked at)."""
    c = F.col(c) if isinstance(c, str) else c
    at = F.instr(c, MARKER)
    v = F.coalesce(F.regexp_extract(F.when(at > 0, c.substr(at, F.length(c))), PRICE_RE, 1), F.lit(""))
    return F.when(v == "", F.lit(None)).otherwise(F.floor(v.cast("double"))).cast("long")


def sql_price_after_marker(e: str) -> str:
    """Twin from string positions: the digits right after the first marker."""
    rest = f"substr({e}, strpos({e}, '#price') + 6)"
    number = f"substr({rest}, 3)"
    digits = f"substr({number}, 1, length({number}) - length(ltrim({number}, '0123456789')))"
    return (f"CASE WHEN strpos({e}, '#price') > 0 AND substr({rest}, 1, 2) = ' $' "
            f"THEN CAST(NULLIF({digits}, '') AS BIGINT) END")
