"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII white space removed by the service's trimming (tab, LF, VT, FF, CR, space).
WHITESPACE = "\t\n\x0b\x0c\r "


def go_trim(col: Column) -> Column:
    """Trim leading/trailing ASCII white space (not just blanks)."""
    return F.trim(col, F.lit(WHITESPACE))


def storage_node_id(env: Column, node: Column) -> Column:
    """``env:node`` with both trimmed, or just ``node`` when env is blank."""
    e, n = go_trim(env), go_trim(node)
    return F.when(F.coalesce(e, F.lit("")) == "", n).otherwise(F.concat(e, F.lit(":"), n))


def excerpt(body: Column, limit: int = 120) -> Column:
    """Bounded excerpt of a rejected body: trimmed, first ``limit`` characters plus ``...``."""
    t = go_trim(body)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)
