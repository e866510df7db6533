"""Broadcast only behind a size check.

``small_side`` counts a (small, derived) table and marks it for broadcast
only when its rows, at ``row_bytes`` each, stay within ``max_bytes``; beyond it
the join stays a shuffle join. The count is an ordinary distributed one over
the table that is about to be joined, so callers pass tables that are cheap to
count (aggregates, written tables), and a row width that fits their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 64 << 20
#: A few numbers or a short key and a number or two.
ROW_BYTES = 64


def small_side(df: DataFrame, row_bytes: int = ROW_BYTES, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    return broadcast_if(df, df.count(), row_bytes, max_bytes)


def broadcast_if(df: DataFrame, known_rows: int, row_bytes: int = ROW_BYTES,
                 max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast a table whose row count is already known (e.g. one row per
    block of a counted block table)."""
    return F.broadcast(df) if known_rows * row_bytes <= max_bytes else df
