"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a side that goes to every task.
ROWS = 50_000


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df marked for broadcast if it has no more than `rows` rows, else as it is, for the planner to join by key.  The count stops
    at the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
