"""Reference tables: broadcast only behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a reference table that may go to every task.
MOST = 10_000


def fixed(table: DataFrame, what: str = "the reference table", most: int = MOST) -> DataFrame:
    """table, if it has `most` rows or fewer; what is joined with all of it, or with none of its columns as a key, must be small."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"{what} has more than {most} rows")
    return table


def small(table: DataFrame, most: int = MOST) -> DataFrame:
    """table with a broadcast hint if it has `most` rows or fewer; else as it is, for Spark to join by its keys."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
