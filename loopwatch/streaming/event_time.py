"""Event time: each event once, counted in windows and sessions, whatever order its files come in.

The rule for late rows: a row counts if its time is not before the watermark, which is the latest time seen in earlier batches less
`delay`. Later ones are dropped by the query and counted in its progress. A row that is delivered again within the delay is
counted once, by its id; beyond the delay it is late and dropped anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, ts: str, key: str, delay: str) -> DataFrame:
    """Each row of a stream once, by key, for as long as a repetition may come."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed(rows: DataFrame, ts: str, by: str, width: str) -> DataFrame:
    """by, start, n and total of each window that has closed."""
    w = rows.groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(by, F.col("window.start").alias("start"), "n", "total")


def sessions(rows: DataFrame, ts: str, by: str, gap: str) -> DataFrame:
    """by, start, end (gap after the last row) and n of each session that has closed."""
    w = rows.groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def dropped(query) -> int:
    """Rows that a finished query dropped for being late, by its progress."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
