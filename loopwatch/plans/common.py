"""What the query catalogues share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwatch.contract import DIRTY, PANEL, load

#: The panel and its dirty variant, for DuckDB.
WITH = f"with panel as ({PANEL}), dirty as ({DIRTY})"


def panel(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, PANEL)


def dirty(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, DIRTY)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero: engines may differ in the last bits of sums and logarithms."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def r4(c: Column | str) -> Column:
    """Four decimals by scaling first, as DuckDB's round does: Spark's own rounds the decimal digits of the double, so a mean that
    should lie halfway but for its last bit is rounded down."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e4) / 1e4 + F.lit(0.0)


def values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small fixed table."""
    return spark.sql(f"select * from {inline(rows, columns)}")


def inline(rows: list[tuple], columns: str) -> str:
    """The same table as SQL text that both engines read."""

    def lit(x) -> str:
        if isinstance(x, list):
            return "array(" + ", ".join(map(lit, x)) + ")"
        return "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)

    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") as v({columns})"
