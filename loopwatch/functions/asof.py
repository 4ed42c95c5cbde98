"""As-of joins: for each row the last row of another table that is not later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwatch.functions.dims import small
from loopwatch.functions.features import BLOCK
from loopwatch.functions.scans import nearest_valid


def asof(left: DataFrame, right: DataFrame, by: list[str], order: str | None = None, block: int = BLOCK) -> DataFrame:
    """left with `found`: a struct of the right row with equal `by` whose t is the greatest that is not beyond left's, null where
    there is none. Of right rows of one time that with the greatest `order` (any, if none is given) stands.

    The distinct times that are asked for and the right rows are laid in one series of half seconds, right before left, and the last
    valid row is carried over blocks of time: nothing is paired, many left rows of one time are scanned as one, repeated ones stay, and
    a long series is spread over tasks. Right rows whose key nobody asks for are not scanned. Left rows without a time or key find
    nothing."""
    names = [c for c in right.columns if c not in by]
    asked = left.select(*by, "t").dropna().distinct()
    # a null key is a group of its own in a scan, but equal to nothing in a join
    keyed = right.where(F.col("t").isNotNull()).join(small(asked.select(*by).distinct()), by, "left_semi")
    last = keyed.groupBy(*by, "t").agg(F.max_by(F.struct(*names), F.col(order) if order else F.struct(*names)).alias("_v"))
    ours = asked.select(*by, (2 * F.col("t") + 1).alias("t"))
    theirs = last.select(*by, (2 * F.col("t")).alias("t"), "_v")
    both = ours.unionByName(theirs, allowMissingColumns=True)
    carried = nearest_valid(both, {"found": F.col("_v")}, by, block=2 * block).where(F.col("t") % 2 != 0)
    found = carried.select(*(F.col(c).alias(f"_r_{c}") for c in by), F.floor(F.col("t") / 2).cast("bigint").alias("_r_t"), F.col("prev_found").alias("found"))
    same = [F.col(c) == F.col(f"_r_{c}") for c in (*by, "t")]
    return left.join(found, same, "left").select(*left.columns, "found")
