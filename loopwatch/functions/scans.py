"""Scans along a device's series that don't add up: nearest valid values, frames of readings, spaced choices.

A series is cut into blocks of time. What a block hands on is summed up in one row; those rows meet by device, and what comes in
from other blocks is joined back. So the readings of one device are spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from loopwatch.functions.features import BLOCK, halo_blocks, running
from loopwatch.sources.store import written


def null_safe(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a and b joined where all columns of `by` are equal, nulls included; a's are kept."""
    other = b.withColumnsRenamed({c: f"_r_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    return a.join(other, on, how).drop(*(f"_r_{c}" for c in by))


def nearest_valid(df: DataFrame, values: dict[str, Column], by: list[str], own: bool = True, block: int = BLOCK, stored: bool = False) -> DataFrame:
    """df with prev_ and next_ of each named value: the nearest one that isn't null before and after each row within `by`, the row's
    own included unless `own` is false. A time occurs once within `by`.

    The rows are read twice, for the blocks' sums and for themselves, so they are written once unless they are `stored`. They are
    dealt once, by a hash of their block; windows and the join both keep that."""
    have = df if stored else written(df)
    have = have.withColumns({f"_v_{n}": v for n, v in values.items()}).withColumn("_b", F.floor(F.col("t") / block)).withColumn("_g", F.xxhash64(*by, "_b"))
    at = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), F.col("t"))
    keys = ["_g", *by, "_b"]
    blocks = have.groupBy(*keys).agg(*(g(f"_v_{n}", at(n)).alias(f"_{x}_{n}") for n in values for x, g in (("f", F.min_by), ("l", F.max_by))))
    edge = (Window.unboundedPreceding, -1)
    up, down = (Window.partitionBy(*by).orderBy(o).rowsBetween(*edge) for o in ("_b", F.desc("_b")))
    blocks = blocks.select(*(F.col(c).alias(f"_r{c}") for c in keys), *(F.last(f"_l_{n}", True).over(up).alias(f"_i_{n}") for n in values), *(F.last(f"_f_{n}", True).over(down).alias(f"_o_{n}") for n in values))
    here = (Window.unboundedPreceding, 0 if own else -1)
    up, down = (Window.partitionBy(*keys).orderBy(o).rowsBetween(*here) for o in ("t", F.desc("t")))
    local = have.repartition("_g").withColumns({f"{x}_{n}": F.last(f"_v_{n}", True).over(w) for n in values for x, w in (("prev", up), ("next", down))})
    # the hash alone is the join's key, so that rows stay where they are; equal hashes of other blocks are told apart behind it
    same = F.lit(True)
    for c in (*by, "_b"):
        same = same & F.coalesce(F.col(c).eqNullSafe(F.col(f"_r{c}")), F.lit(False))
    both = local.join(blocks, (F.col("_g") == F.col("_r_g")) & same, "left")
    out = both.withColumns({f"{x}_{n}": F.coalesce(f"{x}_{n}", f"_{y}_{n}") for n in values for x, y in (("prev", "i"), ("next", "o"))})
    return out.drop("_b", "_g", *(f"_r{c}" for c in keys), *(f"_{x}_{n}" for n in values for x in "vio"))


def numbered(df: DataFrame, by: list[str], coarse: list[Column], order: list[str], name: str = "k", total: str | None = None) -> DataFrame:
    """df with its rows numbered from 1 on within `by`, in `order`; with total, how many there are. coarse: columns that never fall
    as the order goes on. Rows are counted by them first and numbered within them, so a large group is spread over tasks."""
    marks = [f"_num_c{i}" for i in range(len(coarse))]
    rows = df.withColumns(dict(zip(marks, coarse, strict=True)))
    counts = rows.groupBy(*by, *marks).agg(F.count(F.lit(1)).alias("_num_n"))
    upto = Window.partitionBy(*by).orderBy(*marks).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(*by, *marks, (F.sum("_num_n").over(upto) - F.col("_num_n")).alias("_num_o"), F.sum("_num_n").over(Window.partitionBy(*by)).alias("_num_t"))
    inside = rows.withColumn("_num_k", F.row_number().over(Window.partitionBy(*by, *marks).orderBy(*order)))
    out = null_safe(inside, counts, [*by, *marks]).withColumn(name, F.col("_num_k") + F.col("_num_o"))
    out = out.withColumn(total, F.col("_num_t")) if total else out
    return out.drop("_num_k", "_num_o", "_num_t", *marks)


def in_frames(df: DataFrame, before: int, columns: Callable[[WindowSpec], dict[str, Column]], block: int = BLOCK) -> DataFrame:
    """df with columns over windows that look back at most `before` readings of a device; the callable gets the ordered window."""
    counted = running(written(df), {"_k": F.lit(1)}, block)
    rows = halo_blocks(counted.withColumn("_k", F.col("_k") - 1), "_k", before, 0, block)
    w = Window.partitionBy("device_id", "_b").orderBy("_k")
    return rows.withColumns(columns(w)).where("_own").drop("_k", "_b", "_own")


def spaced(hits: DataFrame, gap: int, block: int = BLOCK) -> DataFrame:
    """The rows of hits (device_id, t, ...) that are chosen when each choice shuts out the rows of the next `gap` seconds: the first,
    the first that is `gap` seconds or more after it, and so on. A time occurs once for a device."""
    if not 0 < gap <= block:
        raise ValueError("gap must lie between 1 and the block's length")
    times = hits.groupBy("device_id", F.floor(F.col("t") / block).alias("_b")).agg(F.sort_array(F.collect_list("t")).alias("_ts"))
    start = F.col("_b") * block
    after = lambda free: F.aggregate("_ts", free, lambda acc, t: F.when(t >= acc, t + gap).otherwise(acc))
    # for each number of seconds that the block's start is shut: how many of the next block's are
    handed = F.array(*(F.greatest(F.lit(0).cast("long"), after((start + c).cast("long")) - start - block) for c in range(gap)))
    rows = times.select("device_id", "_b", handed.alias("_out")).groupBy("device_id").agg(F.sort_array(F.collect_list(F.struct("_b", "_out"))).alias("_bs"))
    empty = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.expr("cast(array() as array<struct<_b: bigint, _in: bigint>>)").alias("seen"))

    def go(acc: Column, x: Column) -> Column:
        shut = F.when(x["_b"] == acc["b"] + 1, acc["c"]).otherwise(F.lit(0).cast("long"))
        seen = F.concat(acc["seen"], F.array(F.struct(x["_b"].alias("_b"), shut.alias("_in"))))
        return F.struct(x["_b"].alias("b"), F.get(x["_out"], shut.cast("int")).alias("c"), seen.alias("seen"))

    carried = rows.select("device_id", F.explode(F.aggregate("_bs", empty, go)["seen"]).alias("x")).select("device_id", "x.*")
    first = F.struct((start + F.col("_in")).cast("long").alias("free"), F.expr("cast(array() as array<bigint>)").alias("ts"))
    pick = F.aggregate("_ts", first, lambda acc, t: F.when(t >= acc["free"], F.struct((t + gap).alias("free"), F.concat(acc["ts"], F.array(t)).alias("ts"))).otherwise(acc))
    chosen = times.join(carried, ["device_id", "_b"]).select("device_id", F.explode(pick["ts"]).alias("t"))
    return hits.join(chosen, ["device_id", "t"], "left_semi")
