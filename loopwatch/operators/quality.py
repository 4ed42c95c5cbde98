"""Quality control of a device's series: order, duplicates, grid, outliers and imputation, as window expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from loopwatch.contract import CHANNELS, LABELS
from loopwatch.functions.features import BLOCK, ordered
from loopwatch.functions.scans import nearest_valid
from loopwatch.sources.store import written

# Credible range of each channel, and the most it can change in a second.
BOUNDS = {
    "inlet_temp": (0.0, 60.0), "outlet_temp": (0.0, 100.0), "pressure": (0.0, 600.0), "flow_rate": (0.0, 20.0),
    "flow_velocity": (0.0, 10.0), "tank_level": (0.0, 400.0), "conductivity": (0.0, 2000.0), "cabinet_temp": (0.0, 90.0),
    "cabinet_humidity": (0.0, 100.0), "furnace_temp": (0.0, 2000.0), "electric_power": (0.0, 5000.0), "electric_current": (0.0, 5000.0),
}
RATES = {
    "inlet_temp": 0.5, "outlet_temp": 0.5, "pressure": 50.0, "flow_rate": 0.5, "flow_velocity": 0.2, "tank_level": 5.0,
    "conductivity": 10.0, "cabinet_temp": 15.0, "cabinet_humidity": 2.0, "furnace_temp": 20.0, "electric_power": 3100.0, "electric_current": 2000.0,
}
HAMPEL_SPAN, HAMPEL_LEAST, HAMPEL_SIGMAS = 121, 5, 5.0

def out_of_order(df: DataFrame) -> DataFrame:
    """Per device, how many readings are older than the one that arrived before."""
    late = F.col("t") < F.lag("t").over(Window.partitionBy("device_id").orderBy("arrival_seq"))
    return df.select("device_id", late.alias("late")).groupBy("device_id").agg(F.count_if("late").alias("n_out_of_order"))


def dedup_keep_first(df: DataFrame) -> DataFrame:
    """One reading per device and time: the first to arrive (dropDuplicates would pick any)."""
    w = Window.partitionBy("device_id", "t").orderBy("arrival_seq")
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def to_grid(df: DataFrame, step: int = 1) -> DataFrame:
    """Every step between a device's first and last reading; where none was taken the channels are null."""
    span = df.groupBy("device_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    grid = span.select("device_id", F.explode(F.sequence("lo", "hi", F.lit(step).cast("bigint"))).alias("t"))
    return grid.join(df, ["device_id", "t"], "left")


def fill_labels(df: DataFrame) -> DataFrame:
    """The last label before, else the first after. A device's blocks of time go to different tasks."""
    out = nearest_valid(df, {c: F.col(c) for c in LABELS}, ["device_id"])
    return out.withColumns({c: F.coalesce(f"prev_{c}", f"next_{c}") for c in LABELS}).drop(*(f"{x}_{c}" for c in LABELS for x in ("prev", "next")))


def _edges(marks: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """marks, a row for each block with _f_ and _l_ of each name (its first and last value, null if it has none), as what comes in
    from the blocks before (_i_) and after (_o_)."""
    edge = (Window.unboundedPreceding, -1)
    up, down = (Window.partitionBy(*by).orderBy(o).rowsBetween(*edge) for o in ("_b", F.desc("_b")))
    rest = [c for c in marks.columns if c not in {f"_{x}_{n}" for n in names for x in "fl"}]
    return marks.select(*rest, *(F.last(f"_l_{n}", True).over(up).alias(f"_i_{n}") for n in names), *(F.last(f"_f_{n}", True).over(down).alias(f"_o_{n}") for n in names))


def _beside(blocks: GroupedData, edges: DataFrame, keys: list[str], run: Callable, schema: StructType) -> DataFrame:
    """What run makes of each block's key, rows and edge. The edge comes of the same rows, so its keys take names of their own."""
    return blocks.cogroup(edges.withColumnsRenamed({k: f"_of_{k}" for k in keys}).groupBy(*(f"_of_{k}" for k in keys))).applyInArrow(run, schema)


def _doubles(rows: pa.Table, c: str) -> np.ndarray:
    """A channel with NaN where it is null."""
    return rows.column(c).to_numpy().astype(float)


def _nullable(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), from_pandas=True)


def _firsts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first arrival of each time, in the order of time, and their times."""
    t = rows.column("t").to_numpy()
    order = np.lexsort((rows.column("arrival_seq").to_numpy(), t)) if "arrival_seq" in rows.column_names else np.argsort(t, kind="stable")
    at = t[order]
    keep = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
    return order[keep], at[keep]


def gridded(raw: DataFrame, schema: StructType, run: Callable[[pa.Table, np.ndarray, pa.Table], pa.Table] | None = None, reach: int = 0, labels: bool = False, by_device: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """First arrivals of raw (device_id and t are whole numbers) on a grid of seconds, as `to_grid` of `dedup_keep_first`; with
    labels, filled as by `fill_labels`. run makes the rows of `schema` from a block's grid with `reach` seconds on either side, which of its
    seconds are the block's own, and the row of its device; without it they are the grid itself.

    Rows are dealt once, by device and block of time. What a block needs of the others is a row: the device's first and last time,
    nearest labels, and what by_device makes of the dealt rows (device_id, _b, _own and raw's columns), by device_id."""
    home = F.floor(F.col("t") / BLOCK)
    near = F.explode(F.sequence(F.floor((F.col("t") - reach) / BLOCK), F.floor((F.col("t") + reach) / BLOCK))) if reach else home
    rows = raw.where("device_id is not null and t is not null").withColumn("_b", near).withColumn("_own", F.col("_b") == home)
    blocks = rows.groupBy("device_id", "_b")
    ends = raw.where("device_id is not null and t is not null").groupBy("device_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    spans = ends.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))))
    if by_device:
        spans = spans.join(by_device(blocks), "device_id", "left")
    if labels:
        kinds = ", ".join(f"_{x}_{c} string" for c in LABELS for x in "fl")

        def mark(key: tuple, own: pa.Table) -> pa.Table:
            own = own.filter(own.column("_own"))
            at, _ = _firsts(own)
            out = {"device_id": [key[0].as_py()], "_b": [key[1].as_py()]}
            for c in LABELS:
                known = own.column(c).take(pa.array(at)).drop_null()
                out |= {f"_f_{c}": [known[0].as_py() if len(known) else None], f"_l_{c}": [known[-1].as_py() if len(known) else None]}
            return pa.table(out, pa.schema([("device_id", pa.int64()), ("_b", pa.int64()), *((f"_{x}_{c}", pa.string()) for c in LABELS for x in "fl")]))

        marks = blocks.applyInArrow(mark, f"device_id long, _b long, {kinds}")
        spans = _edges(spans.join(marks, ["device_id", "_b"], "left"), ["device_id"], LABELS)
    names = schema.fieldNames()

    def grid(key: tuple, some: pa.Table, span: pa.Table) -> pa.Table:
        if not span.num_rows:  # only a neighbour's reach
            return pa.table({n: pa.array([], t) for n, t in kinds_of}, pa.schema(kinds_of))
        start, lo, hi = key[1].as_py() * BLOCK, span.column("lo")[0].as_py(), span.column("hi")[0].as_py()
        t = np.arange(max(lo, start - reach), min(hi, start + BLOCK - 1 + reach) + 1)
        place = np.full(len(t), -1)
        at, times = _firsts(some)
        place[times - t[0]] = at
        where = pa.array(place, pa.int64(), mask=place < 0)
        out = {c: some.column(c).take(where) for c in some.column_names if c not in ("_b", "_own")}
        out |= {"device_id": pa.array(np.full(len(t), key[0].as_py())), "t": pa.array(t)}
        if labels:
            for c in LABELS:
                every = pa.chunked_array([span.column(f"_i_{c}").combine_chunks(), out[c].combine_chunks(), span.column(f"_o_{c}").combine_chunks()], pa.string()).combine_chunks()
                known = np.asarray(every.is_valid())
                before = np.maximum.accumulate(np.where(known, np.arange(len(every)), -1))
                after = np.minimum.accumulate(np.where(known, np.arange(len(every)), len(every))[::-1])[::-1]
                use = np.where(before >= 0, before, after)[1:-1]
                out[c] = every.take(pa.array(use, pa.int64(), mask=use >= len(every)))
        own = (t >= start) & (t < start + BLOCK)
        out = run(pa.table(out), own, span) if run else pa.table(out).filter(pa.array(own))
        return out.select(names).cast(pa.schema(kinds_of))

    kinds_of = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
    return _beside(blocks, spans, ["device_id", "_b"], grid, schema)


def on_grid(raw: DataFrame, labels: bool = False) -> DataFrame:
    """to_grid(dedup_keep_first(raw)), with labels filled if asked for; rows are dealt once."""
    return gridded(raw, StructType([StructField(f.name, f.dataType) for f in raw.schema.fields]), labels=labels)


def mask_bounds(df: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).between(*BOUNDS[c]), F.col(c)) for c in channels})


def _inside(rows: pa.Table, c: str) -> tuple[np.ndarray, int | np.ndarray]:
    """A channel with NaN where it is null or not credible, and where it is not credible."""
    y, (lo, hi) = _doubles(rows, c), BOUNDS[c]
    good = (y >= lo) & (y <= hi)
    return np.where(good, y, np.nan), np.asarray(rows.column(c).is_valid()) & ~good


def _medians(y: np.ndarray, span: int = HAMPEL_SPAN, least: int = HAMPEL_LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The centred median of `span` seconds and that of the distances to it; NaN with fewer than `least` readings."""
    med = pd.Series(y).rolling(span, center=True, min_periods=least).median()
    return med.to_numpy(), (pd.Series(y) - med).abs().rolling(span, center=True, min_periods=least).median().to_numpy()


def _outliers(y: np.ndarray, level: float | None, c: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """med, sigma (with a floor by the device's level), and whether the distance to med is beyond five sigma."""
    med, mad = _medians(y)
    sigma = np.maximum(1.4826 * mad, max(0.2, 0.02 * (1.0 if level is None else level)))
    return med, sigma, np.abs(y - med) > HAMPEL_SIGMAS * sigma


def _jumps(y: np.ndarray, c: str) -> np.ndarray:
    """Whether the change from the second before is beyond the limit, or the next one's is."""
    jump = np.append(False, np.abs(np.diff(y)) > RATES[c])
    return jump | np.append(jump[1:], False)


def levels(channels: list[str]) -> Callable:
    """Per device level_ of each channel: the median of credible readings that aren't zero, by size. Blocks count equal values first."""

    def count(key: tuple, own: pa.Table) -> pa.Table:
        own = own.filter(own.column("_own"))
        own = own.take(pa.array(_firsts(own)[0]))
        found = []
        for i, c in enumerate(channels):
            y = np.abs(_inside(own, c)[0])
            found.append((i, *np.unique(y[y > 1e-6], return_counts=True)))
        of = np.concatenate([np.full(len(v), i) for i, v, _ in found])
        columns = [np.full(len(of), key[0].as_py()), of, np.concatenate([v for _, v, _ in found]), np.concatenate([n for _, _, n in found])]
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.int64()), strict=True)], ["device_id", "of", "v", "n"])

    def run(blocks) -> DataFrame:
        medians = blocks.applyInArrow(count, "device_id long, of int, v double, n long").groupBy("device_id", "of").agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("m"))
        return medians.groupBy("device_id").agg(*(F.max(F.when(F.col("of") == i, F.col("m"))).alias(f"level_{c}") for i, c in enumerate(channels)))

    return run


#: Seconds on either side of a block that its medians of medians look at.
REACH = 2 * (HAMPEL_SPAN // 2)


def _seconds(channels: list[str], *names: str) -> StructType:
    return StructType.fromDDL(", ".join(["device_id long", "t long", *(f"{n}_{c} {kind}" for c in channels for n, kind in (x.split() for x in names))]))


def hampel_flags(raw: DataFrame, channels: list[str]) -> DataFrame:
    """Of each second of raw's grid med_, sigma_ and is_outlier_ of each channel, not credible readings taken for missing: whether the
    distance to the rolling median is beyond five rolling deviations, which have a floor. Without a deviation nothing is one."""

    def run(rows: pa.Table, own: np.ndarray, span: pa.Table) -> pa.Table:
        out = {"device_id": rows.column("device_id").filter(pa.array(own)), "t": rows.column("t").filter(pa.array(own))}
        for c in channels:
            med, sigma, flag = _outliers(_inside(rows, c)[0], span.column(f"level_{c}")[0].as_py(), c)
            out |= {f"med_{c}": _nullable(med[own]), f"sigma_{c}": _nullable(sigma[own]), f"is_outlier_{c}": pa.array(flag[own])}
        return pa.table(out)

    return gridded(_narrow(raw, channels), _seconds(channels, "med double", "sigma double", "is_outlier boolean"), run, REACH, by_device=levels(channels))


def _narrow(raw: DataFrame, channels: list[str]) -> DataFrame:
    return raw.select("device_id", "t", "arrival_seq", *channels)


def rate_flags(raw: DataFrame, channels: list[str]) -> DataFrame:
    """Of each second of raw's grid is_jump_ of each channel: the change from the second before is beyond the limit, or the next one's
    is. Not credible readings are taken for missing."""

    def run(rows: pa.Table, own: np.ndarray, span: pa.Table) -> pa.Table:
        out = {"device_id": rows.column("device_id").filter(pa.array(own)), "t": rows.column("t").filter(pa.array(own))}
        return pa.table(out | {f"is_jump_{c}": pa.array(_jumps(_inside(rows, c)[0], c)[own]) for c in channels})

    return gridded(_narrow(raw, channels), _seconds(channels, "is_jump boolean"), run, 2)


def _filled(df: DataFrame, channels: list[str], by: list[str], fill: Callable[..., np.ndarray], tenths: DataFrame | None = None) -> DataFrame:
    """df, a row for each device and second, with missing readings of the channels as `fill` makes them of their times and the times
    and values of the nearest readings within `by` (NaN where there is none). tenths: device_id and _gap_ of each channel, whether
    it is rounded to a tenth.

    Rows are dealt once, by `by` and block of time, and that exchange is read twice: for each block's first and last readings, which meet by
    `by`, and for the rows themselves."""
    rows = df.withColumn("_b", F.floor(F.col("t") / BLOCK))
    blocks, keys, names = rows.groupBy(*by, "_b"), [*by, "_b"], df.columns
    ends = [f"{x}_{c}" for c in channels for x in "fl"]
    shape = StructType([*(rows.schema[k] for k in keys), *(StructField(f"_{e}", StructType.fromDDL("at long, v double")) for e in ends)])
    made = to_arrow_schema(shape)

    def mark(key: tuple, some: pa.Table) -> pa.Table:
        t = some.column("t").to_numpy()
        out = {k: [x.as_py()] for k, x in zip(keys, key, strict=True)}
        for c in channels:
            y = _doubles(some, c)
            have = np.flatnonzero(~np.isnan(y))
            for x, at in (("f", np.argmin), ("l", np.argmax)):
                i = have[at(t[have])] if len(have) else None
                out[f"_{x}_{c}"] = [None if i is None else {"at": int(t[i]), "v": float(y[i])}]
        return pa.table(out, made)

    edges = _edges(blocks.applyInArrow(mark, shape), by, channels)
    if rounds := tenths is not None:
        edges = edges.join(tenths, "device_id")

    def run(key: tuple, some: pa.Table, edge: pa.Table) -> pa.Table:
        some = some.take(pa.array(np.argsort(some.column("t").to_numpy())))
        t = some.column("t").to_numpy()
        for c in channels:
            y = _doubles(some, c)
            gap = np.flatnonzero(np.isnan(y))
            whole = rounds and edge.column(f"_gap_{c}")[0].as_py()
            if not len(gap) and not whole:
                continue
            old, new = (edge.column(f"_{x}_{c}")[0].as_py() or {"at": 0, "v": np.nan} for x in "io")
            every, times = np.concatenate(([old["v"]], y, [new["v"]])), np.concatenate(([old["at"]], t, [new["at"]]))
            have, at = ~np.isnan(every), np.arange(len(every))
            before = np.maximum.accumulate(np.where(have, at, 0))[gap + 1]
            after = np.minimum.accumulate(np.where(have, at, len(every) - 1)[::-1])[::-1][gap + 1]
            with np.errstate(invalid="ignore", divide="ignore"):
                y[gap] = fill(t[gap], times[before], every[before], times[after], every[after])
            some = some.set_column(some.column_names.index(c), c, _nullable(np.rint(y * 10) / 10 if whole else y))
        return some.select(names)

    return _beside(blocks, edges, keys, run, StructType([StructField(f.name, DoubleType() if f.name in channels else f.dataType) for f in df.schema.fields]))


def condition_fill(df: DataFrame, channels: str | list[str], tenths: DataFrame | None = None) -> DataFrame:
    """Missing readings take the nearest valid ones of the same condition, weighted by closeness. Of one channel, given by its
    name, the result is added as `filled`; several are replaced."""
    if isinstance(channels, str):
        return condition_fill(df.withColumn("filled", F.col(channels)), ["filled"])

    def fill(t, at, v, later, w):
        wp, wn = 1.0 / (t - at), 1.0 / (later - t)
        return np.where(np.isnan(v), w, np.where(np.isnan(w), v, (wp * v + wn * w) / (wp + wn)))

    return _filled(df, channels, ["device_id", "operating_condition"], fill, tenths)


def linear_fill(df: DataFrame, channels: str | list[str], tenths: DataFrame | None = None) -> DataFrame:
    """Missing readings lie on a line between their neighbours; the edges hold the nearest reading. One channel as above."""
    if isinstance(channels, str):
        return linear_fill(df.withColumn("filled", F.col(channels)), ["filled"])

    def fill(t, at, v, later, w):
        return np.where(np.isnan(v), w, np.where(np.isnan(w), v, v + (t - at) / (later - at) * (w - v)))

    return _filled(df, channels, ["device_id"], fill, tenths)


def report(raw: DataFrame) -> DataFrame:
    """Per device, before cleaning: rows, duplicates, gaps on the grid, late readings, missing and impossible values, completeness,
    status. One pass gives the first arrival of each time and how many came."""
    first = raw.groupBy("device_id", "t").agg(F.min_by(F.struct(*CHANNELS), "arrival_seq").alias("r"), F.count(F.lit(1)).alias("_c")).select("device_id", "t", "r.*", "_c")
    bad = sum((F.when(~F.col(c).between(*BOUNDS[c]), 1).otherwise(0) for c in CHANNELS), F.lit(0))
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in CHANNELS), F.lit(0))
    whole = F.avg(F.when(nulls == 0, 1.0).otherwise(0.0))
    kept = first.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.max("t") - F.min("t") + 1 - F.count(F.lit(1))).alias("n_gaps"),
        F.sum(bad).alias("n_bad"), F.sum(nulls).alias("n_missing"), F.round(whole, 6).alias("completeness"), (F.sum("_c") - F.count(F.lit(1))).alias("n_duplicates"),
    )
    return kept.join(out_of_order(raw), "device_id").withColumn("status", status(F.col("completeness")))


def status(completeness: Column) -> Column:
    return F.when(completeness >= 0.99, "ok").otherwise("degraded")


def masked(raw: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    """First arrivals on the grid, labels filled, impossible values and outliers of each channel masked; n_out, how many of a row
    were."""

    def run(rows: pa.Table, own: np.ndarray, span: pa.Table) -> pa.Table:
        n_out = np.zeros(len(own), np.int32)
        for c in channels:
            y, bad = _inside(rows, c)
            out = _outliers(y, span.column(f"level_{c}")[0].as_py(), c)[2] | _jumps(y, c)
            n_out += bad.astype(np.int32) + out
            rows = rows.set_column(rows.column_names.index(c), c, _nullable(np.where(out, np.nan, y)))
        return rows.append_column("n_out", pa.array(n_out)).filter(pa.array(own))

    schema = StructType([StructField(f.name, DoubleType() if f.name in channels else f.dataType) for f in raw.schema.fields]).add("n_out", IntegerType())
    return gridded(raw, schema, run, REACH, labels=True, by_device=levels(channels))


def clean(raw: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    """The whole chain for the channels given: masked, gaps imputed, and channels of a device that had any rounded to a tenth.

    Only devices that lack all readings of a channel in some condition, but not in all, need lines between neighbours too."""
    df = written(masked(raw, channels))
    cells = df.groupBy("device_id", "operating_condition").agg(*(F.count(c).alias(c) for c in channels), F.count(F.lit(1)).alias("_n"))
    lines = F.lit(False)
    for c in channels:
        lines = lines | ((F.min(c) == 0) & (F.max(c) > 0))
    gaps = written(cells.groupBy("device_id").agg(*(F.max(F.col(c) < F.col("_n")).alias(f"_gap_{c}") for c in channels), lines.alias("_lines")))
    tenths, some = gaps.drop("_lines"), gaps.where("_lines").select("device_id")
    if some.isEmpty():
        return condition_fill(df.drop("n_out"), channels, tenths)
    rest, lined = (df.drop("n_out").join(some, "device_id", how) for how in ("left_anti", "left_semi"))
    return condition_fill(rest, channels, tenths).unionByName(linear_fill(condition_fill(lined, channels), channels, tenths))


def clean_report(raw: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    """Per device the counters of the whole chain: rows in and out, duplicates, late readings, gaps, values imputed, values masked,
    and the share of rows out that lack nothing."""
    df = masked(raw, channels)
    n_null = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in channels), F.lit(0))
    # imputing leaves a channel empty only where the device has no reading of it at all
    empty = sum((F.when(F.count(c) == 0, 1).otherwise(0) for c in channels), F.lit(0))
    out = df.groupBy("device_id").agg(F.count(F.lit(1)).alias("total_out"), F.sum(n_null).alias("missing_filled"), F.sum("n_out").alias("outliers_removed"), F.when(empty == 0, 1.0).otherwise(0.0).alias("completeness"))
    seen = raw.groupBy("device_id", "t").agg(F.count(F.lit(1)).alias("c")).groupBy("device_id").agg(F.sum("c").alias("total_in"), (F.sum("c") - F.count(F.lit(1))).alias("duplicates_removed"), F.count(F.lit(1)).alias("_d"))
    both = out.join(seen, "device_id").join(out_of_order(raw), "device_id").withColumnRenamed("n_out_of_order", "out_of_order_fixed")
    return both.withColumn("gaps_filled", F.col("total_out") - F.col("_d")).drop("_d").withColumn("status", status(F.col("completeness")))
