"""Derived physical features, as Column expressions over the contract's channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Magnus constants over water, pipe hydraulics, heat capacity of water.
MAGNUS_A, MAGNUS_B = 17.62, 243.12
STATIC_KPA, RESISTANCE, RATED_FLOW = 120.0, 2.2, 8.0
WATER_KJ = 4.186


def ordered():
    """Readings of a device in time order."""
    return Window.partitionBy("device_id").orderBy("t")


def trailing(n: int):
    return ordered().rowsBetween(-(n - 1), 0)


def centred(n: int):
    return ordered().rowsBetween(-(n // 2), n // 2)


def dew_point(temp: Column, humidity: Column) -> Column:
    g = F.ln(F.greatest(F.lit(1.0), F.least(F.lit(100.0), humidity)) / 100.0) + MAGNUS_A * temp / (MAGNUS_B + temp)
    return F.when(humidity.isNotNull(), MAGNUS_B * g / (MAGNUS_A - g))


def dew_margin(temp: Column | None = None, humidity: Column | None = None) -> Column:
    temp = F.col("cabinet_temp") if temp is None else temp
    return temp - dew_point(temp, F.col("cabinet_humidity") if humidity is None else humidity)


def pq_offset() -> Column:
    """Relative distance of the pressure from what the flow explains."""
    expected = STATIC_KPA + RESISTANCE * F.col("flow_rate") * F.col("flow_rate")
    return (F.col("pressure") - expected) / expected


def heating_rate_per_power(span: int = 600) -> Column:
    rate = (F.col("furnace_temp") - F.lag("furnace_temp", span).over(ordered())) / (span / 60.0)
    return F.when(F.col("electric_power") >= 500, F.try_divide(rate, F.col("electric_power")))


#: Readings of a device that one task takes at a time.
BLOCK = 4096


def running(df: DataFrame, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """df with each named sum over a device's readings up to and with each. Blocks of time are summed first, so a device's
    readings are spread over tasks; what meets in one is a row for each block."""
    df = df.withColumn("_b", F.floor(F.col("t") / block))
    whole = df.groupBy("device_id", "_b").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = Window.partitionBy("device_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("device_id", "_b", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    here = Window.partitionBy("device_id", "_b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(whole, ["device_id", "_b"]).withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in sums.items()})
    return out.drop("_b", *(f"_{n}" for n in sums))


def seasonal_inlet_threshold(df: DataFrame, span: int = 86400, least: int = 3600) -> DataFrame:
    """df with `threshold`: the inlet limit raised by what the trailing day's mean lies above 28; null with too few readings.

    The day's sum is the running sum less that of the reading a day before, so no frame of 86,400 readings is summed anew."""
    sums = running(df, {"_k": F.lit(1), "_n": F.when(F.col("inlet_temp").isNotNull(), 1).otherwise(0), "_s": F.coalesce("inlet_temp", F.lit(0.0))})
    old = sums.select("device_id", (F.col("_k") + span).alias("_k"), F.col("_n").alias("_n0"), F.col("_s").alias("_s0"))
    both = sums.join(old, ["device_id", "_k"], "left")
    n, total = F.col("_n") - F.coalesce("_n0", F.lit(0)), F.col("_s") - F.coalesce("_s0", F.lit(0.0))
    limit = F.when(n >= least, 35.0 + F.greatest(F.lit(0.0), total / n - 28.0))
    return both.withColumn("threshold", limit).drop("_k", "_n", "_s", "_n0", "_s0")


def halo_blocks(df: DataFrame, k: str, before: int, after: int = 0, block: int = BLOCK) -> DataFrame:
    """df with `_b`, the blocks of the running number k that need each row: its own, and those that look back or ahead to it.
    A window over (device_id, _b) sees whole frames for the rows whose own block it is; `_own` marks those."""
    lo, hi = F.floor((F.col(k) - after) / block), F.floor((F.col(k) + before) / block)
    return df.withColumn("_b", F.explode(F.sequence(F.greatest(F.lit(0), lo), hi))).withColumn("_own", F.col("_b") == F.floor(F.col(k) / block))


def rolling_detrended_std(df: DataFrame, y: str, span: int = 60, least: int = 10) -> DataFrame:
    """device_id, t and osc of the readings that have y: the population deviation of what a line leaves of the last `span` such
    readings, by place; null with fewer than `least`. Sums of a block grow row by row, and a frame is the difference of two."""
    have = running(df.where(F.col(y).isNotNull()).select("device_id", "t", F.col(y).alias("y")), {"k": F.lit(1)}).withColumn("k", F.col("k") - 1)
    rows = halo_blocks(have, "k", span)
    w = Window.partitionBy("device_id", "_b").orderBy("k")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    # places and values from the block's first on keep the sums small
    rows = rows.withColumns({"_x": (F.row_number().over(w) - 1).cast("double"), "_y": F.col("y") - F.first("y").over(up)})
    grown = rows.withColumns({"_sy": F.sum("_y").over(up), "_sxy": F.sum(F.col("_x") * F.col("_y")).over(up), "_syy": F.sum(F.col("_y") * F.col("_y")).over(up)})
    past = {c: F.col(c) - F.coalesce(F.lag(c, span).over(w), F.lit(0.0)) for c in ("_sy", "_sxy", "_syy")}
    f = grown.withColumns(past).where("_own").withColumn("_n", F.least(F.col("k") + 1, F.lit(span)).cast("double"))
    mid = F.col("_x") - (F.col("_n") - 1) / 2
    sxy, syy = F.col("_sxy") - mid * F.col("_sy"), F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("_n")
    sxx = F.col("_n") * (F.col("_n") * F.col("_n") - 1) / 12
    left = F.sqrt(F.greatest(F.lit(0.0), (syy - sxy * sxy / sxx) / F.col("_n")))
    return f.select("device_id", "t", F.when(F.col("_n") >= least, left).alias("osc"))


def expected_heat_kw(flow: Column, delta: Column) -> Column:
    return WATER_KJ * flow * delta


def expected_delta_t(heat_kw: Column, flow: Column) -> Column:
    return F.least(F.lit(60.0), heat_kw / (WATER_KJ * F.greatest(flow, F.lit(0.3))))


def heat_imbalance(heat_kw: Column, flow: Column, actual: Column) -> Column:
    e = expected_delta_t(heat_kw, flow)
    return F.abs(actual - e) / F.greatest(e, F.lit(1.0))


def _fit(name: str, y: str, x: str, w) -> Column:
    c = F.expr(f"{name}({y}, {x})")
    return c if w is None else c.over(w)


def slope(y: str, x: str = "t", w=None) -> Column:
    """Least-squares slope within a window, or within a group where w is None."""
    return _fit("regr_slope", y, x, w)


def detrended_std(y: str, x: str = "t", w=None, least: int = 10) -> Column:
    """Population deviation of what a line leaves; null with fewer than `least` readings."""
    n, syy, sxy, sxx = (_fit(f, y, x, w) for f in ("regr_count", "regr_syy", "regr_sxy", "regr_sxx"))
    return F.when(n >= least, F.sqrt(F.greatest(F.lit(0.0), (syy - sxy * sxy / sxx) / n)))


def swing(y: str, x: str = "t") -> Column:
    """detrended_std of a group; with fewer than ten readings their plain population deviation."""
    return F.coalesce(detrended_std(y, x), F.stddev_pop(y))


def trend_eta(current: Column, slope_: Column, threshold: float, horizon: float) -> Column:
    """Seconds until a rising trend meets the threshold: 0 if it has, null if not within the horizon."""
    eta = (threshold - current) / slope_
    return F.when(current >= threshold, 0.0).when((slope_ > 1e-6) & (eta > 0) & (eta <= horizon), eta)


def sampled_windows(df: DataFrame, span: int, every: int) -> DataFrame:
    """Each reading once for every window of `span` seconds that holds it and ends `due` seconds in, due + 1 a multiple of `every`.

    A sliding frame is computed anew for every row; where only each `every`-th row counts, grouping by `due` costs
    span / every rows for each reading, combines before the shuffle and spreads one device over many tasks.
    """
    first = F.ceil((F.col("t") + 1) / every).cast("bigint")
    last = F.floor((F.col("t") + span) / every).cast("bigint")
    return df.withColumn("due", F.explode(F.sequence(first, last))).withColumn("due", F.col("due") * every - 1)


def condensation(df: DataFrame, span: int = 600, every: int = 60, limit: float = 3.0, horizon: float = 600.0) -> DataFrame:
    """device_id, t, margin, at_risk, eta and predicted at every minute: the dew margin, whether it is below the limit, and when the
    slope of the last `span` margins (ten at least) takes it there, if it falls and isn't there yet."""
    w = sampled_windows(df.select("device_id", "t", dew_margin().alias("m")), span, every).groupBy("device_id", "due").agg(slope("m").alias("s"), F.max_by("m", "t").alias("margin"), F.count("m").alias("n"), F.max("t").alias("t"))
    at_risk = F.col("margin") < limit
    eta = F.when((F.col("s") < 0) & (F.col("n") >= 10) & ~at_risk, (F.col("margin") - limit) / -F.col("s"))
    return w.where("t = due").select("device_id", "t", "margin", at_risk.alias("at_risk"), eta.alias("eta"), F.coalesce(eta <= horizon, F.lit(False)).alias("predicted"))
