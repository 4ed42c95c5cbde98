"""Deterministic scores over the series: z-scores, difference energy, fusion, routing and backtests.

Neural scorers plug in as functions of a DataFrame that add a score column; none is shipped, and no accuracy is claimed for
the plain ones here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwatch.functions.features import halo_blocks, ordered, trailing


def zscore(df: DataFrame, channel: str) -> DataFrame:
    base = df.groupBy("device_id").agg(F.avg(channel).alias("_m"), F.stddev_samp(channel).alias("_s"))
    return df.join(base, "device_id").withColumn("z", F.try_divide(F.col(channel) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def difference_energy(df: DataFrame, channels: list[str], span: int) -> DataFrame:
    """Mean absolute change over the channels, the first reading taking the second's, then a trailing mean."""
    step = sum((F.abs(F.col(c) - F.lag(c).over(ordered())) for c in channels), F.lit(0.0)) / len(channels)
    raw = df.withColumn("_e", step)
    raw = raw.withColumn("_e", F.coalesce("_e", F.lead("_e").over(ordered())))
    return raw.withColumn("energy", F.avg("_e").over(trailing(span))).drop("_e")


def fuse(first: Column, second: Column) -> Column:
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return 0.5 * clip(first / 3.0) + 0.5 * clip(-second)


def route(score: Column, n_columns: Column, horizon: Column) -> Column:
    return F.when((score > 0.6) | (n_columns > 3) | (horizon > 600), "precise").otherwise("fast")


def persistence_backtest(df: DataFrame, channel: str, window: int, horizon: int) -> DataFrame:
    """Error of holding the last value over windows that don't overlap, by device: grouped, not looped."""
    block = window + horizon
    w = Window.partitionBy("device_id", F.floor(F.col("t") / block))
    last = F.max(F.when(F.col("t") % block == window - 1, F.col(channel))).over(w)
    scored = df.withColumn("_last", last).where((F.col("t") % block >= window) & F.col("_last").isNotNull())
    return scored.groupBy("device_id").agg(F.avg(F.abs(F.col(channel) - F.col("_last")) / F.greatest(F.abs(channel), F.lit(1e-6))).alias("mape"))


def zscore_pop(df: DataFrame, channel: str) -> DataFrame:
    """The form with the population deviation and a millionth added, as scorers of tensors use it."""
    base = df.groupBy("device_id").agg(F.avg(channel).alias("_m"), F.stddev_pop(channel).alias("_s"))
    return df.join(base, "device_id").withColumn("z", (F.col(channel) - F.col("_m")) / (F.col("_s") + 1e-6)).drop("_m", "_s")


def window_tensors(df: DataFrame, channels: list[str], width: int) -> DataFrame:
    """device_id, t and x (width arrays of the channels' values) of each reading that `width` readings end with.

    The frame is held once for each row, so a scorer gets its windows in Arrow batches and no device is gathered."""
    rows = halo_blocks(df.select("device_id", "t", *channels), "t", width - 1)
    w = Window.partitionBy("device_id", "_b").orderBy("t").rowsBetween(-(width - 1), 0)
    out = rows.withColumn("x", F.collect_list(F.array(*channels)).over(w))
    return out.where(F.col("_own") & (F.size("x") == width)).select("device_id", "t", "x")


def training_pairs(df: DataFrame, channel: str, window: int, horizon: int, stride: int, keep: int = 1) -> DataFrame:
    """device_id, start, x (every keep-th reading of the window) and y (the horizon's readings less the window's last).

    Windows start at each multiple of stride and lie whole within the series, with one reading to spare as the range excludes it."""
    span = window + horizon
    first, last = F.ceil((F.col("t") - span + 1) / stride), F.floor(F.col("t") / stride)
    placed = df.select("device_id", "t", F.col(channel).alias("v"), F.explode(F.sequence(F.greatest(F.lit(0), first), last)).alias("start")).withColumn("start", F.col("start") * stride)
    ends = df.groupBy("device_id").agg((F.max("t") + 1).alias("n"))
    at = F.col("t") - F.col("start")
    seq = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(at.alias("i"), F.col("v").alias("v"))))), lambda z: z["v"])
    g = placed.groupBy("device_id", "start").agg(seq((at < window) & (at % keep == 0)).alias("x"), seq(at >= window).alias("_y"), F.max(F.when(at == window - 1, F.col("v"))).alias("_base"), F.count(F.lit(1)).alias("_n"))
    whole = g.where(F.col("_n") == span).join(ends, "device_id").where(F.col("start") < F.col("n") - span)
    return whole.select("device_id", "start", "x", F.transform("_y", lambda v: v - F.col("_base")).alias("y"))


def decomposed(df: DataFrame, channel: str, period: int, span: int = 120) -> DataFrame:
    """df with trend (the mean of `span` readings around), seasonal (the mean of what the trend leaves at each place of the period) and
    resid. A place's mean is summed in the order of time: in that of a shuffle its last bits would differ from run to run."""
    w = ordered().rowsBetween(-(span // 2), span - span // 2 - 1)
    out = df.withColumn("trend", F.avg(channel).over(w)).withColumn("_k", F.col("t") % period)
    place = Window.partitionBy("device_id", "_k").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumn("seasonal", F.avg(F.col(channel) - F.col("trend")).over(place)).withColumn("resid", F.col(channel) - F.col("trend") - F.col("seasonal")).drop("_k")


def forecast_summary(series: Column) -> Column:
    """End, greatest and least of a forecast and every n // 30-th point of it, to two decimals; null for an empty one."""
    step = F.greatest(F.lit(1), F.floor(F.size(series) / 30))
    two = lambda x: F.bround(x, 2)
    brief = F.transform(F.filter(series, lambda x, i: i % step == 0), two)
    return F.when(F.size(series) > 0, F.struct(two(F.element_at(series, -1)).alias("end"), two(F.array_max(series)).alias("max"), two(F.array_min(series)).alias("min"), brief.alias("series")))


def routed(track: Column, precise: Column, fast: Column, horizon: Column, limit: int = 600) -> Column:
    """The forecast a case gets: the precise one where it is wanted and there; else the fast one, cut to its reach and marked."""
    degraded = (track == "precise") & precise.isNull()
    kept = F.when(degraded, F.least(horizon, F.lit(limit))).otherwise(horizon)
    used = F.slice(F.when((track == "precise") & ~degraded, precise).otherwise(fast), F.lit(1), kept.cast("int"))
    return F.struct(F.when(degraded, "fast_degraded").otherwise(track).alias("track"), used.alias("series"), kept.alias("horizon"), degraded.alias("degraded"))


def archived(windows: DataFrame, limit: float = 0.6) -> DataFrame:
    """windows (device_id, window_id, n_alerts, score, n) with filtered (no alert and a low score) and ratio, the share of readings that
    were filtered up to there."""
    out = windows.withColumn("filtered", (F.col("n_alerts") == 0) & (F.coalesce("score", F.lit(0.0)) < limit))
    up = Window.partitionBy("device_id").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("ratio", F.sum(F.when(F.col("filtered"), F.col("n")).otherwise(0)).over(up) / F.sum("n").over(up))


class Scorer:
    """What a model that scores readings gives: the readings a score needs, the limit it is held against, how often it is taken, and
    a function of a DataFrame with window tensors (`window_tensors`) that adds `score`. Models plug in; none is shipped."""

    window, threshold, stream_stride = 60, 0.6, 1

    def score(self, windows: DataFrame) -> DataFrame:
        raise NotImplementedError


class DistanceScorer(Scorer):
    """A plain stand-in: the root mean square of the window's last values, meant for z-scores. Not any published model."""

    def score(self, windows: DataFrame) -> DataFrame:
        last = F.element_at("x", -1)
        return windows.withColumn("score", F.sqrt(F.aggregate(last, F.lit(0.0), lambda a, v: a + v * v) / F.size(last)))


class Forecaster:
    """What a model that looks ahead gives: the readings it needs, its reach, and a function of training_pairs-like rows (device_id,
    t, x) that adds `forecast`, an array."""

    window, horizon = 600, 600

    def forecast(self, windows: DataFrame) -> DataFrame:
        raise NotImplementedError


class Persistence(Forecaster):
    """Holds the last value."""

    def forecast(self, windows: DataFrame) -> DataFrame:
        return windows.withColumn("forecast", F.array_repeat(F.get(F.element_at("x", -1), F.lit(0)), self.horizon))


class ArrowForecaster(Forecaster):
    """A model that runs in tasks: `predict` takes an array of contexts, one in each row, and gives a row of `horizon` values for
    each. It sees Arrow batches, never a device's whole series."""

    def __init__(self, window: int = 600, horizon: int = 600):
        self.window, self.horizon = window, horizon

    def predict(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def forecast(self, windows: DataFrame) -> DataFrame:
        """windows, whose x holds `window` values in order of time, with forecast. A missing value makes the forecast null."""
        model, names = self, windows.columns
        at = names.index("x")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, model.window))
                whole = ~np.isnan(x).any(axis=1)
                out: list = [None] * b.num_rows
                for i, y in zip(np.flatnonzero(whole), model.predict(x[whole]) if whole.any() else (), strict=True):
                    out[i] = y
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[*names, "forecast"])

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields]
        return windows.mapInArrow(run, ", ".join([*fields, "forecast array<double>"]))


class HoldLast(ArrowForecaster):
    """The last value goes on."""

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.repeat(x[:, -1:], self.horizon, axis=1)


class Trend(ArrowForecaster):
    """The last value goes on along the least-squares slope of its context: what stands in when no model does."""

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
        slope = (x - x.mean(axis=1, keepdims=True)) @ at / (at @ at)
        return x[:, -1:] + slope[:, None] * np.arange(1, self.horizon + 1)[None, :]


def backtest(df: DataFrame, channel: str, model: ArrowForecaster, n_eval: int = 10) -> DataFrame:
    """device_id, origin, step, forecast, actual and error (relative, over 1e-6 at least) of the last n_eval horizons of each device,
    which don't overlap; an origin is the first reading that the model doesn't see. Origins without a whole context (a reading for
    each second, none missing) drop out. Each reading goes to the contexts that hold it, and those are grouped by device and origin."""
    w, h = model.window, model.horizon
    ends = df.groupBy("device_id").agg((F.max("t") + 1).alias("n"))
    rows = df.select("device_id", "t", F.col(channel).cast("double").alias("v")).join(ends, "device_id")
    first, last = F.greatest(F.lit(0), F.ceil((F.col("n") - F.col("t") - w) / h) - 1), F.least(F.lit(n_eval - 1), F.ceil((F.col("n") - F.col("t")) / h) - 2)
    held = rows.where(first <= last).withColumn("k", F.explode(F.sequence(first, last))).withColumn("origin", F.col("n") - h * (F.col("k") + 1))
    x = F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda p: p["v"])
    contexts = held.groupBy("device_id", "origin").agg(x.alias("x"), F.count(F.lit(1)).alias("c"), F.min("t").alias("lo")).where((F.col("c") == w) & (F.col("lo") == F.col("origin") - w)).select("device_id", "origin", "x")
    steps = model.forecast(contexts).select("device_id", "origin", F.posexplode("forecast").alias("step", "forecast")).withColumn("t", F.col("origin") + F.col("step"))
    actual = df.select("device_id", "t", F.col(channel).cast("double").alias("actual"))
    error = F.abs(F.col("forecast") - F.col("actual")) / F.greatest(F.abs("actual"), F.lit(1e-6))
    return steps.join(actual, ["device_id", "t"]).select("device_id", "origin", "step", "forecast", "actual", error.alias("error"))


def errors_by_step(df: DataFrame, channel: str, models: dict[str, ArrowForecaster], n_eval: int = 10) -> DataFrame:
    """method, device_id, step, n and mape (a share) of each model over the same origins."""
    every = [backtest(df, channel, m, n_eval).withColumn("method", F.lit(name)) for name, m in models.items()]
    return reduce(DataFrame.unionByName, every).groupBy("method", "device_id", "step").agg(F.count("error").alias("n"), F.avg("error").alias("mape"))


class ArrowScorer(Scorer):
    """A model of windows that runs in tasks: `predict` takes an array (window, reading, channel) and gives a score for each window. A
    block of a device's readings travels once, with what its first windows reach back to, and windows are views of it."""

    def predict(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def scores(self, df: DataFrame, channels: list[str]) -> DataFrame:
        """device_id, t and score of each reading that `window` readings end with, of a series with a row for each second. Missing
        values reach the model as nan, and a score that is nan is null."""
        model, width = self, self.window

        def run(block: pa.Table) -> pa.Table:
            block = block.sort_by("t")
            values = np.stack([block[c].to_numpy().astype(np.float64) for c in channels], axis=1)
            own = block["_own"].to_numpy()[width - 1 :]
            if len(values) < width or not own.any():
                ids, t, score = block["device_id"].slice(0, 0), block["t"].slice(0, 0), np.zeros(0)
            else:
                x = np.lib.stride_tricks.sliding_window_view(values, width, axis=0).transpose(0, 2, 1)[own]
                keep = pa.array(np.flatnonzero(own) + width - 1)
                ids, t, score = block["device_id"].take(keep), block["t"].take(keep), model.predict(x)
            return pa.table({"device_id": ids, "t": t, "score": pa.array(score, pa.float64(), from_pandas=True)})

        rows = halo_blocks(df.select(F.col("device_id").cast("long").alias("device_id"), F.col("t").cast("long").alias("t"), *channels), "t", width - 1)
        return rows.groupBy("device_id", "_b").applyInArrow(run, "device_id long, t long, score double")


class WindowEnergy(ArrowScorer):
    """A plain stand-in: the root mean square of all of a window's values."""

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt((x * x).mean(axis=(1, 2)))
