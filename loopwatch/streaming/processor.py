"""The live path as one stateful query: what each reading of a device shows, and one order a session.

`prepared` adds, by expressions, what a reading shows on its own. `LiveProcessor` keeps typed state for each device: the last
readings (time, dew margin, condition, high flag), the last pressures that were read, the throttled score, the time of the last
change of condition, the running diagnosis, and whether an order was issued. So rows of a device must arrive in order of t from
batch to batch; within a batch they are put in order. Readings without a device take no part. State is of bounded size, sits in
RocksDB and survives restarts through the query's checkpoint: a restart issues no second order.

A new session is a new key and so starts with an empty state. History that only fills the state (a preload) comes as the
query's initial state: its readings count for windows and give no rows.

A diagnosis takes `takes` seconds of event time; the first reading at or after its end finds it finished. While one runs none
is started, nor within `gap` seconds of the last start. One that fails (`answers` false at its start) may be followed by
another; the first that succeeds issues the order and is the last.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loopwatch.functions.features import dew_margin
from loopwatch.operators.rules import MARGIN, OSC, row_alerts, row_rules
from loopwatch.operators.stream_rules import LOCK, RECENT, RECENT_LEAST, SPAN, STRIDE, SUSTAIN

FRAME = "device_id long, t long, margin double, at_risk boolean, eta double, n_rules int, osc double, score double, locked boolean, sustained boolean, fault boolean, started boolean, ordered boolean"
#: Columns that the processor reads.
READING = ["device_id", "t", "operating_condition", "pressure", "margin", "n_rules", "raw", "exceeds", "answers"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Readings before the first score, score that counts as high, warm-up of diagnoses, seconds between starts and to the end of one.
WINDOW, HIGH, WARM, GAP, TAKES = 100, 0.6, 600, 10, 25
#: Readings between two looks ahead, of the margins that are looked at, and how far ahead.
EVERY, BEHIND, AHEAD = 60, 120, 600.0
#: Frames that are worked off at once, so that they stay in the processor's cache.
BLOCK = 512
#: Seconds of readings in one step of `over_files`.
STRETCH = 4096


def prepared(readings: DataFrame, raw: Column, exceeds: Column | None = None, answers: Column | None = None) -> DataFrame:
    """The columns of READING: raw is the anomaly score that a reading would get, exceeds whether a forecast made at it goes
    beyond its limit, answers whether a diagnosis that starts at it would succeed."""
    fired = sum((F.coalesce(cond, F.lit(False)).cast("int") for _, cond, _ in row_rules()), F.lit(0))
    false, true = F.lit(False), F.lit(True)
    more = {"margin": dew_margin(), "n_rules": fired, "raw": raw, "exceeds": F.coalesce(exceeds, false) if exceeds is not None else false, "answers": F.coalesce(answers, false) if answers is not None else true}
    return readings.where(F.col("device_id").isNotNull()).withColumn("device_id", F.col("device_id").cast("long")).withColumns(more).select(READING)


def _frames(held: np.ndarray, new: np.ndarray, span: int, fill) -> np.ndarray:
    """For each new value the last `span` values up to it, `fill` where there are fewer."""
    row = np.concatenate((np.full(max(0, span - 1 - len(held)), fill), held[-(span - 1) :], new))
    return np.lib.stride_tricks.sliding_window_view(row, span)


def detrended(values: np.ndarray) -> np.ndarray:
    """Population deviation of what a line leaves of each row's values; nan with fewer than ten. NaN values stand before all others."""
    n = (~np.isnan(values)).sum(axis=1)
    out = np.full(len(values), np.nan)
    for k in np.unique(n[n >= 10]):
        x = np.arange(k) - (k - 1) / 2
        own = np.flatnonzero(n == k)
        for at in np.split(own, np.arange(BLOCK, len(own), BLOCK)):
            rows = values[at, values.shape[1] - k :]
            y = rows - rows.mean(axis=1, keepdims=True)
            left = (y * y).sum(axis=1) - (y @ x) ** 2 / (x @ x)
            out[at] = np.sqrt(np.maximum(0, left) / k)
    return out


class LiveProcessor(StatefulProcessor):
    """Readings (READING) to frames (FRAME)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "t long, margin double, condition string, high boolean")
        self.pressures = handle.getListState("pressures", "pressure double")
        self.counts = handle.getValueState("counts", "seen long, live long")
        self.scored = handle.getValueState("scored", "score double")
        self.changed = handle.getValueState("changed", "t long")
        self.running = handle.getValueState("running", "started long, until long, answers boolean")
        self.issued = handle.getValueState("issued", "t long")

    def close(self) -> None:
        pass

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self._step(key, initialState, shown=False)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self._step(key, pd.concat(list(rows)), shown=True)

    def _step(self, key: tuple, rows: pd.DataFrame, shown: bool) -> pd.DataFrame:
        rows = rows.sort_values("t", kind="stable")
        n, t = len(rows), rows["t"].to_numpy(np.int64)
        seen, live = self.counts.get() if self.counts.exists() else (0, 0)
        held = list(self.recent.get())
        conditions = rows["operating_condition"].to_numpy(object, na_value=None)
        conditions[conditions == ""] = None
        number = seen + 1 + np.arange(n)
        out = {"device_id": np.full(n, int(key[0])), "t": t}
        margin = rows["margin"].to_numpy(np.float64, na_value=np.nan)
        out |= {"margin": margin, "at_risk": margin < MARGIN}
        lived = live + 1 + np.arange(n) if shown else np.zeros(n, np.int64)
        out["eta"] = self._eta(held, t, margin, lived)
        out["osc"] = self._osc(rows["pressure"].to_numpy(np.float64, na_value=np.nan))
        rules = rows["n_rules"].to_numpy(np.int64) + (np.nan_to_num(out["osc"]) > OSC)
        out["n_rules"] = rules.astype(np.int32)
        out["score"] = self._score(rows["raw"].to_numpy(np.float64, na_value=np.nan), number)
        high = out["score"] > HIGH
        out["locked"] = self._lock(held, t, conditions)
        recent = _frames(np.array([r[3] for r in held], np.int64), high.astype(np.int64), SPAN, 0).sum(axis=1)
        out["sustained"] = recent >= SUSTAIN
        strong = (rules > 0) | rows["exceeds"].to_numpy(bool)
        out["fault"] = (strong | (~out["locked"] & out["sustained"])) & (lived >= WARM)
        out["started"], out["ordered"] = self._diagnose(t, out["fault"], rows["answers"].to_numpy(bool))
        new = [(int(t[i]), float(margin[i]), conditions[i], bool(high[i])) for i in range(max(0, n - BEHIND), n)]
        self.recent.put([(*r,) for r in [*held, *new][-(BEHIND - 1) :]])
        self.counts.update((int(seen + n), int(live + n * shown)))
        return pd.DataFrame(out)

    def _eta(self, held: list, t: np.ndarray, margin: np.ndarray, lived: np.ndarray) -> np.ndarray:
        """At each EVERY-th live reading after the warm-up: when the line through the last margins meets the limit."""
        eta = np.full(len(t), np.nan)
        at = np.flatnonzero((lived >= WARM) & (lived % EVERY == 0))
        if not len(at):
            return eta
        x = _frames(np.array([r[0] for r in held], np.float64), t.astype(np.float64), BEHIND, np.nan)[at]
        y = _frames(np.array([r[1] for r in held], np.float64), margin, BEHIND, np.nan)[at]
        have = ~np.isnan(y)
        n, last = have.sum(axis=1), y[:, -1]
        fit = (n >= 10) & (last >= MARGIN)  # a missing margin is not
        at, x, y, have, n, last = at[fit], x[fit], y[fit], have[fit], n[fit, None], last[fit]
        x, y = (np.where(have, v - np.where(have, v, 0).sum(axis=1, keepdims=True) / n, 0) for v in (x, y))
        slope = (x * y).sum(axis=1) / (x * x).sum(axis=1)
        down = slope < 0
        ahead = (last[down] - MARGIN) / -slope[down]
        eta[at[down]] = np.where(ahead <= AHEAD, ahead, np.nan)
        return eta

    def _osc(self, pressure: np.ndarray) -> np.ndarray:
        """The deviation of the last pressures that were read, at each reading that has one."""
        held = np.array([r[0] for r in self.pressures.get()], np.float64)
        read = ~np.isnan(pressure)
        osc = np.full(len(pressure), np.nan)
        osc[read] = detrended(_frames(held, pressure[read], SPAN, np.nan))
        self.pressures.put([(float(v),) for v in np.concatenate((held, pressure[read]))[-(SPAN - 1) :]])
        return osc

    def _score(self, raw: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The score of the last reading at which one was taken, 0 before; a missing score counts as 0."""
        before = self.scored.get()[0] if self.scored.exists() else 0.0
        taken = (number >= WINDOW) & ((number - WINDOW) % STRIDE == 0)
        last = np.maximum.accumulate(np.where(taken, np.arange(len(raw)), -1))
        score = np.where(last >= 0, np.nan_to_num(raw)[last], before)
        self.scored.update((float(score[-1]),))
        return score

    def _lock(self, held: list, t: np.ndarray, conditions: np.ndarray) -> np.ndarray:
        """Whether the last RECENT readings named two conditions fewer than LOCK seconds ago."""
        changing = self.changed.get()[0] if self.changed.exists() else None
        h = len(held)
        codes = pd.factorize(np.concatenate((np.array([r[2] for r in held], object), conditions)))[0]
        codes[:h][[not r[2] for r in held]] = -1
        known = np.flatnonzero(codes >= 0)
        # how many are known up to each reading, and the place before which the last known one that differs from its follower stands
        upto = np.concatenate(([0], np.cumsum(codes >= 0)))
        differs = np.full(len(codes), -1)
        turn = np.flatnonzero(codes[known[1:]] != codes[known[:-1]])
        differs[known[turn + 1]] = known[turn]
        differs = np.maximum.accumulate(differs)[h:]
        place = np.arange(h, len(codes))
        first = np.maximum(0, place - RECENT + 1)
        never = np.iinfo(np.int64).min // 2
        marks = np.where((upto[place + 1] - upto[first] >= RECENT_LEAST) & (differs >= first), t, never)
        last = np.maximum.accumulate(np.concatenate(([never if changing is None else changing], marks)))[1:]
        if last[-1] != never:
            self.changed.update((int(last[-1]),))
        return t - last < LOCK

    def _diagnose(self, t: np.ndarray, fault: np.ndarray, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which readings start a diagnosis, and which one finds the order issued."""
        started, ordered = np.zeros(len(t), bool), np.zeros(len(t), bool)
        if self.issued.exists():
            return started, ordered
        last, until, good = self.running.get() if self.running.exists() else (None, None, None)
        i = 0
        while i < len(t):
            if until is not None and t[i] >= until:
                until = None
                if good:
                    ordered[i] = True
                    self.issued.update((int(t[i]),))
                    break
            if until is None and fault[i] and (last is None or t[i] - last >= GAP):
                started[i], last, until, good = True, int(t[i]), int(t[i]) + TAKES, bool(answers[i])
            # on to the next reading at which anything can happen
            if until is not None:
                i = int(np.searchsorted(t, until))
            else:
                later = np.flatnonzero(fault[i + 1 :])
                i = i + 1 + int(later[0]) if len(later) else len(t)
        if last is not None:
            self.running.update((last, until, good))
        return started, ordered


def live(readings: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """FRAME of each reading of a stream of READING; initial: readings of a batch table that fill the state and give no rows."""
    held = initial.select(READING).groupBy("device_id") if initial is not None else None
    return readings.select(READING).groupBy("device_id").transformWithStateInPandas(LiveProcessor(), FRAME, "append", "none", initialState=held)


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, as several states of a key need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run_available(spark: SparkSession, out: DataFrame, base: str, name: str = "out") -> DataFrame:
    """Runs a streaming frame over what its source holds, into Parquet at base/name with the checkpoint beside it."""
    with rocksdb(spark):
        query = out.writeStream.format("parquet").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/{name}_state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/{name}")


def in_order(spark: SparkSession, rows: DataFrame, folder: str, part: Column, spread: tuple[str, ...] = (), dealt: bool = False) -> None:
    """Writes rows as files whose age follows `part`, a number that grows with time: one file for each part, or many by the columns
    of `spread`, which lie in one partition already if `dealt`. Rows without a part are left in {folder}_parts. It is what a recorder would have left; a stream takes files by age."""
    parts = rows.withColumn("_part", part)
    (parts if dealt else parts.repartition("_part", *spread)).write.partitionBy("_part").parquet(f"{folder}_parts")
    every = spark.read.schema(parts.schema).parquet(f"{folder}_parts")
    for (number,) in every.where("_part is not null").select("_part").distinct().orderBy("_part").collect():  # as many as stretches of time
        rows_ = every.where(F.col("_part") == number).drop("_part")
        # a large part is read in several splits, each of which would leave a file, and a batch takes files by their number
        (rows_ if spread else rows_.coalesce(1)).write.mode("append").parquet(folder)


def over_files(spark: SparkSession, rows: DataFrame, step: Callable[..., DataFrame], part: Column | None = None, spread: tuple[str, ...] = ("device_id",), files: int = 64, dealt: bool = False, before: Column | None = None) -> DataFrame:
    """step over a stream of all rows, as one query that takes `files` files at a time in order of their age. Files lie in the
    folder of spark.checkpoint.dir. Rows that `before` holds for are not of the stream: step gets them as a second, batch table, and
    rows are worked out once for both."""
    from loopwatch.sources.store import shared_folder

    base = f"{shared_folder(spark)}/stream/{uuid.uuid4().hex}"
    part = F.floor(F.col("t") / STRETCH) if part is None else part
    in_order(spark, rows, f"{base}/in", part if before is None else F.when(~F.coalesce(before, F.lit(False)), part), spread, dealt)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    if before is None:
        return run_available(spark, step(stream), base)
    held = spark.read.schema(rows.withColumn("_part", part).schema).parquet(f"{base}/in_parts").where("_part is null").where(before)
    return run_available(spark, step(stream, held.drop("_part")), base)


def alert_stream(readings: DataFrame) -> DataFrame:
    """The row rules on a stream: stateless, so the batch expressions serve as they are."""
    return row_alerts(readings)


def sampled(readings: DataFrame, every: int = 10) -> DataFrame:
    """One reading in ten, for a sink that persists a sample."""
    return readings.where(F.col("t") % every == 0)
