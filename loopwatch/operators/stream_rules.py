"""The stream's decisions in batch form: throttled scores, the lock after a change, sustained anomalies, the first trigger.

They are window expressions over a device's monotone sequence, so the streaming processor can be held against them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from loopwatch.functions.features import dew_margin, ordered, sampled_windows, slope, trailing
from loopwatch.functions.scans import in_frames, nearest_valid, spaced

LOCK, SPAN, SUSTAIN, STRIDE = 600, 60, 25, 10
#: Readings that show a change of condition, and how many of them must be known.
RECENT, RECENT_LEAST = 30, 5


def throttled_at(base: int, stride: int = STRIDE) -> Column:
    """The time whose score is shown at t: scores are taken every `stride` readings from `base` on."""
    return F.when(F.col("t") >= base, base + F.floor((F.col("t") - base) / stride) * stride)


def in_transition(recent: int = RECENT, least: int = RECENT_LEAST, w: WindowSpec | None = None) -> Column:
    """Whether the last `recent` readings, or those of the frame w, name two conditions or more; unknown (null or empty) ones don't count, and at least
    `least` must be known. Distinct values in a frame: the least differs from the greatest."""
    w = trailing(recent) if w is None else w
    known = F.nullif(F.col("operating_condition"), F.lit(""))
    return F.coalesce((F.count(known).over(w) >= least) & (F.min(known).over(w) != F.max(known).over(w)), F.lit(False))


def transition_lock(df: DataFrame, lock: int = LOCK, recent: int = RECENT) -> DataFrame:
    """df with locked: fewer than `lock` readings ago the recent ones named two conditions. The lock is set anew by each such
    reading, so one change at t locks t to t + recent - 2 + lock - 1."""
    return _locked(in_frames(df, recent, lambda w: {"_changing": in_transition(w=w.rowsBetween(-(recent - 1), 0))}), lock)


def _locked(seen: DataFrame, lock: int) -> DataFrame:
    last = nearest_valid(seen, {"_at": F.when(F.col("_changing"), F.col("t"))}, ["device_id"])
    return last.withColumn("locked", F.coalesce(F.col("t") - F.col("prev__at") < lock, F.lit(False))).drop("_changing", "prev__at", "next__at")


def stable(df: DataFrame, span: int = 600) -> DataFrame:
    """df with stable: no reading of the trailing `span` differs in condition from the one before it."""
    changed = F.coalesce(F.col("operating_condition") != F.lag("operating_condition").over(ordered()), F.lit(False))
    return df.withColumn("_changed", changed.cast("int")).withColumn("stable", F.max("_changed").over(trailing(span)) == 0).drop("_changed")


def dew_trend(df: DataFrame, warm: int = 600, every: int = 60, span: int = 120, limit: float = 3.0, horizon: float = 600.0) -> DataFrame:
    """device_id, t and eta of the readings at which the live path looks ahead: every minute after the warm-up, the slope of the
    last `span` margins, and when it meets the limit, if not there already and within the horizon."""
    rows = df.select("device_id", "t", dew_margin().alias("m"))
    # the reading at t is number t + 1, and a window ends at each that is a multiple of `every`
    w = sampled_windows(rows, span, every).groupBy("device_id", "due").agg(slope("m").alias("slope"), F.max_by("m", "t").alias("m"), F.max("t").alias("t"))
    eta = (F.col("m") - limit) / -F.col("slope")
    hit = (F.col("t") == F.col("due")) & (F.col("due") + 1 >= warm) & (F.col("slope") < 0) & (F.col("m") >= limit) & (eta <= horizon)
    return w.where(hit).select("device_id", "t", F.round(eta, 1).alias("eta"))


def triggers(df: DataFrame, l1: Column, exceeds: Column, warm: int = 600) -> DataFrame:
    """df (with locked and sustained) with fault: in a lock only a rule or a predicted excess counts, else a sustained anomaly too."""
    hit = l1 | exceeds | (~F.col("locked") & F.col("sustained"))
    return df.withColumn("fault", F.coalesce(hit, F.lit(False)) & (F.col("t") + 1 >= warm))


def diagnosed(df: DataFrame, gap: int = 10) -> DataFrame:
    """The readings of a device with fault that start a diagnosis: the first, and each that is `gap` seconds or more after the last
    start, whatever lies between. Event time stands for the wall clock, and no diagnosis is taken to succeed: once one has, none
    is started any more (see `once` and the live path)."""
    return spaced(df.where("fault"), gap)


def once(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: one diagnosis and one order a session, whatever is delivered again."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def freshness(readings: DataFrame, now: Column, limit: int = 30) -> DataFrame:
    """Per device its last reading's age at `now`, rounded to a tenth, and whether it is fresh."""
    last = readings.groupBy("device_id").agg(F.max("t").alias("last_t"))
    age = F.greatest(F.lit(0), now - F.col("last_t"))
    return last.select("device_id", "last_t", F.round(age, 1).alias("age"), (age <= limit).alias("fresh"))


def sustained(df: DataFrame, high: Column, span: int = SPAN, least: int = SUSTAIN) -> DataFrame:
    rows = df.withColumn("_h", high.cast("int"))
    return in_frames(rows, span, lambda w: {"sustained": F.coalesce(F.sum("_h").over(w.rowsBetween(-(span - 1), 0)) >= least, F.lit(False))}).drop("_h")


def watched(df: DataFrame, high: Column) -> DataFrame:
    """df with locked and sustained, as transition_lock and sustained have them; both look at one set of frames."""
    frames = lambda w: {
        "_changing": in_transition(w=w.rowsBetween(-(RECENT - 1), 0)),
        "sustained": F.coalesce(F.sum("_h").over(w.rowsBetween(-(SPAN - 1), 0)) >= SUSTAIN, F.lit(False)),
    }
    return _locked(in_frames(df.withColumn("_h", high.cast("int")), max(SPAN, RECENT), frames).drop("_h"), LOCK)


def first_trigger(df: DataFrame, hit: Column, warm: int = 600) -> DataFrame:
    """The first reading of each device that triggers, after the warm-up."""
    return df.where(hit & (F.col("t") >= warm)).groupBy("device_id").agg(F.min("t").alias("first_t"))
