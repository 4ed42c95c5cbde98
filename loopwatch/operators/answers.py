"""Answers to questions about the present: a device's readings at the time of the question, and the limits in force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwatch.contract import CHANNELS
from loopwatch.functions.asof import asof
from loopwatch.functions.features import RATED_FLOW
from loopwatch.operators.rules import CONDUCTIVITY, DELTA, FLOW_LOW, MARGIN, OUTLET, P_HIGH, P_LOW

# Names of the conditions.
PHASES = {"startup": "冷炉启动", "melting": "熔炼", "holding": "保温", "tapping": "出炉", "idle": "待机", "unknown": "工况未提供"}
# Names and units of the channels.
SENSORS = {
    "inlet_temp": ("进水温度", "℃"), "outlet_temp": ("出水温度", "℃"), "pressure": ("管道压力", "kPa"), "flow_rate": ("冷却水流量", "L/s"),
    "flow_velocity": ("管道流速", "m/s"), "tank_level": ("水箱液位", "cm"), "conductivity": ("电导率", "µS/cm"), "cabinet_temp": ("电气柜温度", "℃"),
    "cabinet_humidity": ("电气柜湿度", "%RH"), "furnace_temp": ("炉内温度", "℃"), "electric_power": ("电功率", "kW"), "electric_current": ("电流", "A"),
}
MISSING = "未提供"
# The limits that are told, by rule.
LIMITS = [
    ("出水温度高", f"> {OUTLET:g} ℃"), ("进出水温差高", f"> {DELTA:g} ℃"), ("管道压力低 / 高", f"< {P_LOW:g} / > {P_HIGH:g} kPa"),
    ("流量低", f"< {RATED_FLOW * FLOW_LOW:g} L/s（额定 {RATED_FLOW:g} L/s 的 {FLOW_LOW:.0%}）"), ("电导率高", f"> {CONDUCTIVITY:g} µS/cm"), ("凝露裕度预警", f"< {MARGIN:g} ℃"),
]
#: Seconds after which a device's last reading doesn't tell the present any more.
FRESH = 30


def snapshots(questions: DataFrame, readings: DataFrame, limit: int = FRESH) -> DataFrame:
    """Questions (case_id, device_id, t) with the reading that stood then: read_t, its age, whether it is fresh, condition (unknown if
    it isn't a known one), and the channels. Where the device was not heard of yet all are null, fresh is false."""
    rows = readings.select("device_id", "t", F.col("t").alias("read_t"), "operating_condition", *CHANNELS)
    found = asof(questions, rows, ["device_id"])
    age = F.col("t") - F.col("found.read_t")
    known = F.when(F.col("found.operating_condition").isin(*PHASES), F.col("found.operating_condition")).otherwise("unknown")
    return found.select(*questions.columns, F.col("found.read_t").alias("read_t"), age.alias("age"), F.coalesce(age <= limit, F.lit(False)).alias("fresh"), F.when(F.col("found").isNotNull(), known).alias("condition"), *(F.col(f"found.{c}").alias(c) for c in CHANNELS))


def readings_text(snapshot: DataFrame) -> DataFrame:
    """A row for each question and channel of a snapshot: case_id, channel, reading with its unit, or that none was given. A question
    about a device that was not heard of has no rows."""
    said = lambda c: F.coalesce(F.concat(F.format_string("%.1f", F.col(c)), F.lit(f" {SENSORS[c][1]}")), F.lit(MISSING))
    lines = F.array(*(F.struct(F.lit(c).alias("channel"), said(c).alias("reading")) for c in CHANNELS))
    return snapshot.where(F.col("read_t").isNotNull()).select("case_id", F.explode(lines).alias("x")).select("case_id", "x.*")


def headline(snapshot: DataFrame) -> DataFrame:
    """case_id and the answer's line: the condition by name, the reading's time, and whether it is the present."""
    label = F.create_map(*(F.lit(x) for kv in PHASES.items() for x in kv))[F.col("condition")]
    when = F.when(F.col("fresh"), "当前回放观测").otherwise("最近一次观测（已停止或数据超过 30 秒未更新）")
    line = F.concat(when, F.lit("："), label, F.lit("。数据时间："), F.col("read_t").cast("string"))
    return snapshot.select("case_id", F.coalesce(line, F.lit("还没有本轮实际监测数据")).alias("answer"))


def limits(questions: DataFrame) -> DataFrame:
    """case_id, rule and setting: the limits in force for each question about them."""
    rows = F.array(*(F.struct(F.lit(a).alias("rule"), F.lit(b).alias("setting")) for a, b in LIMITS))
    return questions.select("case_id", F.explode(rows).alias("x")).select("case_id", "x.*")
