"""Threshold, combination and windowed rules: each reading becomes none to many alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwatch.functions.dims import small
from loopwatch.functions import features as f
from loopwatch.sources.store import written

# Sensors of the knowledge graph that rules point at; rules not named here point at none.
RULE_SENSOR = {
    "OUTLET_TEMP_HIGH": "出水温度", "INLET_TEMP_HIGH": "进水温度", "DELTA_T_HIGH": "出水温度", "PRESSURE_LOW": "压力",
    "PRESSURE_HIGH": "压力", "PRESSURE_OSC": "压力", "FLOW_LOW": "流量", "FLOW_HIGH": "流量", "CONDUCTIVITY_HIGH": "电导率",
    "DEW_MARGIN_LOW": "湿度", "COMBO_LEAK_SUSPECT": "压力",
}
DEFAULT_SENSORS = ["出水温度", "压力", "流量", "湿度"]
# The equipment node of a rule, and what is shown there.
RULE_NODE = [
    ("OUTLET_TEMP_HIGH", "furnaces", "回水温度偏高"), ("DELTA_T_HIGH", "furnaces", "进出水温差偏大"), ("COMBO_HEAT_BUILDUP", "furnaces", "低流量与高温：积热风险"),
    ("INLET_TEMP_HIGH", "tower", "供水温度偏高，检查换热"), ("PRESSURE_LOW", "pipework", "供水压力偏低，故障待定位"), ("PRESSURE_HIGH", "pipework", "供水压力偏高"),
    ("FLOW_LOW", "pipework", "循环流量不足，故障待定位"), ("FLOW_HIGH", "pipework", "循环流量偏高"), ("PRESSURE_OSC", "pump", "压力震荡，疑似水泵气蚀"),
    ("CONDUCTIVITY_HIGH", "tank", "水质电导率超限"), ("DEW_MARGIN_LOW", "power", "电气柜凝露风险"), ("HUMIDITY_HIGH", "power", "柜体环境湿度偏高"),
    ("COMBO_LEAK_SUSPECT", "pipework", "疑似泄漏，具体漏点待核查"), ("PQ_OFFSET", "pipework", "管网特性偏移"), ("HEAT_RATE_DRIFT", "furnaces", "热交换表现异常"),
]
OUTLET, INLET, DELTA, P_LOW, P_HIGH, CONDUCTIVITY, MARGIN, HUMID = 55.0, 35.0, 25.0, 150.0, 300.0, 800.0, 3.0, 70.0
FLOW_LOW, FLOW_HIGH, LEAK_P, OSC, DRIFT, OFFSET = 0.8, 1.2, 180.0, 3.0, 0.15, 0.10
SPAN, EVERY, AHEAD = 600, 60, 600.0


def row_rules(inlet_limit: Column | None = None) -> list[tuple[str, Column, Column]]:
    """(rule, condition, value) of the rules that look at one reading. Nulls never fire."""
    c, limit = F.col, F.lit(INLET) if inlet_limit is None else F.coalesce(inlet_limit, F.lit(INLET))
    delta, flow, margin = c("outlet_temp") - c("inlet_temp"), c("flow_rate") / f.RATED_FLOW, f.dew_margin()
    return [
        ("OUTLET_TEMP_HIGH", c("outlet_temp") > OUTLET, c("outlet_temp")),
        ("INLET_TEMP_HIGH", c("inlet_temp") > limit, c("inlet_temp")),
        ("DELTA_T_HIGH", delta > DELTA, delta),
        ("PRESSURE_LOW", c("pressure") < P_LOW, c("pressure")),
        ("PRESSURE_HIGH", c("pressure") > P_HIGH, c("pressure")),
        ("FLOW_LOW", flow < FLOW_LOW, c("flow_rate")),
        ("FLOW_HIGH", flow > FLOW_HIGH, c("flow_rate")),
        ("CONDUCTIVITY_HIGH", c("conductivity") > CONDUCTIVITY, c("conductivity")),
        ("DEW_MARGIN_LOW", margin < MARGIN, margin),
        ("HUMIDITY_HIGH", c("cabinet_humidity") > HUMID, c("cabinet_humidity")),
        ("COMBO_HEAT_BUILDUP", (flow < FLOW_LOW) & (c("outlet_temp") > OUTLET), c("outlet_temp")),
        ("COMBO_LEAK_SUSPECT", (c("pressure") < LEAK_P) & (c("cabinet_humidity") > HUMID), c("pressure")),
    ]


def _alerts(df: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """One scan for all rules: an array of the alerts that fire, exploded."""
    fired = [F.when(cond, F.struct(F.lit(name).alias("rule_id"), F.bround(value, 2).alias("value"))) for name, cond, value in rules]
    hit = F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull()))
    return df.select("device_id", "t", hit.alias("a")).select("device_id", "t", "a.rule_id", F.lit("yellow").alias("level"), "a.value")


def row_alerts(df: DataFrame, inlet_limit: Column | None = None) -> DataFrame:
    return _alerts(df, row_rules(inlet_limit))


def pressure_oscillation(df: DataFrame, span: int = 60) -> DataFrame:
    """The deviation of the last `span` pressures that were read; a reading without pressure has none."""
    osc = f.rolling_detrended_std(df, "pressure", span)
    return _alerts(osc, [("PRESSURE_OSC", F.col("osc") > OSC, F.col("osc"))])


def heat_drift(df: DataFrame) -> DataFrame:
    """Heating rate per power of steady readings against the device's own median."""
    rated = df.withColumn("ratio", f.heating_rate_per_power()).where(F.col("operating_condition").isin("melting", "holding") & F.col("ratio").isNotNull())
    base = rated.groupBy("device_id").agg(F.percentile("ratio", F.lit(0.5)).alias("base")).where(F.abs("base") > 1e-6)
    both = rated.join(base, "device_id").withColumn("off", F.abs(F.col("ratio") - F.col("base")) / F.abs("base"))
    return _alerts(both, [("HEAT_RATE_DRIFT", F.col("off") > DRIFT, F.col("ratio"))])


def pq_alerts(df: DataFrame) -> DataFrame:
    off = df.withColumn("off", f.pq_offset())
    return _alerts(off, [("PQ_OFFSET", F.abs("off") > OFFSET, F.col("off"))])


def dew_predict(df: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Each minute from row 600 on: a falling dew margin that meets the limit within ten minutes."""
    with_margin = df.select("device_id", "t", f.dew_margin().alias("m"))
    rows = df.groupBy("device_id").agg((F.max("t") + 1).alias("_end"))
    due = f.sampled_windows(with_margin, SPAN, EVERY).groupBy("device_id", "due").agg(f.slope("m").alias("slope"), F.max_by("m", "t").alias("margin"), F.count(F.lit(1)).alias("n"), F.max("t").alias("t"))
    eta = (F.col("margin") - margin) / -F.col("slope")
    whole = (F.col("n") == SPAN) & (F.col("t") == F.col("due"))
    # a window that ends with the series is left out
    due = due.where(whole).join(rows, "device_id").where("due + 1 < _end")
    return _alerts(due, [("DEW_PREDICT", (F.col("slope") < 0) & (F.col("margin") >= margin) & (eta <= AHEAD), F.col("margin"))])


def all_alerts(df: DataFrame, span: int = 86400, least: int = 3600) -> DataFrame:
    """Alerts of all rules; the inlet's limit follows the season once it is known. Unordered: see `in_order`.

    The readings are written once, as each windowed rule reads a few columns of them. What looks at one reading alone is one scan;
    only the inlet's temperatures go through the season's sums."""
    df = written(df)
    alone = [x for x in row_rules() if x[0] != "INLET_TEMP_HIGH"]
    off = f.pq_offset()
    once = _alerts(df, [*alone, ("PQ_OFFSET", F.abs(off) > OFFSET, off)])
    season = f.seasonal_inlet_threshold(df.select("device_id", "t", "inlet_temp"), span, least)
    # nine decimals: sums in another order differ in their last bits, and a reading that equals the limit must not exceed it
    limit = F.coalesce(F.round("threshold", 9), F.lit(INLET))
    inlet = _alerts(season, [("INLET_TEMP_HIGH", F.col("inlet_temp") > limit, F.col("inlet_temp"))])
    drift = heat_drift(df.select("device_id", "t", "furnace_temp", "electric_power", "operating_condition"))
    return once.unionByName(inlet).unionByName(pressure_oscillation(df.select("device_id", "t", "pressure"))).unionByName(drift).unionByName(dew_predict(df.select("device_id", "t", "cabinet_temp", "cabinet_humidity")))


def in_order(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("t", "device_id", "rule_id")


def latest_alerts(alerts: DataFrame, keep: int = 10) -> DataFrame:
    """Per device the distinct rules and the last `keep` alerts, newest first."""
    w = Window.partitionBy("device_id").orderBy(F.desc("t"), "rule_id")
    last = alerts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep)
    tail = last.groupBy("device_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "t", "rule_id"))), lambda x: F.concat_ws("@", x["rule_id"], x["t"].cast("string"))).alias("last"))
    return alerts.groupBy("device_id").agg(F.sort_array(F.collect_set("rule_id")).alias("rules")).join(tail, "device_id")


def sensors_or_default(alerts: DataFrame, devices: DataFrame, dimension: DataFrame) -> DataFrame:
    """Per device the sensors its alerts point at, sorted; the default list where there is none."""
    found = sensors_of(alerts, dimension).groupBy("device_id").agg(F.sort_array(F.collect_set("sensor")).alias("found"))
    return devices.join(found, "device_id", "left").select("device_id", F.coalesce("found", F.array(*map(F.lit, DEFAULT_SENSORS))).alias("sensors"))


def nodes_of(alerts: DataFrame, dimension: DataFrame) -> DataFrame:
    """Alerts with the equipment node and note of their rule; rules without one keep null and their own name."""
    return alerts.join(small(dimension), "rule_id", "left").withColumn("note", F.coalesce("note", "rule_id"))


def sensors_of(alerts: DataFrame, dimension: DataFrame) -> DataFrame:
    """Alerts with the sensor their rule points at; rules without one drop out. The dimension has a row for each rule."""
    return alerts.join(small(dimension), "rule_id")
