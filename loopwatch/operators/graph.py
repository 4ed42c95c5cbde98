"""The fault graph, its joins, and the tables of decisions that follow a diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwatch.functions.dims import fixed, small

# Fault to sensor, fault to fault, fault to action, in the graph's order.
INDICATES = [
    ("过滤器堵塞", "流量"), ("过滤器堵塞", "出水温度"), ("水泵气蚀", "压力"), ("水泵气蚀", "流量"), ("管道泄漏", "压力"), ("管道泄漏", "水箱液位"),
    ("管道泄漏", "湿度"), ("线圈结垢", "出水温度"), ("电气柜凝露", "湿度"), ("电气柜凝露", "电气柜温度"), ("水质恶化", "电导率"),
]
CAUSES = [("过滤器堵塞", "线圈烧穿"), ("线圈结垢", "线圈烧穿"), ("管道泄漏", "电气柜凝露"), ("水质恶化", "电气击穿")]
HANDLED_BY = [
    ("过滤器堵塞", "清洗过滤器"), ("过滤器堵塞", "切换备用泵"), ("水泵气蚀", "切换备用泵"), ("管道泄漏", "测漏仪检查管路"), ("管道泄漏", "备件DN50密封圈"),
    ("线圈结垢", "弱酸循环清洗除垢"), ("水质恶化", "更换去离子水"), ("线圈烧穿", "紧急倾炉"),
]
# Spare parts and level of a fault; channels and receivers of a level.
SPARE_PARTS = [("管道泄漏", ["DN50密封圈", "检漏仪"]), ("过滤器堵塞", ["Y型滤网", "清洗剂"]), ("水泵气蚀", ["备用泵机封", "轴承"]), ("线圈结垢", ["弱酸清洗剂", "除垢剂"]), ("水质恶化", ["去离子水", "离子交换树脂"]), ("电气柜凝露", ["除湿机", "绝缘干燥剂"])]
FAULT_LEVEL = [("管道泄漏", "red"), ("线圈结垢", "orange"), ("过滤器堵塞", "orange"), ("水泵气蚀", "orange"), ("水质恶化", "orange"), ("电气柜凝露", "yellow")]
PUSH = [("red", ["sound_light_alarm", "sms", "phone"], ["厂长", "安全主管", "运维班长"]), ("orange", ["mobile_app", "sms"], ["运维班长", "维修工"]), ("yellow", ["mobile_app"], ["值班运维"])]
# Bounds of physical plausibility, wider than those of quality control.
LIMITS = {"outlet_temp": (0.0, 100.0), "inlet_temp": (0.0, 60.0), "pressure": (0.0, 1000.0), "flow_rate": (0.0, 50.0), "tank_level": (0.0, 500.0), "conductivity": (0.0, 3000.0), "cabinet_humidity": (0.0, 100.0), "furnace_temp": (0.0, 2000.0)}


def numbered(edges: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    return [(i, a, b) for i, (a, b) in enumerate(edges)]


def candidates(anomalies: DataFrame, indicates: DataFrame, keep: int = 3) -> DataFrame:
    """For each case the faults that its anomalous sensors point at: most hits first, then in the graph's order."""
    hits = anomalies.select("case_id", "sensor").distinct().join(small(indicates), "sensor").groupBy("case_id", "fault").agg(F.count(F.lit(1)).alias("hits"), F.min("ord").alias("ord"))
    w = Window.partitionBy("case_id").orderBy(F.desc("hits"), "ord")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("case_id", "fault", "hits", "rank")


def unsupported(claims: DataFrame, indicates: DataFrame) -> DataFrame:
    """Claims (case_id, fault, sensor) whose sensor the graph knows but not as evidence of that fault."""
    known = claims.join(small(indicates.select("sensor").distinct()), "sensor", "left_semi")
    return known.join(small(indicates.select("fault", "sensor")), ["fault", "sensor"], "left_anti")


def contradicted(claims: Column) -> Column:
    """Claims that call an outlet below the inlet normal."""
    return F.exists(claims, lambda c: F.contains(c, F.lit("出水温度")) & F.contains(c, F.lit("低于进水")) & F.contains(c, F.lit("正常")))


def unknown_causes(claims: DataFrame, faults: DataFrame) -> DataFrame:
    """Claims (case_id, fault) whose fault the graph doesn't hold."""
    return claims.join(small(faults.select("fault").distinct()), "fault", "left_anti")


def physics_violations(claims: Column | None = None) -> Column:
    """Names of the channels beyond their limits, of an outlet colder than the inlet, and of claims that contradict it."""
    out = [F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(c)) for c, (lo, hi) in LIMITS.items()]
    out.append(F.when(F.col("outlet_temp") < F.col("inlet_temp") - 1, F.lit("outlet_below_inlet")))
    if claims is not None:
        out.append(F.when(contradicted(claims), F.lit("claim")))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def confidence_gate(conf: Column) -> Column:
    return F.when(conf >= 0.90, "direct").when(conf >= 0.70, "candidates").otherwise("manual")


def cascade_gate(reached: Column, parsed: Column, passed: Column, cause: Column, candidates_: Column) -> Column:
    """Why a case goes on to the second model; null if it doesn't. Confidence plays no part, nor does an empty list."""
    return F.when(~reached, "endpoint").when(~parsed, "parse").when(~passed, "check").when((F.size(candidates_) > 0) & ~F.coalesce(F.array_contains(candidates_, cause), F.lit(False)), "candidate")


def precheck(hum: Column, dh: Column, p: Column, ps: Column, q: Column, pq: Column, dt: Column) -> Column:
    """Causes that plain statistics suggest, in order; missing statistics take normal values."""
    hum, dh, p, ps, q, pq, dt = (F.coalesce(c, F.lit(x)) for c, x in ((hum, 50.0), (dh, 0.0), (p, 240.0), (ps, 0.0), (q, 8.0), (pq, 0.0), (dt, 0.0)))
    leak = (hum > 70) | ((dh > 4) & ((q < 7.8) | (p < 240)))
    low = q < 6.4
    second = F.when(low & ~leak, F.when(pq >= 10, "线圈结垢").otherwise("过滤器堵塞")).when(~low & (dt > 20) & (dh <= 4), "线圈结垢")
    return F.filter(F.array(F.when(leak, "管道泄漏").when(ps > 3, "水泵气蚀"), second), lambda x: x.isNotNull())


def fallback(hum: Column, dh: Column, p: Column, ps: Column, q: Column, dt: Column, top: Column) -> Column:
    """The cause without a model: the first rule that holds; a rule whose inputs are missing doesn't. A missing humidity rise or
    pressure deviation counts as 0."""
    dh, ps = F.coalesce(dh, F.lit(0.0)), F.coalesce(ps, F.lit(0.0))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(is_(hum > 70), "管道泄漏")
        .when(is_(dh > 4) & (is_(q < 7.8) | is_(p < 240)), "管道泄漏")
        .when(is_(ps > 3) & (hum.isNull() | (hum <= 65)), "水泵气蚀")
        .when(is_(q < 6.4) & is_(p > 230), "线圈结垢")
        .when(is_(q < 6.4) & (hum.isNull() | (hum <= 70)) & is_(ps < 3), "过滤器堵塞")
        .when(is_(dt > 20) & is_(p > 200), "线圈结垢")
        .when(is_(p >= 150) & is_(p < 200) & is_(q < 7.5), "水泵气蚀")
        .otherwise(F.coalesce(top, F.lit("未知故障")))
    )


def arbitrate(df: DataFrame) -> DataFrame:
    """df (model, conf, candidates, extras, hum, dh, ps, pq) with cause and confidence: model against graph, then corrections in order."""
    # what is missing or 0 takes the normal value
    df = df.withColumns({"hum": F.when((F.col("hum") != 0) & F.col("hum").isNotNull(), F.col("hum")).otherwise(50.0), **{x: F.coalesce(x, F.lit(0.0)) for x in ("dh", "ps", "pq")}})
    top, model, c = F.get("candidates", F.lit(0)), F.col("model"), F.col("conf")
    held = F.coalesce(F.array_contains("candidates", model), F.lit(False)) & (c >= 0.8)
    clipped = lambda x: F.greatest(F.least(x, F.lit(0.85)), F.lit(0.7))
    df = df.withColumns({"cause": F.when(model == top, top).when(held, model).otherwise(top), "confidence": F.when(model == top, F.least(c + 0.1, F.lit(0.98))).when(held, c).otherwise(F.greatest(c - 0.1, F.lit(0.5)))})
    prior = (F.size("extras") > 0) & ~F.coalesce(F.array_contains("extras", F.col("cause")), F.lit(False))
    df = df.withColumns({"cause": F.when(prior, F.get("extras", F.lit(0))).otherwise(F.col("cause")), "confidence": F.when(prior, clipped(c)).otherwise(F.col("confidence"))})
    cause, conf = F.col("cause"), F.col("confidence")
    dry = (cause == "管道泄漏") & (F.col("hum") <= 65) & (F.col("dh") <= 4)
    wet = cause.isin("过滤器堵塞", "线圈结垢") & (F.col("dh") > 4)
    df = df.withColumns({"cause": F.when(dry & (F.col("ps") > 3), "水泵气蚀").when(~dry & wet, "管道泄漏").otherwise(cause), "confidence": F.when(dry, F.least(conf, F.lit(0.75))).when(wet, clipped(conf)).otherwise(conf)})
    scale = (F.col("cause") == "过滤器堵塞") & (F.col("dh") <= 4) & (F.col("ps") <= 3) & (F.col("pq") >= 10)
    return df.withColumns({"cause": F.when(scale, "线圈结垢").otherwise(F.col("cause")), "confidence": F.when(scale, clipped(F.col("confidence"))).otherwise(F.col("confidence"))})


def interval_lookup(points: DataFrame, schedule: DataFrame, at: str) -> DataFrame:
    """points with the columns of the phase that holds each, both ends closed; of two that meet, the earlier; nulls where none does.
    The schedule, a table of a bounded size, becomes one array that each point is looked up in, so points stay where they are and
    repeated ones stay repeated."""
    phases = fixed(schedule, "the schedule").agg(F.array_sort(F.collect_list(F.struct("start", "end", *(c for c in schedule.columns if c not in ("start", "end"))))).alias("_phases"))
    first = F.get(F.filter("_phases", lambda p: F.col(at).between(p["start"], p["end"])), F.lit(0))
    found = points.join(F.broadcast(phases)).withColumn("_phase", first)
    return found.select(*points.columns, *(F.col(f"_phase.{c}").alias(c) for c in schedule.columns))


def fan_out(orders: DataFrame, push: DataFrame) -> DataFrame:
    """A message for each channel and receiver of an order's level; unknown levels count as yellow."""
    known = F.when(F.col("level").isin("red", "orange", "yellow"), F.col("level")).otherwise("yellow")
    routed = orders.withColumn("route", known).join(small(push.withColumnRenamed("level", "route")), "route")
    return routed.withColumn("channel", F.explode("channels")).withColumn("receiver", F.explode("receivers")).drop("channels", "receivers", "route")
