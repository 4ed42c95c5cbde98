"""What follows a diagnosis: manual flags, levels, work orders, plans, messages, feedback and what is learnt from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwatch.functions.dims import small
from loopwatch.operators.graph import confidence_gate

# Emergency plans with their steps and what they forbid.
PLANS = [
    ("EP-002", "炉体漏水入铁水应急", "管道泄漏", ["第一优先级：操作人员立即撤离至安全防爆区", "立即倾炉倒出铁水", "切断水源", "保护现场，事故调查，设备检修更换"], ["严禁向漏水的炉体直接浇水灭火"]),
    ("EP-001", "突发全厂停电/穿炉应急", "线圈烧穿", ["系统自动启动柴油备用泵或高位重力水箱供水", "检查供水压力：正常则继续冷却，不足则立即倾炉", "倾炉操作：铁水倒入备用铁水包或安全区域"], ["严禁炉内留铁水"]),
]
MAX_RETRY = 3


def passed(physics_ok: Column, graph_ok: Column) -> Column:
    """Both checks hold; one that was not made doesn't."""
    return F.coalesce(physics_ok, F.lit(False)) & F.coalesce(graph_ok, F.lit(False))


def manual_required(conf: Column, parsed: Column, endpoint_error: Column, checked: Column, retries: Column, before: Column) -> Column:
    """Whether a person must decide: an unreachable model, an unreadable answer, a failed last try, or low confidence."""
    failed = F.coalesce(~checked, F.lit(False)) & (retries >= MAX_RETRY - 1)
    return before | endpoint_error.isNotNull() | ~parsed | failed | (confidence_gate(conf) == "manual")


def rolled_level(diagnosed: Column, level: Column, manual: Column, l1: Column, anomalous: Column) -> Column:
    """A window's level: the diagnosis' own (orange if it names none), yellow if a person must decide; yellow for alerts alone."""
    own = F.when(manual, "yellow").otherwise(F.coalesce(level, F.lit("orange")))
    return F.when(diagnosed, own).when(l1 | anomalous, "yellow").otherwise("none")


def order_level(level: Column, fault_level: Column, manual: Column) -> Column:
    known = F.when(level.isin("red", "orange", "yellow"), level).otherwise(F.coalesce(fault_level, F.lit("orange")))
    return F.when(manual, "yellow").otherwise(known)


def numbered(orders: DataFrame, day: str, by: str) -> DataFrame:
    """orders with order_id WO-yyyymmdd-nnnn: counted within each day in the order of `by`, with more digits beyond 9,999."""
    w = Window.partitionBy(day).orderBy(by)
    return orders.withColumn("order_id", F.concat(F.lit("WO-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.format_string("%04d", F.row_number().over(w))))


def with_plans(orders: DataFrame, plans: DataFrame) -> DataFrame:
    """orders (fault, level, sop) with plan_id and forbidden; a red order whose fault has a plan takes its title and steps first."""
    known = small(plans.select(F.col("fault"), F.col("plan_id").alias("_id"), F.col("name").alias("_name"), F.col("steps").alias("_steps"), F.col("forbidden").alias("_no")))
    both = orders.join(known, "fault", "left")
    fires = (F.col("level") == "red") & F.col("_id").isNotNull()
    title = F.concat(F.lit("【应急预案 "), F.col("_id"), F.lit(" "), F.col("_name"), F.lit("】"))
    sop = F.when(fires, F.concat(F.array(title), F.col("_steps"), F.col("sop"))).otherwise(F.col("sop"))
    return both.withColumns({"sop": sop, "plan_id": F.when(fires, F.col("_id")), "forbidden": F.when(fires, F.col("_no"))}).drop("_id", "_name", "_steps", "_no")


def handled(windows: DataFrame, spare: DataFrame, levels: DataFrame, plans: DataFrame, actions: DataFrame) -> DataFrame:
    """Work orders of diagnosed windows (case_id, day, diagnosed, fault, level, manual): number, level, parts, steps and plan; a window
    without a diagnosis is not handled and has none of these. The dimensions have a row for each fault."""
    out = windows.join(small(levels.withColumnRenamed("level", "_level")), "fault", "left").join(small(spare), "fault", "left").join(small(actions), "fault", "left")
    none = F.expr("cast(array() as array<string>)")
    out = out.withColumns({"level": order_level(F.col("level"), F.col("_level"), F.col("manual")), "parts": F.coalesce("parts", none), "sop": F.coalesce("sop", none)}).drop("_level")
    made = with_plans(numbered(out.where("diagnosed"), "day", "case_id"), plans).withColumn("handled", F.lit(True))
    rest = windows.where("not diagnosed").select("case_id", F.lit(False).alias("handled"))
    return made.unionByName(rest, allowMissingColumns=True)


def notified(messages: DataFrame) -> DataFrame:
    """Per order how many messages went out, and to which channels and receivers."""
    return messages.groupBy("order_id").agg(F.count(F.lit(1)).alias("total"), F.sort_array(F.collect_set("channel")).alias("channels"), F.sort_array(F.collect_set("receiver")).alias("receivers"))


def notified_by_level(messages: DataFrame) -> DataFrame:
    return messages.groupBy("level").agg(F.count(F.lit(1)).alias("total"))


def with_snapshot(feedback: DataFrame, diagnoses: DataFrame, keep: int = 200) -> DataFrame:
    """feedback with its order's diagnosis, of the newest `keep` diagnoses only (column at); null where it has none."""
    return feedback.join(diagnoses.orderBy(F.desc("at"), F.desc("order_id")).limit(keep).drop("at"), "order_id", "left")


def feedback_stats(feedback: DataFrame, least: int = 5) -> DataFrame:
    """total, true faults, false alarms, and whether enough true faults came to train again."""
    true = F.count_if("is_true_fault")
    return feedback.agg(F.count(F.lit(1)).alias("total"), true.alias("true_faults"), (F.count(F.lit(1)) - true).alias("false_alarms"), (true > 0).alias("pending"), ((true > 0) & (true >= least)).alias("retrain"), (F.count(F.lit(1)) >= least).alias("retrain_by_lines"))


def usable(feedback: DataFrame) -> DataFrame:
    """True faults with a prompt and a confirmed cause."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return feedback.where(F.col("is_true_fault") & there("prompt") & there("actual"))


def preference_pairs(feedback: DataFrame) -> DataFrame:
    """Of usable feedback what the model got wrong: the prompt, its answer, and the right cause."""
    wrong = usable(feedback).where(~F.col("actual").eqNullSafe(F.col("root_cause")))
    return wrong.select("order_id", "prompt", F.coalesce("output", F.lit("")).alias("rejected"), F.col("actual").alias("actual_root_cause"), F.col("root_cause").alias("model_root_cause"))


def feedback_samples(feedback: DataFrame, actions: DataFrame) -> DataFrame:
    """Training rows of usable feedback: prompt, and an answer with the confirmed cause and its fault's actions."""
    both = usable(feedback).join(small(actions.withColumnRenamed("fault", "actual")), "actual", "left")
    none = F.expr("cast(array() as array<string>)")
    obj = F.to_json(F.struct(F.col("actual").alias("root_cause"), F.lit(0.85).alias("confidence"), F.array(F.lit("人工复核确认根因（反馈校正样本）")).alias("evidence"), F.coalesce("sop", none).alias("sop")))
    text = F.concat(F.lit("（人工反馈校正）经运维复核，实际根因为"), F.col("actual"), F.lit("，依据现场处置确认。\n"), obj)
    return both.select("order_id", "prompt", text.alias("assistant"), F.col("actual").alias("gold"), F.lit("feedback").alias("kind"))


def learnt(feedback: DataFrame, day: Column) -> DataFrame:
    """Ledger rows for true faults whose cause was not the order's: what the next diagnosis can read."""
    off = feedback.where(F.col("is_true_fault") & F.col("root_cause").isNotNull() & (F.col("actual") != F.col("root_cause")))
    return off.select("order_id", day.alias("date"), F.col("actual").alias("component"), F.lit("故障处置（反馈驱动记录）").alias("action"), F.lit("持续优化智能体自动归档").alias("note"))
