"""The maintenance ledger, the operating schedule, and questions about them: searches, date ranges, routes and texts.

The ledger, the schedule, procedures and aliases are reference tables of fixed size; questions and orders are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwatch.functions.dims import fixed

# The ledger's and the schedule's built-in rows.
LEDGER = [
    ("WO-20260725-01", "2026-07-25", "循环水泵", "例行盘车检查", "运行正常"), ("WO-20260720-02", "2026-07-20", "Y型过滤器", "清洗滤网", "滤网有少量杂质"),
    ("WO-20260715-03", "2026-07-15", "板式换热器", "拆洗", "换热效率恢复"), ("WO-20260620-04", "2026-06-20", "3号阀", "更换DN50密封圈", "关键记录：阀后管道需重点关注"),
    ("WO-20260610-05", "2026-06-10", "离子交换树脂", "再生处理", "电导率恢复正常"), ("WO-20260515-06", "2026-05-15", "感应线圈", "高压风干+绝缘测试", "绝缘电阻 15MΩ"),
]
PHASES = [
    ("2026-07-25 08:00", "2026-07-25 09:00", "startup", 1.0), ("2026-07-25 09:00", "2026-07-25 09:30", "melting", 1.0), ("2026-07-25 09:30", "2026-07-25 10:00", "holding", 0.4),
    ("2026-07-25 10:00", "2026-07-25 10:10", "tapping", 0.0), ("2026-07-25 10:10", "2026-07-25 10:20", "idle", 0.0), ("2026-07-25 10:20", "2026-07-25 11:20", "startup", 1.0),
]
# Names that lead to a procedure, in the procedures' order.
PROCEDURES = [
    ("filter", "过滤器堵塞", ["过滤器", "滤网", "脏堵", "filter_clog"]), ("pump", "水泵气蚀", ["气蚀", "汽蚀", "水泵", "泵", "pump_cavitation"]),
    ("leak", "管道泄漏", ["泄漏", "漏水", "漏点", "密封圈", "3号阀", "管路", "pipe_leak"]), ("scale", "线圈结垢", ["结垢", "线圈", "除垢", "酸洗", "scale_buildup"]),
    ("water", "水质恶化", ["水质", "电导率", "树脂", "纯水", "water_quality"]), ("condensation", "电气柜凝露", ["凝露", "露点", "除湿", "湿度"]),
    ("exchanger", "换热器散热异常", ["换热器", "散热衰退", "进水温度高", "冷却塔", "heat_exchanger"]), ("inspection", "日常巡检与定期维保", ["巡检", "维保", "保养", "日常", "多久", "定期"]),
]
# A fault's name in the ledger's words.
SYNONYMS = {"过滤器堵塞": "过滤器", "水泵气蚀": "水泵", "线圈结垢": "线圈", "水质恶化": "树脂", "管道泄漏": "阀", "电气柜凝露": "电气柜", "换热器散热异常": "换热器"}
# What points at a topic, in the order in which topics are tried, with the flags that tell how case and line breaks count.
ROUTES = [
    ("maintenance", "(?i)维修|检修记录|工单|修过|更换过|保养记录|上次|历史|台账"), ("thresholds", "阈值|报警值|额定|正常范围|多少.*报警|超过.*报警"),
    ("procedure", "(?i)怎么|如何|处理|操作|SOP|排查|巡检|维保|原因|为什么|应对|怎么办"), ("current", "当前|现在|工况|读数|实时|运行状态|正在|目前|炉温|功率"),
    ("current", "(?s)(温度|压力|流量|流速|液位|电流|电导率|湿度).*(多少|多高|多大)|(多少|多高|多大).*(温度|压力|流量|流速|液位|电流|电导率|湿度)"), ("sensors", "(?i)传感器|测点|监测.*[项量]|采集|测量|单位|sensor"),
]
# Dates, spans of days and months in a question.
DATE, DAYS, MONTH = r"20\d{2}-\d{2}-\d{2}", r"(?:最近|近|过去)\s*(\d{1,3})\s*天", r"(?:(20\d{2})[年/-])?(1[0-2]|0?[1-9])月"
# A date or span of time in a question, and words that say nothing about what is asked for.
WHEN_WORDS = r"20\d{2}-\d{2}-\d{2}|(?:(?:20\d{2})年)?\d{1,2}月|(?:最近|近|过去)\s*\d{1,3}\s*天"
FILLERS = r"查找|查询|查一下|查下|查|帮我|请|一下|有关|相关|历史|维修|检修|保养|记录|工单|台账|最近一次|最近|近期|最新|上个月|上次|什么时候|哪天|有哪些|有没有|有无|是否|更换过|修过|所有|全部|这个|上述|上面|它|该|那|的|了|吗|呢|[？?，,。\s]"


def aliases() -> list[tuple[int, str, str, str]]:
    return [(i, key, title, a) for i, (key, title, names) in enumerate(PROCEDURES) for a in names]


def recent(orders: DataFrame, days: int, ref: str | None = None) -> DataFrame:
    """Orders of the last `days` days before ref, else before the newest one. Unreadable dates never count."""
    dated = orders.withColumn("_d", F.try_to_date("date"))
    end = F.lit(ref).cast("date") if ref else F.col("_ref")
    if ref is None:
        dated = dated.join(F.broadcast(dated.agg(F.max("_d").alias("_ref"))))
    return dated.where(F.col("_d") >= F.date_sub(end, days)).drop("_d", "_ref")


def for_component(orders: DataFrame, part: str) -> DataFrame:
    return orders.where(F.contains("component", F.lit(part)))


def ledger_text(orders: DataFrame, days: int = 60) -> DataFrame:
    """One row, text: the recent orders as lines in the ledger's order (column ord)."""
    line = F.concat(F.lit("- ["), F.col("date"), F.lit("] "), F.col("component"), F.lit(": "), F.col("action"), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("（"), F.col("note"), F.lit("）"))).otherwise(""))
    lines = recent(orders, days).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("s")))).alias("x"))
    return lines.select(F.when(F.size("x") == 0, "近期无维修记录").otherwise(F.array_join("x.s", "\n")).alias("text"))


def schedule_text(phases: DataFrame, keep: int = 6) -> DataFrame:
    """One row, text: the last phases as lines; the load as a percentage."""
    line = F.concat(F.lit("- "), F.col("start"), F.lit("~"), F.col("end"), F.lit(" "), F.col("phase"), F.lit(" 负载"), F.round(F.col("load") * 100, 0).cast("int").cast("string"), F.lit("%"))
    lines = phases.orderBy(F.desc("ord")).limit(keep).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("s")))).alias("x"))
    return lines.select(F.when(F.size("x") == 0, "无工况安排").otherwise(F.array_join("x.s", "\n")).alias("text"))


def procedures(questions: DataFrame, names: DataFrame) -> DataFrame:
    """case_id and procedure: that of the longest alias a question holds, of equals the first. Aliases are a fixed few."""
    hit = questions.join(F.broadcast(fixed(names, "the aliases")), F.contains(F.lower("question"), F.lower("alias")))
    best = hit.groupBy("case_id").agg(F.max_by("procedure", F.struct(F.length("alias"), -F.col("ord"))).alias("procedure"))
    return questions.join(best, "case_id", "left")


def route(question: Column, procedure: Column) -> Column:
    out = None
    for topic, words in ROUTES:
        out = F.when(question.rlike(words), topic) if out is None else out.when(question.rlike(words), topic)
    return out.when(procedure.isNotNull(), "procedure").otherwise("unknown")


def keyword(question: Column) -> Column:
    """What a question about the ledger asks for: an order's number, else what is left without dates and fillers; a fault in the
    ledger's words."""
    number = F.nullif(F.regexp_extract(question, "(?i)WO-[A-Za-z0-9-]+", 0), F.lit(""))
    left = F.trim(F.regexp_replace(F.regexp_replace(question, WHEN_WORDS, ""), FILLERS, ""))
    left = F.when(left.isin("设备", "中频炉"), "").otherwise(left)
    word = F.coalesce(number, left)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))[word], word)


def date_range(question: Column, ref: Column) -> tuple[Column, Column]:
    """First and last day a question asks about: N days with today, last month, a month, named days, or lately (30 days)."""
    group = lambda p, k: F.nullif(F.regexp_extract(question, p, k), F.lit(""))
    days, month = group(DAYS, 1).cast("int"), group(MONTH, 2).cast("int")
    start_of = F.make_date(F.coalesce(group(MONTH, 1).cast("int"), F.year(ref)), month, F.lit(1))
    named = F.transform(F.regexp_extract_all(question, F.lit(DATE), F.lit(0)), lambda x: F.try_to_date(x))
    last_month, lately = F.contains(question, F.lit("上个月")), F.regexp_replace(question, "最近一次", "").rlike("近期|最近")
    first_of = F.trunc(ref, "month")
    start = F.when(days.isNotNull(), F.date_sub(ref, F.greatest(F.lit(0), days - 1))).when(last_month, F.add_months(first_of, -1)).when(month.isNotNull(), start_of).when(F.size(named) > 0, F.get(named, F.lit(0))).when(lately, F.date_sub(ref, 29))
    end = F.when(days.isNotNull(), ref).when(last_month, F.date_sub(first_of, 1)).when(month.isNotNull(), F.last_day(start_of)).when(F.size(named) > 0, F.element_at(named, -1)).when(lately, ref)
    return start, end


def search(questions: DataFrame, orders: DataFrame) -> DataFrame:
    """For each question (keyword, since, until) the newest orders that hold all its words: one if it asks for the latest, else 20.
    The ledger is a reference table; total counts all that match."""
    text = F.lower(F.concat_ws(" ", "order_id", "component", "action", "note"))
    ledger = F.broadcast(fixed(orders, "the ledger").withColumns({"_text": text, "_date": F.try_to_date("date")}).where(F.col("_date").isNotNull()))
    words = F.filter(F.split(F.lower("keyword"), r"\s+"), lambda x: x != "")
    meets = F.forall(words, lambda x: F.contains(F.col("_text"), x)) & (F.col("since").isNull() | (F.col("_date") >= F.col("since"))) & (F.col("until").isNull() | (F.col("_date") <= F.col("until")))
    w = Window.partitionBy("case_id").orderBy(F.desc("date"), F.desc("order_id"))
    found = questions.join(ledger, meets).withColumns({"rank": F.row_number().over(w), "total": F.count(F.lit(1)).over(Window.partitionBy("case_id"))})
    keep = F.when(F.col("question").rlike("最近一次|最新|上次"), 1).otherwise(20)
    return found.where(F.col("rank") <= keep).select("case_id", "order_id", "rank", "total")


def provenance(orders: DataFrame, built_in: DataFrame) -> DataFrame:
    """orders with source: whether a row equals a built-in one in every column, nulls included."""
    cols = built_in.columns
    known = F.broadcast(fixed(built_in, "the built-in ledger").select(*(F.col(c).alias(f"_{c}") for c in cols), F.lit(True).alias("_known")))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return orders.join(known, on, "left").withColumn("source", F.when(F.col("_known"), "内置示例").otherwise("运行台账")).drop("_known", *(f"_{c}" for c in cols))
