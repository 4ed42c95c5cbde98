"""Queries over work orders, feedback, the ledger, questions, the equipment picture, forecasts and the live path's batch forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loopwatch.contract import json_safe
from loopwatch.functions import features as f
from loopwatch.operators import context as cx
from loopwatch.operators import graph as g
from loopwatch.operators import orders as od
from loopwatch.operators import rules as r
from loopwatch.operators import scoring as sc
from loopwatch.operators import stream_rules as st
from loopwatch.operators import topology as tp
from loopwatch.plans.common import WITH, inline, panel, r4, r6, table, values
from loopwatch.plans.corpora import KNOWN
from loopwatch.plans.decisions import faults, levels, spark_sql
from loopwatch.plans.sensors import ALERTS, OSC, W, WITH_G, trailing
from loopwatch.sources import store

PARTS, LEVELS, NAMES = g.SPARE_PARTS, g.FAULT_LEVEL, [x for x, _ in g.SPARE_PARTS] + ["其他"]
STEPS = {}
for _f, _a in g.HANDLED_BY:
    STEPS.setdefault(_f, []).append(_a)
SOP = list(STEPS.items())
NAMED = "[" + ", ".join(f"'{x}'" for x in NAMES) + "]"
#: Diagnosed windows: one for each order.
WINDOWS = f"select o_orderkey as case_id, o_orderdate as day, {NAMED}[o_orderkey % 7 + 1] as fault, case o_orderkey % 4 when 0 then 'red' when 1 then 'orange' when 2 then null else 'blue' end as level, o_orderkey % 5 = 0 as manual, o_orderkey % 3 <> 0 as diagnosed from orders"
FINAL = f"(case when manual then 'yellow' when level in ('red', 'orange', 'yellow') then level else coalesce(fl, 'orange') end)"
MANUAL = "case_id % 13 = 0 or case_id % 17 = 1 or (not case_id % 3 <> 0 and case_id % 4 >= 2) or (case_id % 100) / 100e0 < 7e-1"
FEEDBACK = f"select o_orderkey as order_id, {NAMED}[o_orderkey % 7 + 1] as actual, {NAMED}[o_orderkey % 5 + 1] as root_cause, o_orderkey % 3 <> 0 as is_true_fault, case when o_orderkey % 4 <> 0 then 'p' || cast(o_orderkey as varchar) end as prompt, case when o_orderkey % 6 <> 0 then 'o' end as output from orders"
LEDGER = [(i, *row) for i, row in enumerate(cx.LEDGER)]
QUESTIONS = ["查找3号阀的历史维修记录", "最近30天水泵的维修记录", "上个月的工单", "2026年6月的检修记录", "过滤器堵塞怎么处理？", "目前的报警阈值是多少？", "当前是什么工况？", "监测传感器有哪些？", "压力多高", "水泵气蚀最近一次维修", "2026-06-01到2026-06-30的台账", "冷却塔", "你好", "近期更换过什么", "给我Sop", "现场的压力\n大概是多少", "Sensor list", "监测了哪些\n项", "Wo-20260620-0001的工单"]
QUESTION = "[" + ", ".join(f"'{q}'" for q in QUESTIONS) + f"][case_id % {len(QUESTIONS)} + 1]"
ASKED = f"select case_id, {QUESTION} as question from (select o_orderkey as case_id from orders)"
ALIASES = [(i, t, a) for i, _, t, a in cx.aliases()]
REF = "2026-07-25"


def windows(s, d):
    i = F.col("case_id")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").cast("date").alias("day"))
    return o.select("case_id", "day", F.element_at(F.array(*map(F.lit, NAMES)), (i % 7 + 1).cast("int")).alias("fault"), F.when(i % 4 == 0, "red").when(i % 4 == 1, "orange").when(i % 4 == 3, "blue").alias("level"), (i % 5 == 0).alias("manual"), (i % 3 != 0).alias("diagnosed"))


def handled(s, d):
    v = lambda rows, cols: values(s, rows, cols)
    plans = v(od.PLANS, "plan_id, name, fault, steps, forbidden")
    out = od.handled(windows(s, d), v(PARTS, "fault, parts"), v(LEVELS, "fault, level"), plans, v(SOP, "fault, sop"))
    return out.select("case_id", "handled", "order_id", "level", F.array_join("parts", ",").alias("parts"), F.array_join("sop", ">").alias("sop"), "plan_id", F.array_join("forbidden", ",").alias("forbidden"))


HANDLED = f"""with w as ({WINDOWS}), l as (select * from {inline(LEVELS, 'fault, fl')}), p as (select * from {inline([(a, ','.join(b)) for a, b in PARTS], 'fault, parts')}), x as (select * from {inline([(a, '>'.join(b)) for a, b in SOP], 'fault, sop')}),
e as (select * from {inline([(i, f'【应急预案 {i} {n}】>' + '>'.join(s), fa, ','.join(no)) for i, n, fa, s, no in od.PLANS], 'plan_id, steps, fault, forbidden')}),
k as (select w.*, fl, parts, x.sop, e.plan_id, e.steps, e.forbidden, row_number() over (partition by diagnosed, day order by case_id) as n from w left join l on w.fault = l.fault left join p on w.fault = p.fault left join x on w.fault = x.fault left join e on w.fault = e.fault)
select case_id, diagnosed as handled, case when diagnosed then 'WO-' || strftime(day, '%Y%m%d') || '-' || printf('%04d', n) end as order_id, case when diagnosed then {FINAL} end as level, case when diagnosed then coalesce(parts, '') end as parts,
 case when diagnosed then case when {FINAL} = 'red' and plan_id is not null then steps || case when sop is null then '' else '>' || sop end else coalesce(sop, '') end end as sop, case when diagnosed and {FINAL} = 'red' then plan_id end as plan_id, case when diagnosed and {FINAL} = 'red' then forbidden end as forbidden from k"""


def feedback(s, d):
    table(s, d, "orders").createOrReplaceTempView("orders")
    return s.sql(FEEDBACK.replace("varchar", "string").replace("[o_", "@").replace("['", "array('").replace("']@", "')[o_").replace("% 7 + 1]", "% 7]").replace("% 5 + 1]", "% 5]"))


def asked(s, d):
    i = F.col("case_id")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("case_id")).withColumn("question", F.element_at(F.array(*map(F.lit, QUESTIONS)), (i % len(QUESTIONS) + 1).cast("int")))
    q = cx.procedures(o, values(s, ALIASES, "ord, procedure, alias"))
    since, until = cx.date_range(F.col("question"), F.lit(REF).cast("date"))
    return q.withColumns({"topic": cx.route(F.col("question"), F.col("procedure")), "keyword": cx.keyword(F.col("question")), "since": since, "until": until})


def topic_sql() -> str:
    cases = " ".join(f"when regexp_matches(question, '{words}') then '{topic}'" for topic, words in cx.ROUTES)
    return f"case {cases} when procedure is not null then 'procedure' else 'unknown' end"


DAYS_, MONTH_ = cx.DAYS.replace(r"\s", " "), cx.MONTH
WORD = f"trim(regexp_replace(regexp_replace(question, '{cx.WHEN_WORDS}', '', 'g'), '{cx.FILLERS}', '', 'g'))"
ANSWERED = f"""with q as ({ASKED}), h as (select q.case_id, arg_max(procedure, (length(alias), -ord)) as procedure from q join {inline(ALIASES, 'ord, procedure, alias')} on contains(lower(question), lower(alias)) group by 1),
a as (select q.*, procedure from q left join h on q.case_id = h.case_id), b as (select *, {topic_sql()} as topic, case when {WORD} in ('设备', '中频炉') then '' else {WORD} end as w, date '{REF}' as ref, try_cast(nullif(regexp_extract(question, '{cx.DAYS}', 1), '') as integer) as days, try_cast(nullif(regexp_extract(question, '{cx.MONTH}', 2), '') as integer) as mon, try_cast(nullif(regexp_extract(question, '{cx.MONTH}', 1), '') as integer) as yr, regexp_extract_all(question, '{cx.DATE}') as named, regexp_matches(replace(question, '最近一次', ''), '近期|最近') as lately from a),
c as (select case_id, question, procedure, topic, case w {' '.join(f"when '{k}' then '{v}'" for k, v in cx.SYNONYMS.items())} else w end as keyword,
 case when days is not null then ref - cast(greatest(0, days - 1) as integer) when contains(question, '上个月') then cast(date_trunc('month', ref) - interval 1 month as date) when mon is not null then make_date(coalesce(yr, year(ref)), mon, 1) when len(named) > 0 then cast(named[1] as date) when lately then ref - 29 end as since,
 case when days is not null then ref when contains(question, '上个月') then cast(date_trunc('month', ref) - interval 1 day as date) when mon is not null then last_day(make_date(coalesce(yr, year(ref)), mon, 1)) when len(named) > 0 then cast(named[-1] as date) when lately then ref end as until from b)"""
LED = inline(LEDGER, "ord, order_id, date, component, action, note")
ISSUE = "select o_orderkey as case_id, case o_orderkey % 5 when 0 then null when 1 then 'pump' when 2 then 'tank' else 'power' end as node, case o_orderkey % 3 when 0 then 'warning' when 1 then 'fault' else 'critical' end as level from orders union all select o_orderkey, 'pump', 'warning' from orders where o_orderkey % 2 = 0"
LIVE = f"{WITH_G}, c as (select *, coalesce(count({KNOWN}) {trailing(30)} >= 5 and min({KNOWN}) {trailing(30)} <> max({KNOWN}) {trailing(30)}, false) as changing from dm), l as (select *, coalesce(t - max(case when changing then t end) over (partition by device_id order by t rows between unbounded preceding and current row) < 600, false) as locked, coalesce(sum(cast(pressure > 300 as integer)) {trailing(60)} >= 25, false) as sustained from c), z as (select *, coalesce(outlet_temp > 55 and flow_rate < 64e-1 or outlet_temp > 74 or (not locked and sustained), false) and t + 1 >= 600 as fault from l)"


def live(s, d):
    rows = panel(s, d).select("device_id", "t", "operating_condition", "pressure", "outlet_temp", "flow_rate")
    df = st.watched(rows, F.col("pressure") > 300)
    return st.triggers(df, (F.col("outlet_temp") > 55) & (F.col("flow_rate") < 6.4), F.col("outlet_temp") > 74)


def forecasts(s, d):
    """Two forecasts for each block of a hundred readings; every fifth block lacks the precise one."""
    b = panel(s, d).groupBy("device_id", F.floor(F.col("t") / 100).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "outlet_temp"))), lambda x: x["outlet_temp"]).alias("x"))
    return b.select("device_id", "block", F.when(F.col("block") % 5 != 0, F.col("x")).alias("precise"), F.transform("x", lambda v: v + 1.0).alias("fast"), F.when(F.col("block") % 2 == 0, "precise").otherwise("fast").alias("track"))


BLOCKS = f"{WITH}, b as (select device_id, t // 100 as block, array_agg(outlet_temp order by t) as x from panel group by 1, 2)"

QUERIES = {
    "g_manual": (
        lambda s, d: windows(s, d).select("case_id", od.manual_required((F.col("case_id") % 100) / 100.0, F.col("case_id") % 17 != 1, F.when(F.col("case_id") % 13 == 0, "timeout"), od.passed(F.col("case_id") % 3 != 0, F.lit(True)), (F.col("case_id") % 4).cast("int"), F.lit(False)).alias("manual")),
        f"select case_id, {MANUAL} as manual from ({WINDOWS})",
    ),
    "g_level": (
        lambda s, d: windows(s, d).select("case_id", od.rolled_level(F.col("diagnosed"), F.col("level"), F.col("manual"), F.col("case_id") % 2 == 0, F.col("case_id") % 7 == 0).alias("level")),
        f"select case_id, case when diagnosed then case when manual then 'yellow' else coalesce(level, 'orange') end when case_id % 2 = 0 or case_id % 7 = 0 then 'yellow' else 'none' end as level from ({WINDOWS})",
    ),
    "g_handled": (handled, HANDLED),
    "a_notified": (
        lambda s, d: od.notified(g.fan_out(levels(s, d), values(s, g.PUSH, "level, channels, receivers"))).select("order_id", "total", F.array_join("channels", ",").alias("channels"), F.array_join("receivers", ",").alias("receivers")),
        f"select o_orderkey as order_id, case o_orderkey % 4 when 0 then 9 when 1 then 4 else 1 end as total, case o_orderkey % 4 when 0 then 'phone,sms,sound_light_alarm' when 1 then 'mobile_app,sms' else 'mobile_app' end as channels, case o_orderkey % 4 when 0 then '{','.join(sorted(g.PUSH[0][2]))}' when 1 then '{','.join(sorted(g.PUSH[1][2]))}' else '{g.PUSH[2][2][0]}' end as receivers from orders",
    ),
    "a_notified_by_level": (lambda s, d: od.notified_by_level(g.fan_out(levels(s, d), values(s, g.PUSH, "level, channels, receivers"))), "select case o_orderkey % 4 when 0 then 'red' when 1 then 'orange' when 2 then 'yellow' else 'blue' end as level, cast(sum(case o_orderkey % 4 when 0 then 9 when 1 then 4 else 1 end) as bigint) as total from orders group by 1"),
    "j_feedback_snapshot": (
        lambda s, d: od.with_snapshot(feedback(s, d).select("order_id", "actual"), feedback(s, d).where("order_id % 2 = 0").select("order_id", "prompt", F.col("order_id").alias("at"))),
        f"with f as ({FEEDBACK}) select f.order_id, f.actual, x.prompt from f left join (select order_id, prompt from f where order_id % 2 = 0 order by order_id desc limit 200) x on f.order_id = x.order_id",
    ),
    "a_feedback_stats": (lambda s, d: od.feedback_stats(feedback(s, d)), f"with f as ({FEEDBACK}), n as (select count(*) as total, count(*) filter (where is_true_fault) as t from f) select total, t as true_faults, total - t as false_alarms, t > 0 as pending, t >= 5 as retrain, total >= 5 as retrain_by_lines from n"),
    "g_preference_pairs": (lambda s, d: od.preference_pairs(feedback(s, d)), f"select order_id, prompt, coalesce(output, '') as rejected, actual as actual_root_cause, root_cause as model_root_cause from ({FEEDBACK}) where is_true_fault and prompt is not null and actual <> root_cause"),
    "b_feedback_samples": (
        lambda s, d: od.feedback_samples(feedback(s, d), values(s, SOP, "fault, sop")).select("order_id", "prompt", "gold", "kind", F.sha2("assistant", 256).alias("mark")),
        f"with f as ({FEEDBACK}), x as (select * from {inline([(a, ','.join(chr(34) + y + chr(34) for y in b)) for a, b in SOP], 'fault, sop')}) select order_id, prompt, actual as gold, 'feedback' as kind, sha256('（人工反馈校正）经运维复核，实际根因为' || actual || '，依据现场处置确认。' || chr(10) || '{{\"root_cause\":\"' || actual || '\",\"confidence\":0.85,\"evidence\":[\"人工复核确认根因（反馈校正样本）\"],\"sop\":[' || coalesce(sop, '') || ']}}') as mark from f left join x on f.actual = x.fault where is_true_fault and prompt is not null",
    ),
    "g_ledger_append": (lambda s, d: od.learnt(feedback(s, d), F.lit(REF)), f"select order_id, '{REF}' as date, actual as component, '故障处置（反馈驱动记录）' as action, '持续优化智能体自动归档' as note from ({FEEDBACK}) where is_true_fault and actual <> root_cause"),
    "g_question_route": (lambda s, d: asked(s, d).select("case_id", "procedure", "topic"), f"{ANSWERED} select case_id, procedure, topic from c"),
    "g_question_range": (lambda s, d: asked(s, d).select("case_id", "keyword", F.col("since").cast("string").alias("since"), F.col("until").cast("string").alias("until")), f"{ANSWERED} select case_id, keyword, cast(since as varchar) as since, cast(until as varchar) as until from c"),
    "g_maintenance_search": (
        lambda s, d: cx.search(asked(s, d).where("topic = 'maintenance'"), values(s, LEDGER, "ord, order_id, date, component, action, note")),
        f"{ANSWERED}, m as (select c.case_id, question, order_id, row_number() over (partition by c.case_id order by date desc, order_id desc) as rank, count(*) over (partition by c.case_id) as total from c join {LED} on (keyword = '' or contains(lower(concat_ws(' ', order_id, component, action, note)), lower(keyword))) and (since is null or cast(date as date) >= since) and (until is null or cast(date as date) <= until) where topic = 'maintenance') select case_id, order_id, cast(rank as integer) as rank, total from m where rank <= case when regexp_matches(question, '最近一次|最新|上次') then 1 else 20 end",
    ),
    "j_provenance": (
        lambda s, d: cx.provenance(od.learnt(feedback(s, d), F.lit(REF)).withColumn("order_id", F.col("order_id").cast("string")).unionByName(values(s, cx.LEDGER, "order_id, date, component, action, note")), values(s, cx.LEDGER, "order_id, date, component, action, note")).groupBy("source").agg(F.count(F.lit(1)).alias("n")),
        f"select '运行台账' as source, count(*) as n from ({FEEDBACK}) where is_true_fault and actual <> root_cause union all select '内置示例', 6",
    ),
    "j_cause_nodes": (
        lambda s, d: tp.cause_nodes(faults(s, d).select(F.col("order_id").alias("case_id"), F.concat(F.col("fault"), F.when(F.col("order_id") % 3 == 0, "、补水阀卡开").otherwise("")).alias("cause")), values(s, tp.cause_aliases(), "node, alias")),
        f"with c as (select case_id, fault || case when case_id % 3 = 0 then '、补水阀卡开' else '' end as cause from ({WINDOWS})) select distinct case_id, node from c join {inline(tp.cause_aliases(), 'node, alias')} on contains(cause, alias)",
    ),
    "f_node_levels": (
        lambda s, d: tp.node_levels(spark_sql(s, d, ISSUE, "orders")),
        f"with i as ({ISSUE}) select case_id, node, case max(case level when 'warning' then 1 when 'fault' then 2 else 3 end) when 1 then 'warning' when 2 then 'fault' else 'critical' end as level, count(*) as n_issues from i where node is not null group by 1, 2",
    ),
    "f_topology_state": (
        lambda s, d: panel(s, d).select("device_id", "t", tp.shown_status(F.when(F.col("t") % 4 == 0, "stopped").otherwise("running"), F.when(F.col("t") % 50 != 0, F.col("t") % 60)).alias("status"), r6(tp.flow_seconds(F.when(F.col("t") % 9 != 0, F.col("flow_rate")).otherwise(0.0))).alias("seconds"), tp.finding_level(F.col("t") % 5 == 0, F.col("t") % 7 == 0, F.when(F.col("t") % 3 == 0, "red").otherwise("orange")).alias("level")),
        f"{WITH} select device_id, t, case when t % 4 = 0 then 'stopped' when t % 50 = 0 or t % 60 > 30 then 'stale' else 'running' end as status, round(case when t % 9 = 0 then 0 else greatest(6e-1, least(8e0, 24e-1 * 8 / flow_rate)) end, 6) as seconds, case when t % 5 = 0 or t % 7 = 0 then 'warning' when t % 3 = 0 then 'critical' else 'fault' end as level from panel",
    ),
    "t_dew_trend": (
        lambda s, d: st.dew_trend(panel(s, d)),
        f"{WITH_G}, m as (select device_id, t, margin, regr_slope(margin, t) {trailing(120)} as s from dm) select device_id, t, round((margin - 3) / -s, 1) as eta from m where t + 1 >= 600 and (t + 1) % 60 = 0 and s < 0 and margin >= 3 and (margin - 3) / -s <= 600",
    ),
    "t_triggers": (lambda s, d: live(s, d).select("device_id", "t", "fault"), f"{LIVE} select device_id, t, fault from z"),
    "t_diagnosed": (
        lambda s, d: st.diagnosed(live(s, d)).select("device_id", "t"),
        f"{LIVE.replace('with ', 'with recursive ', 1)}, h as (select device_id, t, t + 10 as free from z where fault), n as (select a.device_id, a.t, b.t as later from h a asof left join h b on a.device_id = b.device_id and a.free <= b.t), g as (select device_id, t, later from n where (device_id, t) in (select (device_id, min(t)) from h group by device_id) union all select n.device_id, n.t, n.later from g join n on n.device_id = g.device_id and n.t = g.later) select device_id, t from g",
    ),
    "t_once": (lambda s, d: st.once(live(s, d).where("fault"), ["device_id"], ["t"]).select("device_id", "t"), f"{LIVE} select device_id, min(t) as t from z where fault group by 1"),
    "t_forecast_throttle": (lambda s, d: panel(s, d).select("device_id", "t", F.coalesce(st.throttled_at(599, 60), F.lit(-1)).alias("taken")), f"{WITH} select device_id, t, case when t >= 599 then 599 + (t - 599) // 60 * 60 else -1 end as taken from panel"),
    "t_freshness": (lambda s, d: st.freshness(panel(s, d), F.lit(14_020)), f"{WITH} select device_id, max(t) as last_t, round(greatest(0, 14020 - max(t)), 1) as age, greatest(0, 14020 - max(t)) <= 30 as fresh from panel group by 1"),
    "t_sessions_reset": (
        lambda s, d: st.sustained(panel(s, d).withColumn("device_id", F.col("device_id") * 1000 + F.floor(F.col("t") / 5000)), F.col("pressure") > 300).groupBy("device_id").agg(F.count_if("sustained").alias("n")),
        f"{WITH}, x as (select device_id * 1000 + t // 5000 as k, t, coalesce(sum(cast(pressure > 300 as integer)) over (partition by device_id * 1000 + t // 5000 order by t rows between 59 preceding and current row) >= 25, false) as sustained from panel) select k as device_id, count(*) filter (where sustained) as n from x group by 1",
    ),
    "l_zscore_pop": (lambda s, d: sc.zscore_pop(panel(s, d), "pressure").select("device_id", "t", F.round("z", 5).alias("z")), f"{WITH}, b as (select device_id, avg(pressure) as m, stddev_pop(pressure) as s from panel group by 1) select p.device_id, t, round((pressure - m) / (s + 1e-6), 5) as z from panel p join b on p.device_id = b.device_id"),
    "l_window_tensors": (
        lambda s, d: sc.DistanceScorer().score(sc.window_tensors(panel(s, d), ["flow_rate", "flow_velocity"], 60)).select("device_id", "t", r6("score").alias("score"), r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v[0])).alias("total")),
        f"{WITH}, x as (select *, count(*) {trailing(60)} as n, sum(flow_rate) {trailing(60)} as total from panel) select device_id, t, round(sqrt((flow_rate * flow_rate + flow_velocity * flow_velocity) / 2), 6) as score, round(total, 6) as total from x where n = 60",
    ),
    "l_training_pairs": (
        lambda s, d: sc.training_pairs(panel(s, d), "outlet_temp", 600, 60, 300, 10).select("device_id", "start", F.size("x").cast("long").alias("n_x"), F.size("y").cast("long").alias("n_y"), r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("sum_x"), r6(F.aggregate("y", F.lit(0.0), lambda a, v: a + v)).alias("sum_y")),
        f"{WITH}, n as (select device_id, max(t) + 1 as n from panel group by 1), s as (select device_id, unnest(range(0, n - 660, 300)) as start from n) select s.device_id, start, 60 as n_x, 60 as n_y, round(sum(outlet_temp) filter (where t - start < 600 and (t - start) % 10 = 0), 6) as sum_x, round(sum(outlet_temp) filter (where t - start >= 600) - 60 * max(outlet_temp) filter (where t - start = 599), 6) as sum_y from s join panel p on p.device_id = s.device_id and t >= start and t < start + 660 group by 1, 2",
    ),
    "l_decomposed": (
        lambda s, d: sc.decomposed(panel(s, d), "furnace_temp", 600).select("device_id", "t", *(r4(c).alias(c) for c in ("trend", "seasonal", "resid"))),
        f"{WITH}, a as (select *, avg(furnace_temp) over (partition by device_id order by t rows between 60 preceding and 59 following) as trend from panel), b as (select device_id, t % 600 as k, avg(furnace_temp - trend) as seasonal from a group by 1, 2) select a.device_id, t, round(trend, 4) + 0e0 as trend, round(seasonal, 4) + 0e0 as seasonal, round(furnace_temp - trend - seasonal, 4) + 0e0 as resid from a join b on a.device_id = b.device_id and a.t % 600 = b.k",
    ),
    "l_forecast_summary": (
        lambda s, d: forecasts(s, d).select("device_id", "block", (x := sc.forecast_summary(F.col("fast")))["end"].alias("end"), x["max"].alias("max"), x["min"].alias("min"), F.size(x["series"]).cast("long").alias("n")),
        f'{BLOCKS} select device_id, block, round_even(x[-1] + 1, 2) as "end", round_even(list_max(x) + 1, 2) as max, round_even(list_min(x) + 1, 2) as min, cast(ceil(len(x) / cast(greatest(1, len(x) // 30) as double)) as bigint) as n from b',
    ),
    "l_routed": (
        lambda s, d: forecasts(s, d).select("device_id", "block", (x := sc.routed(F.col("track"), F.col("precise"), F.col("fast"), F.lit(50), 20))["track"].alias("track"), x["horizon"].cast("long").alias("horizon"), x["degraded"].alias("degraded"), r6(F.element_at(x["series"], 1)).alias("first"), F.size(x["series"]).cast("long").alias("n")),
        f"{BLOCKS} select device_id, block, case when block % 2 <> 0 then 'fast' when block % 5 = 0 then 'fast_degraded' else 'precise' end as track, case when block % 10 = 0 then 20 else 50 end as horizon, block % 10 = 0 as degraded, round(x[1] + case when block % 2 = 0 and block % 5 <> 0 then 0 else 1 end, 6) as first, least(len(x), case when block % 10 = 0 then 20 else 50 end) as n from b",
    ),
    "l_archived": (
        lambda s, d: sc.archived(panel(s, d).withColumn("window_id", F.floor(F.col("t") / 300)).groupBy("device_id", "window_id").agg(F.count_if(F.col("outlet_temp") > 70).alias("n_alerts"), (F.max("pressure") / 600).alias("score"), F.count(F.lit(1)).alias("n"))).select("device_id", "window_id", "filtered", r6("ratio").alias("ratio")),
        f"{WITH}, w as (select device_id, t // 300 as window_id, count(*) filter (where outlet_temp > 70) as a, max(pressure) / 600 as s, count(*) as n from panel group by 1, 2), x as (select *, a = 0 and s < 6e-1 as filtered from w) select device_id, window_id, filtered, round(sum(case when filtered then n else 0 end) over u / cast(sum(n) over u as double), 6) as ratio from x window u as (partition by device_id order by window_id rows between unbounded preceding and current row)",
    ),
    "s_count": (lambda s, d: store.count(panel(s, d)), f"{WITH} select count(*) as n_rows from panel"),
    "s_latest_series": (
        lambda s, d: store.latest_series(panel(s, d), ["outlet_temp", "pressure"], 50).select("device_id", F.size("t").cast("long").alias("n"), r6(F.element_at("outlet_temp", 1)).alias("first"), r6(F.element_at("pressure", -1)).alias("last")),
        f"{WITH}, k as (select *, row_number() over (partition by device_id order by t desc) as k from panel) select device_id, count(*) as n, round(arg_min(outlet_temp, t), 6) as first, round(arg_max(pressure, t), 6) as last from k where k <= 50 group by 1",
    ),
    "s_json_safe": (
        lambda s, d: json_safe(table(s, d, "events").select("event_id", "ts", F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value")).alias("value"))).select("event_id", F.substring("ts", 1, 19).alias("ts"), r6("value").alias("value")),
        "select event_id, substr(cast(ts as varchar), 1, 19) as ts, case when event_id % 5 = 0 or event_id % 7 = 0 then null else round(value, 6) end as value from events",
    ),
    "s_strict_json": (
        lambda s, d: store.strict_json(table(s, d, "events").select(F.when(F.col("event_id") % 9 == 0, '{"k": NaN}').when(F.col("event_id") % 11 == 0, '{"s": "say \\"NaN\\" \\\\", "k": -1}').when(F.col("event_id") % 13 == 0, '{"s": "a\\\\", "k": Infinity}').when(F.col("event_id") % 7 == 0, '{"k": 1, oops}').when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("props")).alias("value")), "k long").groupBy("k").agg(F.count(F.lit(1)).alias("n")),
        "select case when event_id % 11 = 0 then -1 else cast(json_extract_string(props, '$.k') as bigint) end as k, count(*) as n from events where event_id % 9 <> 0 and (event_id % 11 = 0 or event_id % 13 <> 0 and event_id % 7 <> 0 and event_id % 5 <> 0) group by 1",
    ),
    "r_alert_kinds": (
        lambda s, d: r.in_order(r.row_alerts(panel(s, d))).groupBy("rule_id", "level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("device_id").alias("n_devices")),
        f"{ALERTS} select rule_id, 'yellow' as level, count(*) as n, count(distinct device_id) as n_devices from row_alerts group by 1",
    ),
    "f_swing": (
        lambda s, d: panel(s, d).groupBy("device_id", F.floor(F.col("t") / 7).alias("w")).agg(r6(f.swing("pressure")).alias("swing")),
        f"{WITH} select device_id, t // 7 as w, round(stddev_pop(pressure), 6) as swing from panel group by 1, 2",
    ),
}
