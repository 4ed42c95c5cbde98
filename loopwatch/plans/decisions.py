"""Queries over the fault graph, decisions and actions, and metrics over labelled rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopwatch.functions.scans import numbered
from loopwatch.operators import graph as g
from loopwatch.operators import metrics as m
from loopwatch.plans.common import WITH, inline, panel, r6, table, values

IND, HB = g.numbered(g.INDICATES), g.numbered(g.HANDLED_BY)
SENSOR_NAMES = ["出水温度", "进水温度", "压力", "流量", "水箱液位", "电导率", "湿度", "电气柜温度"]
#: A case for each order: three sensors picked by its key.
CASE_SQL = "select o_orderkey as case_id, unnest([o_orderkey % 8, (o_orderkey // 8) % 8, (o_orderkey // 64) % 8]) as k from orders"
SCHEDULE = [(0, 3600, "startup", 1.0), (3600, 5400, "melting", 1.0), (5400, 7200, "holding", 0.4), (7200, 7800, "tapping", 0.0), (7800, 8400, "idle", 0.0), (8400, 12000, "startup", 1.0)]
#: Stand-in scores: labels of documents against a rule on their length.
SCORED = "select l.doc_id, l.quality as gold, case when d.n_chars > 400 then 1 else 0 end as pred, d.lang as kind, (d.doc_id % 100) / 100e0 as conf, case when d.n_chars > 400 then 1 else 0 end = l.quality as correct from labels l join documents d on l.doc_id = d.doc_id"
SETS = "select l.doc_id, case when l.quality = 1 then ['good'] else ['bad'] end || case when l.toxic = 1 then ['toxic'] else [] end as gold, case when d.n_chars > 400 then ['good'] else ['bad'] end || case when d.n_chars % 9 = 0 then ['toxic'] else [] end as pred from labels l join documents d on l.doc_id = d.doc_id"
STATS = "select o_orderkey as case_id, case when o_orderkey % 7 = 0 then null else 40e0 + o_orderkey % 45 end as hum, o_orderkey % 9 - 2e0 as dh, 140e0 + o_orderkey % 130 as p, case when o_orderkey % 11 = 3 then null else o_orderkey % 5 + 5e-1 end as ps, 5e0 + (o_orderkey % 40) / 10e0 as q, o_orderkey % 20 - 5e0 as pq, o_orderkey % 30 + 0e0 as dt from orders"
N = ", ".join(f"'{x}'" for x in SENSOR_NAMES)


def cases(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("case_id"))
    k = F.explode(F.array(F.col("case_id") % 8, F.floor(F.col("case_id") / 8) % 8, F.floor(F.col("case_id") / 64) % 8))
    return o.select("case_id", k.alias("k")).select("case_id", F.element_at(F.array(*map(F.lit, SENSOR_NAMES)), (F.col("k") + 1).cast("int")).alias("sensor"))


def spark_sql(s, d, sql, *tables):
    for t in tables:
        table(s, d, t).createOrReplaceTempView(t)
    return s.sql(sql.replace("[]", "cast(array() as array<string>)").replace("['", "array('").replace("']", "')").replace("//", "div"))


def scored(s, d):
    return spark_sql(s, d, SCORED, "labels", "documents")


def sets(s, d):
    return spark_sql(s, d, SETS, "labels", "documents")


def stats(s, d):
    return spark_sql(s, d, STATS, "orders")


C = lambda *names: [F.col(n) for n in names]
ARB = """select case_id, ['管道泄漏', '线圈结垢', '过滤器堵塞', '水泵气蚀'][case_id % 4 + 1] as model, (case_id % 50) / 50e0 as conf,
 ['过滤器堵塞', '管道泄漏', '线圈结垢'][case_id % 3 + 1] as top, ['水泵气蚀', '线圈结垢', '管道泄漏'][case_id % 3 + 1] as second, case_id % 5 = 0 as has_extra, coalesce(hum, 5e1) as hum, dh, coalesce(ps, 0) as ps, pq from st"""


def arbitrated(s, d):
    st = stats(s, d)
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("case_id") % n + 1).cast("int"))
    df = st.select("case_id", pick(["管道泄漏", "线圈结垢", "过滤器堵塞", "水泵气蚀"], 4).alias("model"), ((F.col("case_id") % 50) / 50.0).alias("conf"), F.array(pick(["过滤器堵塞", "管道泄漏", "线圈结垢"], 3), pick(["水泵气蚀", "线圈结垢", "管道泄漏"], 3)).alias("candidates"), F.when(F.col("case_id") % 5 == 0, F.array(F.lit("水质恶化"))).otherwise(F.expr("cast(array() as array<string>)")).alias("extras"), "hum", "dh", "ps", "pq")
    return g.arbitrate(df).select("case_id", "cause", r6("confidence").alias("confidence"))


CLIP = lambda x: f"greatest(least({x}, 85e-2), 7e-1)"
ARBITRATE = f"""with st as ({STATS}), a as ({ARB}),
b as (select *, case when model = top then top when model = second and conf >= 8e-1 then model else top end as c1, case when model = top then least(conf + 1e-1, 98e-2) when model = second and conf >= 8e-1 then conf else greatest(conf - 1e-1, 5e-1) end as f1 from a),
c as (select *, case when has_extra and c1 <> '水质恶化' then '水质恶化' else c1 end as c2, case when has_extra and c1 <> '水质恶化' then {CLIP('conf')} else f1 end as f2 from b),
e as (select *, c2 = '管道泄漏' and hum <= 65 and dh <= 4 as dry, c2 in ('过滤器堵塞', '线圈结垢') and dh > 4 as wet from c),
f as (select *, case when dry and ps > 3 then '水泵气蚀' when not dry and wet then '管道泄漏' else c2 end as c3, case when dry then least(f2, 75e-2) when wet then {CLIP('f2')} else f2 end as f3 from e)
select case_id, case when c3 = '过滤器堵塞' and dh <= 4 and ps <= 3 and pq >= 10 then '线圈结垢' else c3 end as cause, round(case when c3 = '过滤器堵塞' and dh <= 4 and ps <= 3 and pq >= 10 then {CLIP('f3')} else f3 end, 6) as confidence from f"""
PRE = f"""with st as ({STATS}), x as (select case_id, coalesce(hum, 50) > 70 or (dh > 4 and (q < 78e-1 or p < 240)) as leak, * exclude (case_id) from st)
select case_id, coalesce(array_to_string(list_filter([case when leak then '管道泄漏' when ps > 3 then '水泵气蚀' end, case when q < 64e-1 and not leak then case when pq >= 10 then '线圈结垢' else '过滤器堵塞' end when q >= 64e-1 and dt > 20 and dh <= 4 then '线圈结垢' end], lambda v: v is not null), ','), '') as causes from x"""
FALLBACK = f"""with st as ({STATS}) select case_id, case when hum > 70 then '管道泄漏' when dh > 4 and (q < 78e-1 or p < 240) then '管道泄漏' when coalesce(ps, 0) > 3 and (hum is null or hum <= 65) then '水泵气蚀'
 when q < 64e-1 and p > 230 then '线圈结垢' when q < 64e-1 and (hum is null or hum <= 70) and coalesce(ps, 0) < 3 then '过滤器堵塞' when dt > 20 and p > 200 then '线圈结垢' when p >= 150 and p < 200 and q < 75e-1 then '水泵气蚀' else '未知故障' end as cause from st"""
PHYS = " + ".join(f"(case when {c} < {lo!r} or {c} > {hi!r} then 1 else 0 end)" for c, (lo, hi) in g.LIMITS.items()) + " + (case when outlet_temp < inlet_temp - 1 then 1 else 0 end)"
BOOT = f"""with sc as ({SCORED}), c as (select kind, cast(sum(cast(correct as integer)) as double) as a, cast(sum(cast(conf > 5e-1 as integer)) as double) as b, count(*) as n, row_number() over (order by substr(md5(kind), 1, 2), kind) as k from sc group by kind),
p as (select d.draw, c.k as slot, 1 + cast(('0x' || substr(md5('7-' || cast(draw as varchar) || '-' || cast(c.k as varchar)), 1, 8)) as bigint) % (select count(*) from c) as pick from c, (select unnest(range(200)) as draw) d),
m as (select draw, sum(c.a) / sum(c.n) as a, sum(c.b) / sum(c.n) as b from p join c on p.pick = c.k group by draw), x as (select 'a' as method, a as m from m union all select 'b', b from m union all select 'b-a', b - a from m) select method, round(quantile_cont(m, 0.025), 6) as lo, round(quantile_cont(m, 0.975), 6) as hi, round(avg(m), 6) as mean from x group by 1"""
LEVELS = "select o_orderkey as order_id, ['red', 'orange', 'yellow', 'blue'][o_orderkey % 4 + 1] as level from orders"


def levels(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.element_at(F.array(*map(F.lit, ("red", "orange", "yellow", "blue"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("level"))


def faults(s, d):
    names = [f for f, _ in g.SPARE_PARTS] + ["其他"]
    return table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("fault"))


FAULTS = "select o_orderkey as order_id, [" + ", ".join(f"'{f}'" for f, _ in g.SPARE_PARTS) + ", '其他'][o_orderkey % 7 + 1] as fault from orders"

QUERIES = {
    "j_candidates": (
        lambda s, d: g.candidates(cases(s, d), values(s, IND, "ord, fault, sensor")),
        f"with c as ({CASE_SQL}), a as (select distinct case_id, [{N}][k + 1] as sensor from c), h as (select case_id, fault, count(*) as hits, min(ord) as ord from a join {inline(IND, 'ord, fault, sensor')} on a.sensor = v.sensor group by 1, 2), r as (select *, cast(row_number() over (partition by case_id order by hits desc, ord) as integer) as rank from h) select case_id, fault, hits, rank from r where rank <= 3",
    ),
    "j_causal_path": (
        lambda s, d: cases(s, d).distinct().join(faults(s, d).withColumnRenamed("order_id", "case_id"), "case_id").join(F.broadcast(values(s, g.INDICATES, "fault, sensor")), ["fault", "sensor"], "left_semi").select("case_id", "fault", "sensor"),
        f"with c as ({CASE_SQL}), a as (select distinct case_id, [{N}][k + 1] as sensor from c), f as ({FAULTS}), i as (select * from {inline(g.INDICATES, 'fault, sensor')}) select case_id, fault, sensor from a join f on a.case_id = f.order_id where exists (select 1 from i where i.fault = f.fault and i.sensor = a.sensor)",
    ),
    "j_effects": (
        lambda s, d: faults(s, d).join(F.broadcast(values(s, g.CAUSES, "fault, effect")), "fault").select("order_id", "effect"),
        f"with f as ({FAULTS}) select order_id, effect from f join {inline(g.CAUSES, 'fault, effect')} on f.fault = v.fault",
    ),
    "j_unknown_cause": (lambda s, d: g.unknown_causes(faults(s, d), values(s, g.INDICATES, "fault, sensor")).select("order_id", "fault"), f"with f as ({FAULTS}) select order_id, fault from f where fault = '其他'"),
    "j_actions": (
        lambda s, d: faults(s, d).join(F.broadcast(values(s, HB, "ord, fault, action").groupBy("fault").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "action"))), lambda x: x["action"]), ",").alias("actions"))), "fault", "left"),
        f"with f as ({FAULTS}), a as (select fault, string_agg(action, ',' order by ord) as actions from {inline(HB, 'ord, fault, action')} group by 1) select f.fault, order_id, actions from f left join a on f.fault = a.fault",
    ),
    "j_kg_violations": (
        lambda s, d: g.unsupported(cases(s, d).distinct().join(faults(s, d).withColumnRenamed("order_id", "case_id"), "case_id"), values(s, IND, "ord, fault, sensor")).select("case_id", "fault", "sensor"),
        f"with c as ({CASE_SQL}), a as (select distinct case_id, [{N}][k + 1] as sensor from c), f as ({FAULTS}), i as (select * from {inline(IND, 'ord, fault, sensor')}) select case_id, fault, sensor from a join f on a.case_id = f.order_id where sensor in (select sensor from i) and not exists (select 1 from i where i.fault = f.fault and i.sensor = a.sensor)",
    ),
    "g_physics": (lambda s, d: panel(s, d).select("device_id", "t", F.size(g.physics_violations(F.array(F.when(F.col("t") % 50 == 0, "出水温度低于进水属正常").otherwise("正常")))).cast("long").alias("n")), f"{WITH} select device_id, t, cast({PHYS} as bigint) + case when t % 50 = 0 then 1 else 0 end as n from panel"),
    "g_conf_gate": (lambda s, d: scored(s, d).groupBy(g.confidence_gate(F.col("conf")).alias("gate")).agg(F.count(F.lit(1)).alias("n")), f"with sc as ({SCORED}) select case when conf >= 9e-1 then 'direct' when conf >= 7e-1 then 'candidates' else 'manual' end as gate, count(*) as n from sc group by 1"),
    "g_cascade_gate": (
        lambda s, d: stats(s, d).select("case_id", g.cascade_gate(F.col("case_id") % 11 != 0, F.col("case_id") % 7 != 1, F.col("case_id") % 5 != 2, F.lit("a"), F.when(F.col("case_id") % 3 == 0, F.array(F.lit("b"))).when(F.col("case_id") % 3 == 1, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("a")))).alias("reason")),
        "select o_orderkey as case_id, case when o_orderkey % 11 = 0 then 'endpoint' when o_orderkey % 7 = 1 then 'parse' when o_orderkey % 5 = 2 then 'check' when o_orderkey % 3 = 0 then 'candidate' end as reason from orders",
    ),
    "g_precheck": (lambda s, d: stats(s, d).select("case_id", F.array_join(g.precheck(*C("hum", "dh", "p", "ps", "q", "pq", "dt")), ",").alias("causes")), PRE),
    "g_fallback": (lambda s, d: stats(s, d).select("case_id", g.fallback(*C("hum", "dh", "p", "ps", "q", "dt"), F.lit(None).cast("string")).alias("cause")), FALLBACK),
    "g_arbitrate": (arbitrated, ARBITRATE),
    "j_spare_parts": (
        lambda s, d: faults(s, d).join(F.broadcast(values(s, g.SPARE_PARTS, "fault, parts")), "fault", "left").join(F.broadcast(values(s, g.FAULT_LEVEL, "fault, level")), "fault", "left").select("order_id", "fault", F.coalesce(F.array_join("parts", ","), F.lit("")).alias("parts"), F.coalesce("level", F.lit("orange")).alias("level")),
        f"with f as ({FAULTS}) select order_id, f.fault, coalesce(parts, '') as parts, coalesce(level, 'orange') as level from f left join {inline([(a, ','.join(b)) for a, b in g.SPARE_PARTS], 'fault, parts')} on f.fault = v.fault left join (select * from {inline(g.FAULT_LEVEL, 'fault, level')}) as l on f.fault = l.fault",
    ),
    "j_notify_fanout": (
        lambda s, d: g.fan_out(levels(s, d), values(s, g.PUSH, "level, channels, receivers")).select("order_id", "level", "channel", "receiver"),
        f"with o as ({LEVELS}), p as (select * from {inline([(a, x, y) for a, b, c in g.PUSH for x in b for y in c], 'route, channel, receiver')}) select order_id, level, channel, receiver from o join p on p.route = case when level in ('red', 'orange', 'yellow') then level else 'yellow' end",
    ),
    "j_schedule_interval": (
        lambda s, d: g.interval_lookup(panel(s, d).select("device_id", "t"), values(s, SCHEDULE, "start, end, phase, load"), "t").select("device_id", "t", "phase", F.col("load").cast("double").alias("load")),
        f'{WITH}, j as (select device_id, t, phase, load, row_number() over (partition by device_id, t order by "start") as k from panel left join (values ' + ", ".join(f"({a}, {b}, '{c}', {e!r})" for a, b, c, e in SCHEDULE) + ') as v("start", "end", phase, load) on t between "start" and "end") select device_id, t, phase, cast(load as double) as load from j where k = 1',
    ),
    "a_accuracy_by_kind": (lambda s, d: scored(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("correct").cast("double"))).alias("accuracy")), f"with sc as ({SCORED}) select kind, count(*) as n, round(avg(cast(correct as integer)), 6) as accuracy from sc group by 1"),
    "a_confusion": (lambda s, d: scored(s, d).groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n")), f"with sc as ({SCORED}) select gold, pred, count(*) as n from sc group by 1, 2"),
    "a_percentile_rank": (lambda s, d: m.nearest_rank(table(s, d, "documents").select(F.nullif("lang", F.lit("en")).alias("lang"), "n_chars"), ["lang"], "n_chars", 0.95), "with s as (select nullif(lang, 'en') as lang, n_chars from documents), x as (select lang, n_chars, row_number() over (partition by lang order by n_chars) - 1 as k, count(*) over (partition by lang) as n from s where n_chars is not null) select lang, min(n_chars) as value from x where k = round_even(95e-2 * (n - 1), 0) group by 1"),
    "a_calibration": (lambda s, d: m.calibration(scored(s, d), ["kind"]).select("kind", "n", r6("brier").alias("brier"), r6("ece").alias("ece")), f"with sc as ({SCORED}), b as (select kind, least(floor(conf * 10), 9) as b, count(*) as n, sum(cast(correct as integer)) as h, sum(conf) as c, sum((conf - cast(correct as integer)) * (conf - cast(correct as integer))) as q from sc where conf between 0 and 1 group by 1, 2) select kind, cast(sum(n) as bigint) as n, round(sum(q) / sum(n), 6) as brier, round(sum(abs(h - c)) / sum(n), 6) as ece from b group by 1"),
    "a_class_f1": (
        lambda s, d: m.class_f1(sets(s, d), "gold", "pred").select("label", "tp", "fp", "fn", r6("f1").alias("f1")),
        f"with st as ({SETS}), c as (select unnest(['good', 'bad', 'toxic']) as label), x as (select label, count(*) filter (where list_contains(gold, label) and list_contains(pred, label)) as tp, count(*) filter (where not list_contains(gold, label) and list_contains(pred, label)) as fp, count(*) filter (where list_contains(gold, label) and not list_contains(pred, label)) as fn from st, c group by 1) select *, round(2e0 * tp / (2e0 * tp + fp + fn), 6) as f1 from x where tp + fp + fn > 0",
    ),
    "a_set_f1": (lambda s, d: sets(s, d).select("doc_id", r6(m.set_f1(F.col("gold"), F.col("pred"))).alias("f1")), f"with st as ({SETS}) select doc_id, round(2e0 * len(list_intersect(gold, pred)) / (len(gold) + len(pred)), 6) as f1 from st"),
    "a_error_taxonomy": (
        lambda s, d: sets(s, d).select(m.error_class(F.col("doc_id") % 13 != 0, F.array_sort("gold") == F.array_sort("pred"), F.col("doc_id") % 3 != 0).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n")),
        f"with st as ({SETS}) select case when doc_id % 13 = 0 then 'invalid' when list_sort(gold) = list_sort(pred) and doc_id % 3 <> 0 then 'correct' when doc_id % 3 <> 0 then 'set_only' when list_sort(gold) = list_sort(pred) then 'uncertainty_only' else 'both' end as error, count(*) as n from st group by 1",
    ),
    "a_group_strata": (
        lambda s, d: table(s, d, "documents").select(F.explode(F.filter(F.array(F.when(F.col("n_chars") < 500, "short"), F.when(F.col("lang") == "en", "english"), F.when(F.col("doc_id") % 2 == 0, "even")), lambda x: x.isNotNull())).alias("stratum"), "n_chars").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("n_chars")).alias("mean")),
        "with x as (select unnest(list_filter([case when n_chars < 500 then 'short' end, case when lang = 'en' then 'english' end, case when doc_id % 2 = 0 then 'even' end], lambda v: v is not null)) as stratum, n_chars from documents) select stratum, count(*) as n, round(avg(n_chars), 6) as mean from x group by 1",
    ),
    "a_cluster_bootstrap": (lambda s, d: m.bootstrap(scored(s, d).withColumns({"a": F.col("correct").cast("int"), "b": (F.col("conf") > 0.5).cast("int")}), "kind", ["a", "b"]).select("method", *(r6(c).alias(c) for c in ("lo", "hi", "mean"))), BOOT),
    "a_reward_monitor": (
        lambda s, d: numbered(scored(s, d), ["kind"], [F.floor(F.col("doc_id") / 4096)], ["doc_id"], "seq").groupBy("kind", F.floor((F.col("seq") - 1) / 256).alias("window_id")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("conf")).alias("mean"), r6(F.stddev_pop("conf")).alias("dev")),
        f"with sc as ({SCORED}), x as (select *, row_number() over (partition by kind order by doc_id) as seq from sc) select kind, (seq - 1) // 256 as window_id, count(*) as n, round(avg(conf), 6) as mean, round(stddev_pop(conf), 6) as dev from x group by 1, 2",
    ),
    "a_spearman": (
        lambda s, d: m.spearman(panel(s, d), "device_id", "flow_rate", "pressure").select("device_id", r6("rho").alias("corr")),
        f"{WITH}, x as (select device_id, rank() over (partition by device_id order by flow_rate) + (count(*) over (partition by device_id, flow_rate) - 1) / 2e0 as a, rank() over (partition by device_id order by pressure) + (count(*) over (partition by device_id, pressure) - 1) / 2e0 as b from panel where flow_rate is not null and pressure is not null) select device_id, round(corr(a, b), 6) as corr from x group by 1",
    ),
}
