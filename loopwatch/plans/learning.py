"""Queries over answers, evaluations, labelled windows and preference data. Stand-ins are made from documents, labels and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loopwatch.operators import datasets as ds
from loopwatch.operators import evaluation as ev
from loopwatch.operators import graph as g
from loopwatch.operators import metrics as m
from loopwatch.operators import text as tx
from loopwatch.plans.common import WITH, inline, panel, r6, table, values
from loopwatch.plans.decisions import SETS, STATS, sets, spark_sql, stats

KINDS = ["clear", "boundary", "transition", "composite", "misleading", "antihall"]
KIND = "case d.doc_id % 6 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
LEAK, SCALE = "管道泄漏", "线圈结垢"
#: One answer for each labelled document: what was said, with and without correction, and what checks found.
RECORDS = f"""select d.doc_id, {KIND} as kind, case when l.quality = 1 then '{LEAK}' else '{SCALE}' end as gold,
 case when d.doc_id % 17 = 0 then null when d.doc_id % 5 = 0 then '{ev.NO_FAULT}' when d.doc_id % 7 = 0 then '{ev.DATA_BAD}' when d.n_chars > 400 then '{LEAK}' else '{SCALE}' end as rc,
 case when d.n_chars > 300 then '{LEAK}' else '{SCALE}' end as rc_raw, case when d.n_chars > 500 then '{LEAK}' else '{SCALE}' end as rc_arb,
 (d.doc_id % 100) / 100e0 as conf, d.doc_id % 17 <> 0 as json_ok, d.doc_id % 13 <> 0 as faith_ok, d.doc_id % 29 <> 0 as hallu_ok, (d.n_chars % 1000) / 1000e0 as latency, case when d.doc_id % 31 = 0 then 'timeout' end as error
 from labels l join documents d on l.doc_id = d.doc_id"""
RIGHT = "coalesce(rc = gold, false)"
#: Four samples for each document.
SAMPLES = "select doc_id, k, (doc_id * 7 + k * 31) % 100 / 100e0 as reward, (doc_id + k) % 3 <> 0 as correct, (doc_id + k) % 11 <> 0 as json_ok, case when (doc_id + k) % 4 = 0 then 'a' else 'b' end as root_cause from documents cross join (values (0), (1), (2), (3)) as s(k)"
PROMPT = "'湿度均值 ' || cast(40 + doc_id % 45 as varchar) || '，流量 ' || cast(5 + doc_id % 4 as varchar) || '.5'"
CAUSE = f"case doc_id % 4 when 0 then '{LEAK}' when 1 then '{SCALE}' when 2 then '过滤器堵塞' else '未知' end"
EVIDENCE = "'湿度均值 ' || cast(40 + doc_id % 50 as varchar) || ' %'"
STEP = "case when doc_id % 3 = 0 then '测漏仪检查管路' when doc_id % 3 = 1 then '请清洗过滤器' else '上报' end"
TEXT = f"""'分析。' || case when doc_id % 19 = 0 then '无结论' else '{{"root_cause": "' || {CAUSE} || '", "confidence": ' || cast((doc_id % 12) / 10e0 as varchar) || ', "evidence": ["' || {EVIDENCE} || '", "' || case when doc_id % 5 = 0 then '湿度' else '观察' end || '"], "sop": ["' || {STEP} || '"]}}' end || '（完）'"""
ANSWERS = f"select doc_id, {PROMPT} as prompt, {TEXT} as text, case when doc_id % 2 = 0 then '{LEAK}' else '{SCALE}' end as gold from documents"
FAULT_NAMES = [f for f, _ in g.SPARE_PARTS]
ACTIONS: dict[str, list[str]] = {}
for _f, _a in g.HANDLED_BY:
    ACTIONS.setdefault(_f, []).append(_a)
SENSOR_NAMES = sorted({x for _, x in g.INDICATES})


def answers(s, d):
    table(s, d, "documents").createOrReplaceTempView("documents")
    return s.sql(ANSWERS.replace("varchar", "string"))


def records(s, d):
    return spark_sql(s, d, RECORDS, "labels", "documents")


def samples(s, d):
    return spark_sql(s, d, SAMPLES, "documents")


def scored_answers(s, d):
    a = answers(s, d).withColumn("a", tx.answer(F.col("text")))
    parts = ev.reward(F.col("a"), F.col("prompt"), F.col("gold"), FAULT_NAMES, ACTIONS, g.INDICATES, SENSOR_NAMES)
    return a.withColumn("score", parts)


def rate(within: str, hit: str) -> str:
    return f"coalesce(avg(case when {within} then cast({hit} as integer) end), 0)"


FAULT_IN, POOL = "kind in ('clear', 'boundary', 'composite', 'misleading')", "json_ok and kind <> 'antihall'"
SUMMARY = f"""with r as ({RECORDS}) select count(*) as n, count(*) filter (where {FAULT_IN}) as n_fault, count(*) filter (where {POOL}) as n_pool, count(*) filter (where kind = 'transition') as n_transition, count(*) filter (where kind = 'antihall') as n_antihall, count(error) as n_errors,
 round({rate('true', 'json_ok')}, 6) as json_rate, round({rate('true', RIGHT)}, 6) as acc_overall, round({rate(FAULT_IN, RIGHT)}, 6) as acc_fault, round({rate(FAULT_IN, 'coalesce(rc_raw = gold, false)')}, 6) as acc_fault_raw, round({rate(FAULT_IN, 'coalesce(rc_arb = gold, false)')}, 6) as acc_fault_arb,
 round({rate("kind = 'boundary'", RIGHT)}, 6) as acc_confusion, round({rate(POOL, 'faith_ok')}, 6) as faith_rate, round({rate(POOL, 'hallu_ok')}, 6) as hallu_rate, round({rate("kind = 'transition'", f"not coalesce(rc = '{ev.NO_FAULT}', false)")}, 6) as false_positive, round({rate("kind = 'antihall'", f"coalesce(rc = '{ev.DATA_BAD}', false)")}, 6) as refuse_rate,
 {rate('true', 'json_ok')} >= 99e-2 as gate_json, {rate(POOL, 'faith_ok')} >= 98e-2 as gate_faith, {rate(POOL, 'hallu_ok')} >= 1 as gate_hallu from r"""
RANK = "(select min(v) from (select latency as v, row_number() over (order by latency) - 1 as k, count(*) over () as n from r where json_ok) where k = round_even({p} * (n - 1), 0))"
GROUPS = "select doc_id, count(*) as n, avg(reward) as mean, case when count(*) > 1 then stddev_pop(reward) else 0 end as std, min(reward) as min, max(reward) as max, max(reward) - min(reward) as span, count(*) filter (where correct) as n_correct, count(*) filter (where json_ok) as n_json_ok from s group by 1"
#: The reward stated a second time, over parsed JSON in SQL.
PARSED = f"""select doc_id, prompt, gold, case when doc_id % 19 = 0 then null else {CAUSE} end as cause, (doc_id % 12) / 10e0 as conf, 40 + doc_id % 45 as hum, 40 + doc_id % 50 as said, 5 + doc_id % 4 + 5e-1 as q, doc_id % 5 = 0 as names_humidity, {STEP} as step from (select doc_id, {PROMPT} as prompt, case when doc_id % 2 = 0 then '{LEAK}' else '{SCALE}' end as gold from documents)"""
NEAR_ = "abs(said - {v}) <= greatest(abs({v}) * 5e-2, 15e-2)"
CONST = ", ".join(repr(x) for x in tx.CONSTANTS)
REWARD = f"""with p as ({PARSED}), q as (select *, cause is not null and conf between 0 and 1 as ok, case when cause = gold then 1e0 else 0e0 end as gold_part, case when said in ({CONST}) or {NEAR_.format(v='hum')} or {NEAR_.format(v='q')} then 1e0 else 0e0 end as faith,
 case when names_humidity and cause in ('{SCALE}', '过滤器堵塞') then 0e0 else 1e0 end as hallu,
 case when cause = '未知' then 1e0 when cause = '{LEAK}' then case when step = '测漏仪检查管路' then 1e0 else 0e0 end when cause = '过滤器堵塞' then case when step = '请清洗过滤器' then 1e0 else 0e0 end else 0e0 end as sop from p)
select doc_id, round(case when ok then 5e-1 * gold_part + 15e-2 * (1 - (conf - gold_part) * (conf - gold_part)) + 15e-2 * hallu + 1e-1 * faith + 5e-2 + 5e-2 * sop else 0 end, 6) as total, case when ok then hallu else 0e0 end as hallu, case when ok then faith else 0e0 end as faith, case when ok then sop else 0e0 end as sop from q"""
HARD = f"with st as ({SETS}), u as (select *, doc_id % 4 = 0 as gold_more, case when doc_id % 9 <> 0 then doc_id % 3 = 0 end as pred_more, list_sort(gold) = list_sort(pred) as exact, doc_id % 5 as injected, case when doc_id % 9 <> 0 then (doc_id % 100) / 100e0 end as conf from st)"


def hard(s, d):
    x = sets(s, d)
    i = F.col("doc_id")
    x = x.withColumns({"gold_more": i % 4 == 0, "pred_more": F.when(i % 9 != 0, i % 3 == 0), "exact": F.array_sort("gold") == F.array_sort("pred"), "injected": i % 5, "conf": F.when(i % 9 != 0, (i % 100) / 100.0)})
    return x.withColumn("correct", F.col("exact") & F.coalesce(F.col("gold_more") == F.col("pred_more"), F.lit(False)))


ENDS = [2700, 3300, 3900, 4500, 5100]
CASES = "select o_orderkey as case_id, case o_orderkey % 4 when 0 then '管道泄漏' when 1 then '水泵气蚀' when 2 then '线圈结垢' else '过滤器堵塞' end as gold from orders"
#: Windows of the panel of ten minutes, one fault taken out of the second by halving what it does.
SUPPORT = [("管道泄漏", "pressure", 1.5, None), ("水泵气蚀", "pressure", 1.5, 0.25), ("线圈结垢", "outlet_temp", 0.3, None)]


def support_cases(s, d, shift):
    w = panel(s, d).groupBy("device_id", F.floor(F.col("t") / 600).alias("window_id")).agg(*(x for c in ("pressure", "outlet_temp") for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"d_{c}"))))
    out = w.select((F.col("device_id") * 100000 + F.col("window_id")).alias("case_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("fault"), F.lit(c).alias("channel"), (F.col(f"m_{c}") * shift).alias("mean"), (F.col(f"d_{c}") * shift).alias("deviation")) for f, c, _, _ in SUPPORT))).alias("x"))
    return out.select("case_id", "x.*")


def messages(s, d):
    return ds.messages(table(s, d, "conversations"))


def leak_sets(s, d):
    x = ds.stratified_split(table(s, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("mark")), ["lang"], "doc_id", 0.1)
    b = table(s, d, "benchmark").select(F.sha2("text", 256).alias("mark"))
    train, val = x.where("split = 'train'"), x.where("split = 'val'")
    return {"train": train, "val": val, "stress": x.where("doc_id % 10 = 3"), "benchmark": b}


LEAKS = [("train", "val"), ("train", "stress"), ("val", "stress"), ("train", "benchmark"), ("val", "benchmark"), ("stress", "benchmark")]
SPLIT_SQL = "x as (select doc_id, lang, source, text, row_number() over (partition by lang order by md5('split|' || cast(doc_id as varchar)), doc_id) <= ceil(count(*) over (partition by lang) * 1e-1) as val from documents)"
LEAK_SQL = {"train": "select distinct text from x where not val", "val": "select distinct text from x where val", "stress": "select distinct text from x where doc_id % 10 = 3", "benchmark": "select distinct text from benchmark"}


def once(df, **made):
    """df with columns that later filters use as they are: through a generator no filter is pushed down with their formulas."""
    rest = [c for c in df.columns if c not in made]
    return df.select(*rest, F.explode(F.array(F.struct(*(v.alias(k) for k, v in made.items())))).alias("_x")).select(*rest, "_x.*")


def corrupt(s, d):
    """Answers made worse, kept where the reward falls by the margin. Rewards are taken over answers parsed once."""
    a = scored_answers(s, d).withColumn("kind", F.explode(F.array(*map(F.lit, tx.CORRUPTIONS)))).select("doc_id", "text", "prompt", "gold", "kind", F.col("score.total").alias("good"))
    made = tx.corrupted(a, "kind", "text", "gold", "doc_id", FAULT_NAMES)
    made = once(once(made, bad=F.col("bad")), b=tx.answer(F.col("bad")))
    fell = once(made, margin=F.col("good") - ev.reward(F.col("b"), F.col("prompt"), F.col("gold"), FAULT_NAMES, ACTIONS, g.INDICATES, SENSOR_NAMES)["total"])
    return fell.where(F.col("bad").isNotNull() & (F.col("margin") >= ev.MARGIN)).select("doc_id", "kind", r6("margin").alias("margin"), F.sha2("bad", 256).alias("mark"))


QUERIES = {
    "a_eval_summary": (lambda s, d: (x := ev.summary(records(s, d))).select(*(r6(c).alias(c) if t == "double" else c for c, t in x.dtypes)), SUMMARY),
    "a_eval_latency": (lambda s, d: ev.latency(records(s, d)).select(*(r6(c).alias(c) for c in ("mean", "max", "p50", "p95"))), f"with r as ({RECORDS}) select round(avg(latency), 6) as mean, round(max(latency), 6) as max, round({RANK.format(p='5e-1')}, 6) as p50, round({RANK.format(p='95e-2')}, 6) as p95 from r where json_ok"),
    "a_conf_gap": (
        lambda s, d: ev.confidence_gap(records(s, d).where("json_ok").withColumn("correct", F.expr(RIGHT)), ["kind"]).select("kind", *(r6(c).alias(c) for c in ("mean_correct", "mean_wrong", "gap", "wrong_high"))),
        f"with r as (select *, {RIGHT} as ok from ({RECORDS}) where json_ok) select kind, round(avg(conf) filter (where ok), 6) as mean_correct, round(avg(conf) filter (where not ok), 6) as mean_wrong, round(avg(conf) filter (where ok) - avg(conf) filter (where not ok), 6) as gap, round(avg(cast(conf >= 8e-1 as integer)) filter (where not ok), 6) as wrong_high from r group by 1",
    ),
    "a_uncertainty": (
        lambda s, d: (x := ev.uncertainty(hard(s, d))).select(*(r6(c).alias(c) if t == "double" else c for c, t in x.dtypes)),
        HARD + ", v as (select *, coalesce(pred_more, false) as asked, cast(exact and coalesce(gold_more = pred_more, false) as integer) as ok from u) select round(count(*) filter (where gold_more and asked) / cast(count(*) filter (where asked) as double), 6) as precision, round(count(*) filter (where gold_more and asked) / cast(count(*) filter (where gold_more) as double), 6) as recall, round(avg(cast(len(pred) > 0 as integer)) filter (where injected = 0), 6) as normal_false_positive, count(*) filter (where injected = 0) as n_normal, round(avg(ok), 6) as joint_accuracy, round(avg((conf - ok) * (conf - ok)), 6) as brier, count(conf) as n_calibrated from v",
    ),
    "a_macro_f1": (
        lambda s, d: ev.macro_f1(m.class_f1(sets(s, d), "gold", "pred")).select(r6("macro_f1").alias("macro_f1"), "n_classes"),
        f"with st as ({SETS}), c as (select unnest(['good', 'bad', 'toxic']) as label), x as (select label, count(*) filter (where list_contains(gold, label) and list_contains(pred, label)) as tp, count(*) filter (where list_contains(gold, label) <> list_contains(pred, label)) as off from st, c group by 1) select round(avg(2e0 * tp / (2e0 * tp + off)), 6) as macro_f1, count(*) as n_classes from x where tp + off > 0",
    ),
    "a_reward": (lambda s, d: scored_answers(s, d).select("doc_id", r6("score.total").alias("total"), *(F.col(f"score.{c}").alias(c) for c in ("hallu", "faith", "sop"))), REWARD),
    "a_hard_reward": (
        lambda s, d: hard(s, d).select("doc_id", r6(ev.hard_reward(F.col("pred_more").isNotNull(), F.col("gold"), F.col("pred"), F.col("gold_more") == F.col("pred_more"), F.col("doc_id") % 7 != 0, (F.col("doc_id") % 3) / 2.0)).alias("total")),
        HARD + " select doc_id, round(case when pred_more is null then 0 else 4e-1 * cast(exact as integer) + 2e-1 * (2e0 * len(list_intersect(gold, pred)) / (len(gold) + len(pred))) + 2e-1 * cast(gold_more = pred_more as integer) + 1e-1 * cast(doc_id % 7 <> 0 as integer) + 5e-2 * ((doc_id % 3) / 2e0) + 5e-2 end, 6) as total from u",
    ),
    "b_reward_parity": (
        lambda s, d: ev.misaligned(scored_answers(s, d).select("doc_id", r6("score.total").alias("total")), spark_sql(s, d, REWARD.replace("varchar", "string"), "documents"), "doc_id", ["total"]),
        "select cast(0 as bigint) as n_extra, cast(0 as bigint) as n_lacking, cast(0 as bigint) as n_differ",
    ),
    "a_rollout_groups": (lambda s, d: (x := ev.rollout_groups(samples(s, d), ["doc_id"])).select(*(r6(c).alias(c) if t == "double" else c for c, t in x.dtypes)), f"with s as ({SAMPLES}), g as ({GROUPS}) select doc_id, n, round(mean, 6) as mean, round(std, 6) as std, round(min, 6) as min, round(max, 6) as max, round(span, 6) as span, n_correct, n_json_ok from g"),
    "a_rollout_summary": (
        lambda s, d: ev.rollout_summary(ev.rollout_groups(samples(s, d), ["doc_id"]).withColumn("kind", F.col("doc_id") % 6), ["kind"]).select("kind", "n", r6("span_mean").alias("span_mean"), "n_wide", "n_flat", r6("correct_rate").alias("correct_rate")),
        f"with s as ({SAMPLES}), g as ({GROUPS}) select doc_id % 6 as kind, count(*) as n, round(avg(span), 6) as span_mean, count(*) filter (where span >= 15e-2) as n_wide, count(*) filter (where span = 0) as n_flat, round(avg(n_correct / cast(greatest(n, 1) as double)), 6) as correct_rate from g group by 1",
    ),
    "a_across_runs": (
        lambda s, d: ev.across_runs(samples(s, d).groupBy("root_cause", "k").agg(F.avg("reward").alias("reward"), F.avg(F.when(F.col("correct"), F.col("reward"))).alias("won")), "root_cause", ["reward", "won"]).select("root_cause", *(r6(c).alias(c) for c in ("reward_mean", "reward_std", "won_mean", "won_std"))),
        f"with s as ({SAMPLES}), g as (select root_cause, k, avg(reward) as reward, avg(reward) filter (where correct) as won from s group by 1, 2) select root_cause, round(avg(reward), 6) as reward_mean, round(stddev_pop(reward), 6) as reward_std, round(avg(won), 6) as won_mean, round(stddev_pop(won), 6) as won_std from g group by 1",
    ),
    "a_describe": (
        lambda s, d: ev.describe(table(s, d, "documents").withColumn("source", F.nullif("source", F.lit("src0"))), "source", "n_chars").select("source", "min", "max", r6("mean").alias("mean"), "total", "p50", "p95"),
        "with s as (select nullif(source, 'src0') as source, n_chars from documents), x as (select source, n_chars, row_number() over (partition by source order by n_chars) - 1 as k, count(*) over (partition by source) as n from s where n_chars is not null) select source, min(n_chars) as min, max(n_chars) as max, round(avg(n_chars), 6) as mean, cast(sum(n_chars) as bigint) as total, max(case when k = round_even(5e-1 * (n - 1), 0) then n_chars end) as p50, max(case when k = round_even(95e-2 * (n - 1), 0) then n_chars end) as p95 from x group by 1",
    ),
    "a_cause_errors": (lambda s, d: ev.cause_errors(sets(s, d)), f"with st as ({SETS}), x as (select unnest(list_filter(gold, lambda g: not list_contains(pred, g))) as cause, 'missed' as error from st union all select unnest(list_filter(pred, lambda g: not list_contains(gold, g))), 'extra' from st) select cause, error, count(*) as n from x group by 1, 2"),
    "a_trace_total": (lambda s, d: records(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("latency")).alias("total"), r6(F.avg("latency")).alias("mean")), f"with r as ({RECORDS}) select kind, count(*) as n, round(sum(latency), 6) as total, round(avg(latency), 6) as mean from r group by 1"),
    "a_paired_methods": (
        lambda s, d: ev.paired((r := records(s, d)).select("doc_id", F.coalesce(F.col("rc_raw") == F.col("gold"), F.lit(False)).alias("right"), F.col("rc_raw").alias("out")), r.where("doc_id % 3 <> 1").select("doc_id", F.coalesce(F.col("rc_arb") == F.col("gold"), F.lit(False)).alias("right"), F.col("rc_arb").alias("out")), ["doc_id"], ["right"], "out"),
        f"with r as (select *, rc_raw = gold as a, rc_arb = gold as b from ({RECORDS}) where doc_id % 3 <> 1) select count(*) as n, count(*) filter (where rc_raw = rc_arb) as identical, count(*) filter (where b and not a) as right_improved, count(*) filter (where a and not b) as right_regressed from r",
    ),
    "j_misaligned": (
        lambda s, d: ev.misaligned((r := records(s, d)).where("doc_id % 10 <> 1").select("doc_id", "gold", "rc"), r.where("doc_id % 10 <> 2").select("doc_id", "gold", F.when(F.col("doc_id") % 10 == 3, F.col("rc_raw")).otherwise(F.col("rc")).alias("rc")), "doc_id", ["gold", "rc"]),
        f"with r as ({RECORDS}) select count(*) filter (where doc_id % 10 = 2) as n_extra, count(*) filter (where doc_id % 10 = 1) as n_lacking, count(*) filter (where doc_id % 10 = 3 and rc is distinct from rc_raw) as n_differ from r",
    ),
    "j_regressions": (
        lambda s, d: (x := ev.regressions((r := records(s, d)).select(F.col("doc_id").alias("case_id"), F.expr(RIGHT).alias("passed")), r.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("case_id"), (F.col("rc_raw") == F.col("gold")).alias("passed"))))[0].select("case_id", F.lit("regressed").alias("what")).unionByName(x[1].select("case_id", F.lit("new").alias("what"))),
        f"with r as ({RECORDS}) select doc_id as case_id, 'regressed' as what from r where doc_id % 4 <> 0 and rc_raw = gold and not {RIGHT} union all select doc_id, 'new' from r where doc_id % 4 = 0",
    ),
    "j_gold_by_mark": (
        lambda s, d: table(s, d, "documents").where("doc_id % 2 = 0").select("doc_id", F.sha2("text", 256).alias("mark")).join(table(s, d, "documents").where("doc_id % 2 = 1").groupBy(F.sha2("text", 256).alias("mark")).agg(F.min("doc_id").alias("gold_id")), "mark", "left").select("doc_id", "gold_id"),
        "select a.doc_id, b.gold_id from (select * from documents where doc_id % 2 = 0) a left join (select text, min(doc_id) as gold_id from documents where doc_id % 2 = 1 group by 1) b on a.text = b.text",
    ),
    "f_boundary": (
        lambda s, d: stats(s, d).join(spark_sql(s, d, CASES, "orders"), "case_id").select("case_id", ds.near_limit(F.col("gold"), *(F.col(c) for c in ("hum", "dh", "ps", "pq", "q"))).alias("boundary"), ds.dominant(*(F.col(c) for c in ("hum", "dh", "ps", "pq", "q"))).alias("dominant"), ds.taught_confidence(F.element_at(F.array(*map(F.lit, KINDS)), (F.col("case_id") % 6 + 1).cast("int"))).alias("conf")),
        f"with st as ({STATS}), x as (select st.*, gold, coalesce(hum, 50) as h, coalesce(ps, 0) as p2 from st join ({CASES}) c on st.case_id = c.case_id) select case_id, case gold when '管道泄漏' then h between 60 and 70 or dh between 25e-1 and 6 when '水泵气蚀' then p2 between 2 and 45e-1 when '线圈结垢' then pq between 7 and 14 else q between 6 and 72e-1 and pq < 10 end as boundary, case when h > 70 or (dh > 4 and q < 78e-1) then '管道泄漏' when p2 > 3 then '水泵气蚀' when pq >= 10 then '线圈结垢' when q < 64e-1 then '过滤器堵塞' end as dominant, case case_id % 6 when 1 then 78e-2 when 3 then 85e-2 when 2 then 9e-1 when 5 then 5e-1 else 88e-2 end as conf from x",
    ),
    "b_composite": (
        lambda s, d: stats(s, d).withColumns({"label": F.element_at(F.array(*map(F.lit, ("过滤器堵塞+管道泄漏", "过滤器堵塞+水泵气蚀", "管道泄漏+水泵气蚀", "线圈结垢"))), (F.col("case_id") % 4 + 1).cast("int")), "primary": ds.dominant(*(F.col(c) for c in ("hum", "dh", "ps", "pq", "q")))}).where(F.contains("label", F.lit("+")) & F.contains("label", "primary")).select("case_id", "primary", F.array_join(F.array_remove(F.split("label", r"\+"), F.col("primary")), "+").alias("secondary")),
        f"with st as ({STATS}), x as (select case_id, ['过滤器堵塞+管道泄漏', '过滤器堵塞+水泵气蚀', '管道泄漏+水泵气蚀', '线圈结垢'][case_id % 4 + 1] as label, case when coalesce(hum, 50) > 70 or (dh > 4 and q < 78e-1) then '管道泄漏' when coalesce(ps, 0) > 3 then '水泵气蚀' when pq >= 10 then '线圈结垢' when q < 64e-1 then '过滤器堵塞' end as p from st) select case_id, p as primary, replace(replace(label, p || '+', ''), '+' || p, '') as secondary from x where contains(label, '+') and contains(label, p)",
    ),
    "b_fault_windows": (
        lambda s, d: ds.fault_windows(panel(s, d).withColumn("fault_label", F.when(F.col("t") % 3000 < 2000, "none").otherwise("线圈结垢")), ENDS),
        f"{WITH}, p as (select device_id, t, case when t % 3000 < 2000 then 'none' else '线圈结垢' end as fault_label from panel), w as (select device_id, e, count(*) as n, min(fault_label) filter (where t >= e - 120) as a, max(fault_label) filter (where t >= e - 120) as b from p, (select unnest({ENDS}) as e) where t < e and t >= e - 1200 group by 1, 2) select device_id, e as \"end\", a as label from w where n = 1200 and a = b",
    ),
    "b_labelled_windows": (
        lambda s, d: ds.labelled_windows(panel(s, d).withColumn("fault_label", F.when(F.col("t") % 3000 < 1000, "none").when(F.col("t") % 3000 < 2000, "a").otherwise("a+b")), keep=5),
        f"{WITH}, p as (select device_id, t, case when t % 3000 < 1000 then 'none' when t % 3000 < 2000 then 'a' else 'a+b' end as l from panel), st as (select distinct device_id, (t // 600) * 600 as start from panel), w as (select p.device_id, start, count(*) as n, min(l) filter (where t >= start + 1080) as a, max(l) filter (where t >= start + 1080) as b from st join p on p.device_id = st.device_id and t >= start and t < start + 1200 group by 1, 2), k as (select device_id, start, a as label, row_number() over (partition by a order by device_id, start) - 1 as k, greatest(1, count(*) over (partition by a) // 5) as step from w where n = 1200 and a = b and a <> 'none') select device_id, start, label from k where k % step = 0 and k // step < 5",
    ),
    "b_transition_starts": (
        lambda s, d: ds.transition_windows(panel(s, d).withColumn("operating_condition", F.when(F.col("t") % 1700 < 900, "melting").otherwise("idle"))),
        f"{WITH}, p as (select device_id, t, case when t % 1700 < 900 then 'melting' else 'idle' end as c from panel), n as (select device_id, max(t) + 1 as n from panel group by 1), st as (select device_id, unnest(range(600, n - 1199, 60)) as start from n) select st.device_id, start from st join p on p.device_id = st.device_id and t >= start + 1080 and t < start + 1200 group by 1, 2 having min(c) <> max(c)",
    ),
    "b_violations": (
        lambda s, d: (x := ds.violated(stats(s, d).select("case_id", F.lit(45.0).alias("outlet"), F.when(F.col("case_id") % 3 == 0, F.lit(2.0)).otherwise(30.0).alias("inlet"), F.coalesce("hum", F.lit(50.0)).alias("hum"), "p", "q"), "case_id")).select("case_id", "claim", ds.grounded(*(F.col(c) for c in ("claim", "outlet", "inlet", "hum", "p", "q"))).alias("grounded")),
        f"with st as ({STATS}), x as (select case_id, case_id % 4 as k, case when case_id % 3 = 0 then 2 else 30 end as inlet from st) select case_id, ['出水温度=5.0', '湿度=130.0', '压力=-50.0', '流量=80.0'][k + 1] as claim, case when k = 0 then inlet > 5 else true end as grounded from x",
    ),
    "b_misleading": (
        lambda s, d: answers(s, d).select("doc_id", tx.rewrite_section(tx.prompt([("近期维修工单", F.col("text")), ("知识图谱候选根因", F.col("gold"))]), "近期维修工单", "知识图谱候选根因", F.lit("误导")).alias("p")).select("doc_id", "p"),
        f"select doc_id, '【近期维修工单】' || chr(10) || '误导' || chr(10) || chr(10) || chr(10) || '【知识图谱候选根因】' || chr(10) || gold as p from ({ANSWERS})",
    ),
    "b_pairs_on_policy": (
        lambda s, d: ds.outside_in(samples(s, d), "doc_id", "k", 2).select("doc_id", "rank", "chosen", "rejected", r6("margin").alias("margin")),
        f"with s as ({SAMPLES}), r as (select *, row_number() over (partition by doc_id order by reward, k) as lo, count(*) over (partition by doc_id) as n from s) select a.doc_id, cast(a.lo as integer) as rank, b.k as chosen, a.k as rejected, round(b.reward - a.reward, 6) as margin from r a join r b on a.doc_id = b.doc_id and b.lo = a.n - a.lo + 1 where a.lo <= 2 and 2 * a.lo <= a.n and b.reward - a.reward >= 15e-2 and (b.correct or a.root_cause = b.root_cause)",
    ),
    "b_synthetic_negatives": (corrupt, None),
    "b_group_holdout": (
        lambda s, d: ds.group_holdout(table(s, d, "conversations").select("conv_id", "turn"), "conv_id", 0.1),
        "with c as (select conv_id, row_number() over (order by md5('hold|' || cast(conv_id as varchar)), conv_id) as k, count(*) over () as n from (select distinct conv_id from conversations)) select t.conv_id, turn, k <= round(n * 1e-1) as held from conversations t join c on t.conv_id = c.conv_id",
    ),
    "b_mix": (
        lambda s, d: ds.mixed(table(s, d, "documents").where("doc_id % 10 = 0").select("doc_id", "lang"), table(s, d, "documents").where("doc_id % 2 = 1").select("doc_id", "source"), "doc_id"),
        "with r as (select doc_id, lang from documents where doc_id % 10 = 0), s as (select doc_id, source, row_number() over (order by md5('mix|' || cast(doc_id as varchar)), doc_id) as k from documents where doc_id % 2 = 1) select doc_id, lang, cast(null as varchar) as source, 'real' as origin from r union all select doc_id, null, source, 'simulated' from s where k <= 3 * (select count(*) from r)",
    ),
    "k_feasible_take": (
        lambda s, d: ds.feasible_take(records(s, d).select("doc_id", "kind"), "kind", "doc_id", {"antihall": 0.2, "boundary": 0.3, "composite": 0.15, "misleading": 0.15, "transition": 0.1, "clear": 0.1}, 1200),
        f"with r as (select doc_id, kind, row_number() over (partition by kind order by md5('take|' || cast(doc_id as varchar)), doc_id) as k from ({RECORDS})), p as (select * from (values ('antihall', 2e-1), ('boundary', 3e-1), ('composite', 15e-2), ('misleading', 15e-2), ('transition', 1e-1), ('clear', 1e-1)) as v(kind, share)), n as (select floor(least(1200, min(coalesce(c, 0) / share))) as n from p left join (select kind, count(*) as c from r group by 1) using (kind)) select doc_id, kind from r join p using (kind), n where k <= round_even(share * n, 0)",
    ),
    "b_leak_table": (lambda s, d: ds.overlaps(leak_sets(s, d), LEAKS, "mark"), f"with {SPLIT_SQL} " + " union all ".join(f"select '{a}_vs_{b}' as check, count(*) as n from ({LEAK_SQL[a]} intersect {LEAK_SQL[b]})" for a, b in LEAKS)),
    "u_same_keys": (lambda s, d: ds.same_keys(table(s, d, "labels"), table(s, d, "documents").where("doc_id % 5 <> 0"), "doc_id"), "with a as (select distinct doc_id from labels), b as (select distinct doc_id from documents where doc_id % 5 <> 0) select (select count(*) from a where doc_id not in (select doc_id from b)) as only_first, (select count(*) from b where doc_id not in (select doc_id from a)) as only_second, false as equal"),
    "u_append_absent": (
        lambda s, d: sets(s, d).select("doc_id", F.array_join(F.array_union("gold", F.array_union("pred", F.array(F.lit("other")))), ",").alias("all")),
        f"with st as ({SETS}) select doc_id, array_to_string(list_concat(gold, list_filter(pred, lambda p: not list_contains(gold, p)), ['other']), ',') as \"all\" from st",
    ),
    "f_support": (
        lambda s, d: ds.support(support_cases(s, d, 1.0), support_cases(s, d, 0.5), values(s, [(a, b, c, e if e else 1e9) for a, b, c, e in SUPPORT], "fault, channel, by_mean, by_deviation")).select("case_id", "fault", F.round("support", 4).alias("support")),
        f"{WITH}, w as (select device_id * 100000 + t // 600 as case_id, avg(pressure) / 2 as p, stddev_pop(pressure) / 2 as dp, avg(outlet_temp) / 2 as o from panel group by 1) select case_id, '管道泄漏' as fault, round(p / 15e-1, 4) as support from w union all select case_id, '水泵气蚀', round(greatest(p / 15e-1, dp / 25e-2), 4) from w union all select case_id, '线圈结垢', round(o / 3e-1, 4) from w",
    ),
    "f_input_mark": (
        lambda s, d: messages(s, d).select("conv_id", tx.input_mark(F.col("messages")).alias("mark")),
        "select conv_id, sha256(coalesce('[' || string_agg(cast(json_object('content', text, 'role', role) as varchar), ',' order by turn) filter (where role <> 'assistant') || ']', '[]')) as mark from conversations group by 1",
    ),
    "f_json_answer": (
        lambda s, d: answers(s, d).select("doc_id", (a := tx.answer(F.col("text")))["root_cause"].alias("root_cause"), a["confidence"].alias("confidence"), F.size(a["evidence"]).alias("n_evidence"), F.get(tx.untraced(a["evidence"], tx.numbers_in(F.col("prompt"))), F.lit(0)).alias("untraced")),
        f"with p as ({PARSED}) select doc_id, cause as root_cause, case when cause is not null then conf end as confidence, case when cause is not null then 2 end as n_evidence, case when cause is not null and not (said in ({CONST}) or {NEAR_.format(v='hum')} or {NEAR_.format(v='q')}) then cast(said as double) end as untraced from p",
    ),
    "f_section": (
        lambda s, d: answers(s, d).select("doc_id", tx.section(tx.prompt([("一", F.col("prompt")), ("二", F.lit(None).cast("string"))]), "【一】\n", "\n\n【二】").alias("body"), tx.section(F.col("text"), "无此", "节").alias("none")),
        f"select doc_id, prompt as body, '' as none from ({ANSWERS})",
    ),
    "b_sft_audit": (
        lambda s, d: ds.failures(scored_answers(s, d), "doc_id", {"json": F.col("a").isNotNull(), "gold": F.col("a.root_cause") == F.col("gold"), "sop": F.col("score.sop") == 1, "faith": F.col("score.faith") == 1, "check": F.col("score.hallu") == 1}),
        f"with r as ({REWARD}), p as ({PARSED}) select r.doc_id, unnest(list_filter([case when cause is null then 'json' end, case when not coalesce(cause = gold, false) then 'gold' end, case when r.sop <> 1 then 'sop' end, case when r.faith <> 1 then 'faith' end, case when r.hallu <> 1 then 'check' end], lambda v: v is not null)) as failed from r join p on r.doc_id = p.doc_id",
    ),
    "b_kind_quota": (
        lambda s, d: records(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("short", F.greatest(F.lit(0), 60 - F.col("n"))),
        f"with r as ({RECORDS}) select kind, count(*) as n, greatest(0, 60 - count(*)) as short from r group by 1",
    ),
    "b_hard_audit": (
        lambda s, d: ds.failures(hard(s, d), "doc_id", {"distinct": F.size(F.array_distinct("pred")) == F.size("pred"), "flag": F.col("pred_more").isNotNull(), "confidence": F.col("conf").between(0, 1), "set": F.col("exact"), "known": F.size(F.array_except("pred", F.array(F.lit("good"), F.lit("bad"), F.lit("toxic")))) == 0}),
        HARD + " select doc_id, unnest(list_filter([case when pred_more is null then 'flag' end, case when conf is null then 'confidence' end, case when not exact then 'set' end], lambda v: v is not null)) as failed from u",
    ),
}
