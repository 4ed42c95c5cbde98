"""Queries over sets of window samples: statistics, audits, leaks, regression cases and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopwatch.contract import CHANNELS
from loopwatch.operators import audit as au
from loopwatch.operators import context as cx
from loopwatch.operators import datasets as ds
from loopwatch.operators import orders as od
from loopwatch.operators import rules as r
from loopwatch.plans import actions, decisions, learning, sensors
from loopwatch.plans.common import WITH, inline, panel, table, values

FAULTS = {"pump": "水泵气蚀", "filter": "过滤器堵塞", "scale": "线圈结垢"}
SEEN = ["pressure", "flow_rate", "outlet_temp"]


def samples(s, d):
    """A sample for every window of the panel, right in all that is checked but where its number n says otherwise.

    n = 1000 * device + window; windows are paired to episodes, every fifth device's episodes go to val, every seventh's to eval."""
    stats = au.window_statistics(panel(s, d), SEEN)
    x = stats.groupBy("device_id", "window_id").agg(F.array_sort(F.collect_list(F.struct("channel", "mean", F.coalesce("deviation", F.lit(0.0)).alias("deviation"), F.coalesce("slope", F.lit(0.0)).alias("slope")))).alias("all"))
    n = F.col("device_id") * 1000 + F.col("window_id")
    episode = F.floor(n / 2)
    x = x.select(F.transform("all", lambda v: F.struct(v["channel"].alias("channel"), F.coalesce(v["mean"], F.lit(0.0)).alias("mean"), v["deviation"].alias("deviation"), v["slope"].alias("slope"))).alias("all"), n.alias("n"), "device_id", episode.alias("e"), (F.col("window_id") % 2).alias("half"))
    k = F.col("n")
    bad = lambda p, wrong, right: F.when(k % p == 0, wrong).otherwise(right)
    hidden = F.when(k % 4 == 1, F.array(F.lit("tank_level"))).otherwise(F.expr("cast(array() as array<string>)"))
    strength = lambda m: F.when(k % m == 0, 1.5).otherwise(0.5)
    support = F.create_map(F.lit("pump"), strength(3), F.lit("filter"), strength(5), F.lit("scale"), bad(37, F.lit(-1.0), F.lit(0.0)))
    causes = F.array_sort(F.array_compact(F.array(F.when(k % 3 == 0, FAULTS["pump"]), F.when(k % 5 == 0, FAULTS["filter"]))))
    more = k % 2 == 0
    text = F.when(F.size(causes) > 0, F.array_join(causes, " + ")).when(more, au.UNCERTAIN).otherwise(au.NORMAL)
    evidence = au.evidence_lines(F.slice("all", 1, 1), hidden, F.lit("水箱液位"))
    spoilt = F.transform("all", lambda v: F.struct(v["channel"].alias("channel"), F.lit(float("nan")).alias("mean"), v["deviation"].alias("deviation"), v["slope"].alias("slope")))
    below = F.transform("all", lambda v: F.struct(v["channel"].alias("channel"), v["mean"].alias("mean"), F.lit(-1.0).alias("deviation"), v["slope"].alias("slope")))
    return x.select(
        k.alias("sample_id"), F.when(k % 101 == 0, "test").when(F.col("device_id") % 5 == 4, "val").when(F.col("device_id") % 7 == 6, "eval").otherwise("train").alias("split"), bad(103, F.lit("v0"), F.lit(au.VERSION)).alias("version"),
        bad(107, F.array(F.lit("user")), F.array(*map(F.lit, au.ROLES))).alias("roles"), bad(11, F.lit("... episode_id ..."), F.lit("统计")).alias("prompt"),
        F.when(k % 13 == 0, F.slice("all", 1, 2)).when(k % 17 == 0, spoilt).when(k % 19 == 0, below).otherwise(F.col("all")).alias("observed"), F.when(k % 17 == 0, spoilt).otherwise(F.col("all")).alias("reference"),
        F.when(k % 23 == 0, F.array(F.lit("pressure"))).otherwise(hidden).alias("hidden"), F.lit("水箱液位").alias("unavailable"), support.alias("support"), causes.alias("gold_causes"), text.alias("gold"), more.alias("gold_more"),
        bad(29, F.array(F.lit("?")), causes).alias("root_causes"), bad(31, F.lit("?"), text).alias("root_cause"), F.when(k % 41 == 0, ~more).when(k % 43 != 0, more).alias("more"), bad(47, F.lit(1.2), F.lit(0.9)).alias("confidence"),
        bad(53, F.array(F.lit("压力均值 0")), F.slice(evidence, 1, 1)).alias("evidence"), bad(59, F.array(F.lit(" ")), F.array(F.lit("检查"))).alias("sop"),
        F.concat(F.lit("in"), bad(61, F.lit(0), k).cast("string")).alias("input"), F.floor(k / F.when(k % 67 == 0, 500).otherwise(1)).alias("seed"), F.concat(F.lit("e"), F.col("e").cast("string")).alias("episode_id"),
        F.concat(F.lit("m"), bad(71, F.lit(0), F.col("device_id")).cast("string")).alias("equipment_id"), F.when(F.col("half") == 0, bad(73, F.lit(600), F.lit(1200))).otherwise(1800).cast("long").alias("window_end"),
        F.array_repeat(F.lit("f"), (k % 4).cast("int")).alias("injected"), (k % 6 == 0).alias("shifted"),
    )


#: The same by number: which windows there are, and what is wrong with each.
NUMBERS = f"{WITH}, w as (select distinct device_id, t // 600 as window_id from panel), k as (select device_id, window_id, device_id * 1000 + window_id as n, (device_id * 1000 + window_id) // 2 as e from w), p as (select *, case when n % 101 = 0 then 'test' when device_id % 5 = 4 then 'val' when device_id % 7 = 6 then 'eval' else 'train' end as split, 'in' || case when n % 61 = 0 then 0 else n end as input, n // case when n % 67 = 0 then 500 else 1 end as seed, 'e' || e as episode_id, 'm' || case when n % 71 = 0 then 0 else device_id end as equipment_id, case when window_id % 2 = 1 then 1800 when n % 73 = 0 then 600 else 1200 end as window_end, cast(n % 3 = 0 as integer) + cast(n % 5 = 0 as integer) as n_out from k)"
WRONG = {
    "split": "n % 101 = 0", "version": "n % 103 = 0", "roles": "n % 107 = 0", "secret": "n % 11 = 0", "reference_channels": "n % 13 = 0", "finite": "n % 17 = 0", "deviation": "n % 19 = 0 and n % 13 <> 0 and n % 17 <> 0",
    "hidden_exposed": "n % 23 = 0 and not (n % 13 = 0)", "causes": "n % 29 = 0", "support": "n % 37 = 0", "text": "n % 31 = 0 or n_out = 0 and (n % 41 = 0 or n % 43 = 0 and n % 2 = 0)",
    "flag": "n % 43 = 0 and n % 41 <> 0", "flag_match": "n % 41 = 0 or n % 43 = 0", "confidence": "n % 47 = 0", "sop": "n % 59 = 0",
    "evidence": "n % 53 = 0 or n % 13 <> 0 and (n % 17 = 0 or n % 19 = 0)",
}


def ledger(s, d):
    """What orders whose cause was not the first one taught: rows of a ledger, by the order's day."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    rows = od.learnt(actions.feedback(s, d).join(o, "order_id"), F.col("day"))
    return rows.withColumn("ord", F.col("order_id")).withColumn("order_id", F.col("order_id").cast("string"))


LEDGER = f"with f as (select x.*, cast(cast(o_orderdate as date) as varchar) as date from ({actions.FEEDBACK}) x join orders on o_orderkey = x.order_id where is_true_fault and actual <> root_cause)"


def phases(s, d):
    """The panel's hours as phases: the most frequent condition of all devices, and the share of readings that melt."""
    p = panel(s, d).withColumn("ord", F.floor(F.col("t") / 3600))
    c = p.groupBy("ord", "operating_condition").agg(F.count(F.lit(1)).alias("n"))
    each = c.groupBy("ord").agg(F.max_by("operating_condition", F.struct("n", "operating_condition")).alias("phase"), F.sum(F.when(F.col("operating_condition") == "melting", F.col("n")).otherwise(0)).alias("m"), F.sum("n").alias("n"))
    hour = lambda x: F.concat(F.lit("h"), x.cast("string"))
    return each.select("ord", hour(F.col("ord")).alias("start"), hour(F.col("ord") + 1).alias("end"), "phase", (F.col("m") / F.col("n")).alias("load"))


def conversation_inputs(s, d):
    """Each conversation without its last turn, as one text."""
    turns = ds.messages(table(s, d, "conversations"))
    return turns.select("conv_id", F.to_json(F.slice("messages", F.lit(1), F.greatest(F.lit(0), F.size("messages") - 1))).alias("input"))


LABELS = [learning.LEAK, learning.SCALE, learning.ev.NO_FAULT, learning.ev.DATA_BAD]
ALL_ALERTS = sensors.QUERIES["r_all_alerts"][1]
CUT = ALL_ALERTS.rindex("select device_id, rule_id, count(*)")

QUERIES = {
    "f_window_statistics": (
        lambda s, d: au.window_statistics(panel(s, d), CHANNELS, places=6),
        f"{WITH}, w as (select *, t // 600 as window_id from panel) " + " union all ".join(
            f"select device_id, window_id, '{c}' as channel, round(avg({c}) filter (where t % 600 >= 480), 6) + 0e0 as mean, round(case when count({c}) >= 10 then sqrt(greatest(0e0, (regr_syy({c}, t) - regr_sxy({c}, t) * regr_sxy({c}, t) / regr_sxx({c}, t)) / count({c}))) end, 6) + 0e0 as deviation, round(regr_slope({c}, t) * 60, 6) + 0e0 as slope from w group by 1, 2" for c in CHANNELS
        ),
    ),
    "b_sample_audit": (lambda s, d: au.audit_rows(samples(s, d), FAULTS), f"{NUMBERS} " + " union all ".join(f"select n as sample_id, '{name}' as failed from p where {cond}" for name, cond in WRONG.items())),
    "b_set_audit": (
        lambda s, d: au.audit_sets(x := samples(s, d), x.where("sample_id % 79 = 0").select("input", (F.col("seed") + 1).alias("seed"))),
        f"""{NUMBERS}, h as (select input, seed + 1 as seed from p where n % 79 = 0)
select 'duplicate_input' as check, split, cast(sum(c - 1) as bigint) as n from (select split, input, count(*) as c from p group by 1, 2 having count(*) > 1) group by 2
union all select 'episode_windows', split, count(*) from (select split, episode_id from p group by 1, 2 having not (count(*) = 2 and min(window_end) = 1200 and max(window_end) = 1800)) group by 2
union all select 'historical_input', split, count(*) from p where input in (select input from h) group by 2 union all select 'historical_seed', split, count(*) from p where seed in (select seed from h) group by 2""",
    ),
    "b_identity_overlaps": (
        lambda s, d: au.identity_overlaps(samples(s, d)),
        f"{NUMBERS} " + " union all ".join(f"select '{i}' as identity, '{a}_vs_{b}' as check, count(*) as n from (select {i} from p where split = '{a}' intersect select {i} from p where split = '{b}')" for i in ("input", "seed", "episode_id", "equipment_id") for a, b in (("train", "val"), ("train", "eval"), ("val", "eval"))),
    ),
    "b_set_counts": (
        lambda s, d: au.set_counts(samples(s, d), "injected", "shifted"),
        f"{NUMBERS} select split, count(*) as n, count(distinct episode_id) as episodes, count(*) filter (where n % 4 > 1) as injected_compound, count(*) filter (where n_out > 1) as multi_cause, count(*) filter (where n % 4 > n_out and n_out > 0) as partial_compound, count(*) filter (where n % 4 = 1 or n % 23 = 0) as hidden, count(*) filter (where n % 4 = 0) as normal, count(*) filter (where n % 6 = 0) as shifted from p group by 1",
    ),
    "b_leak_checks": (
        lambda s, d: au.leak_checks((x := samples(s, d)).where("sample_id % 3 = 0"), x.where("sample_id % 3 = 1"), x.where("sample_id % 2 = 0"), x.where("sample_id % 5 = 0")),
        f"""{NUMBERS}, a as (select * from p where n % 3 = 0), b as (select * from p where n % 3 = 1), c as (select * from p where n % 2 = 0), q as (select * from p where n % 5 = 0)
select 'prompts_vs_sft_eval' as check, count(*) as n from (select input from a intersect select input from q where split = 'eval') union all select 'stress_vs_sft_eval', count(*) from (select input from b intersect select input from q where split = 'eval')
union all select 'stress_vs_prompts', count(*) from (select input from a intersect select input from b) union all select 'prompts_vs_sft_train_val', count(*) from (select input from a intersect select input from q where split in ('train', 'val'))
union all select 'pool_seeds_vs_sft_seeds', count(*) from (select seed from c intersect select seed from q) union all select 'stress_seeds_vs_sft_seeds', count(*) from (select seed from b intersect select seed from q) union all select 'stress_seeds_vs_pool_seeds', count(*) from (select seed from b intersect select seed from c)""",
    ),
    "b_regression_cases": (
        lambda s, d: au.regression_cases(actions.feedback(s, d), learning.records(s, d).select("doc_id", "kind", "gold", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("prompt"), F.col("rc").alias("answer"))),
        f"select order_id as case_id, 'feedback' as kind, actual as gold, 'feedback' as source, prompt, coalesce(output, '') as answer from ({actions.FEEDBACK}) where is_true_fault and prompt is not null union all select doc_id, kind, gold, 'curated_eval', 'p' || doc_id, rc from ({learning.RECORDS}) where kind in ('boundary', 'transition', 'antihall', 'composite')",
    ),
    "b_fault_pool": (
        lambda s, d: au.split_pool(learning.stats(s, d).join(learning.spark_sql(s, d, learning.CASES, "orders"), "case_id").withColumnRenamed("gold", "fault"), ds.near_limit(F.col("fault"), *(F.col(c) for c in ("hum", "dh", "ps", "pq", "q"))), 200).select("case_id", "fault", "kind"),
        f"with st as ({learning.STATS}), x as (select st.*, gold as fault, coalesce(hum, 50) as h, coalesce(ps, 0) as p2, row_number() over (partition by gold order by st.case_id) as k from st join ({learning.CASES}) c on st.case_id = c.case_id) select case_id, fault, case when coalesce(case fault when '管道泄漏' then h between 60 and 70 or dh between 25e-1 and 6 when '水泵气蚀' then p2 between 2 and 45e-1 when '线圈结垢' then pq between 7 and 14 else q between 6 and 72e-1 and pq < 10 end, false) then 'boundary' else 'clear' end as kind from x where k <= 200",
    ),
    "a_confusion_table": (
        lambda s, d: au.confusion_table(learning.records(s, d), LABELS, "gold", "rc"),
        f"select gold, {', '.join(f'''count(*) filter (where rc = '{x}') as \"pred_{x}\"''' for x in LABELS)}, count(*) filter (where rc is null) as pred_other from ({learning.RECORDS}) group by 1",
    ),
    "u_input_overlap": (
        lambda s, d: ds.overlaps({"even": (x := conversation_inputs(s, d)).where("conv_id % 2 = 0"), "odd": x.where("conv_id % 2 = 1"), "third": x.where("conv_id % 3 = 0")}, [("even", "odd"), ("even", "third"), ("odd", "third")], "input"),
        "with t as (select conv_id, role, text, turn, max(turn) over (partition by conv_id) as last from conversations), x as (select conv_id, coalesce(string_agg(role || chr(1) || text, chr(2) order by turn) filter (where turn < last), '') as input from t group by 1) select 'even_vs_odd' as check, count(*) as n from (select input from x where conv_id % 2 = 0 intersect select input from x where conv_id % 2 = 1) union all select 'even_vs_third', count(*) from (select input from x where conv_id % 2 = 0 intersect select input from x where conv_id % 3 = 0) union all select 'odd_vs_third', count(*) from (select input from x where conv_id % 2 = 1 intersect select input from x where conv_id % 3 = 0)",
    ),
    "r_rule_nodes": (
        lambda s, d: r.nodes_of(r.all_alerts(panel(s, d), 7200), values(s, r.RULE_NODE, "rule_id, node, note")).groupBy("device_id", "node", "note").agg(F.count(F.lit(1)).alias("n")),
        f"{ALL_ALERTS[:CUT]} select device_id, node, coalesce(note, e.rule_id) as note, count(*) as n from every e left join (select * from {inline(r.RULE_NODE, 'rule_id, node, note')}) v on e.rule_id = v.rule_id group by 1, 2, 3",
    ),
    "g_recent_orders": (lambda s, d: cx.recent(ledger(s, d), 30).select("order_id", "date"), f"{LEDGER} select cast(order_id as varchar) as order_id, date from f where cast(date as date) >= (select max(cast(date as date)) - 30 from f)"),
    "g_component": (lambda s, d: cx.for_component(ledger(s, d), "泵").select("order_id", "component"), f"{LEDGER} select cast(order_id as varchar) as order_id, actual as component from f where contains(actual, '泵')"),
    "f_ledger_text": (
        lambda s, d: cx.ledger_text(ledger(s, d)).select(F.sha2("text", 256).alias("mark"), F.length("text").alias("length")),
        f"{LEDGER}, x as (select string_agg('- [' || date || '] ' || actual || ': 故障处置（反馈驱动记录）（持续优化智能体自动归档）', chr(10) order by order_id) as text from f where cast(date as date) >= (select max(cast(date as date)) - 60 from f)) select sha256(text) as mark, length(text) as length from x",
    ),
    "f_schedule_text": (
        lambda s, d: cx.schedule_text(phases(s, d), 4),
        f"{WITH}, c as (select t // 3600 as ord, operating_condition as o, count(*) as n from panel group by 1, 2), e as (select ord, arg_max(o, (n, o)) as phase, coalesce(sum(n) filter (where o = 'melting'), 0) / cast(sum(n) as double) as load from c group by 1), k as (select * from e order by ord desc limit 4) select string_agg('- h' || ord || '~h' || ord + 1 || ' ' || phase || ' 负载' || cast(cast(round(load * 100) as integer) as varchar) || '%', chr(10) order by ord) as text from k",
    ),
}
