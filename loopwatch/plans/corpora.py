"""Queries over scores, the store, labelled sets and the stream's batch forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loopwatch.contract import CHANNELS
from loopwatch.operators import datasets as ds
from loopwatch.operators import scoring as sc
from loopwatch.operators import stream_rules as st
from loopwatch.operators import text as tx
from loopwatch.plans.common import WITH, panel, r6, table
from loopwatch.plans.sensors import ALERTS, W, trailing
from loopwatch.sources import store
from loopwatch.streaming.processor import sampled

CONDITION = "case l_returnflag when 'A' then 'melting' end"
KNOWN, FRAME = "nullif(operating_condition, '')", "over (partition by device_id order by t rows between 29 preceding and current row)"
LOCK_SQL = f"{WITH}, c as (select *, coalesce(count({KNOWN}) {FRAME} >= 5 and min({KNOWN}) {FRAME} <> max({KNOWN}) {FRAME}, false) as changing from panel), l as (select device_id, t, coalesce(t - max(case when changing then t end) over (partition by device_id order by t rows between unbounded preceding and current row) < 600, false) as locked from c)"


def turns(s, d):
    return ds.messages(table(s, d, "conversations")).select("conv_id", F.size("messages").cast("long").alias("n"), F.sha2(F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["role"], x["text"])), "\n"), 256).alias("mark"))


QUERIES = {
    "l_zscore": (lambda s, d: sc.zscore(panel(s, d), "pressure").select("device_id", "t", F.round("z", 5).alias("z")), f"{WITH}, b as (select device_id, avg(pressure) as m, stddev_samp(pressure) as s from panel group by 1) select p.device_id, t, round((pressure - m) / s, 5) as z from panel p join b on p.device_id = b.device_id"),
    "l_diff_energy": (
        lambda s, d: sc.difference_energy(panel(s, d), CHANNELS, 60).select("device_id", "t", F.round("energy", 7).alias("energy")),
        f"{WITH}, e as (select *, ({" + ".join(f"abs({c} - lag({c}) {W})" for c in CHANNELS)}) / 12e0 as e from panel), f as (select *, coalesce(e, lead(e) {W}) as e2 from e) select device_id, t, round(avg(e2) {trailing(60)}, 7) as energy from f",
    ),
    "l_fusion": (lambda s, d: panel(s, d).select("device_id", "t", r6(sc.fuse(F.col("pressure") / 100, F.col("flow_rate") / 10 - 1)).alias("score")), f"{WITH} select device_id, t, round(5e-1 * greatest(0e0, least(1e0, pressure / 100 / 3e0)) + 5e-1 * greatest(0e0, least(1e0, -(flow_rate / 10 - 1))), 6) as score from panel"),
    "l_router": (lambda s, d: panel(s, d).groupBy(sc.route(F.col("pressure") / 500, F.col("t") % 5, F.when(F.col("t") % 3 == 0, 1800).otherwise(600)).alias("route")).agg(F.count(F.lit(1)).alias("n")), f"{WITH} select case when pressure / 500 > 6e-1 or t % 5 > 3 or t % 3 = 0 then 'precise' else 'fast' end as route, count(*) as n from panel group by 1"),
    "l_backtest_mape": (
        lambda s, d: sc.persistence_backtest(panel(s, d), "outlet_temp", 600, 60).select("device_id", r6("mape").alias("mape")),
        f"{WITH}, b as (select *, max(case when t % 660 = 599 then outlet_temp end) over (partition by device_id, t // 660) as last from panel) select device_id, round(avg(abs(outlet_temp - last) / greatest(abs(outlet_temp), 1e-6)), 6) as mape from b where t % 660 >= 600 and last is not null group by 1",
    ),
    "l_far_stable": (
        lambda s, d: st.stable(panel(s, d).withColumn("operating_condition", F.when(F.col("t") % 4000 < 2000, "melting").otherwise("idle"))).groupBy("device_id").agg(r6(F.avg(F.when((F.col("fault_label") == "none") & F.col("stable"), (F.col("pressure") > 300).cast("double")))).alias("far_stable"), r6(F.avg(F.when(F.col("fault_label") == "none", (F.col("pressure") > 300).cast("double")))).alias("far"), r6(F.avg(F.when(F.col("fault_label") != "none", (F.col("pressure") > 300).cast("double")))).alias("detection")),
        f"{WITH}, a as (select *, case when t % 4000 < 2000 then 'melting' else 'idle' end as c from panel), c as (select *, cast(coalesce(c <> lag(c) {W}, false) as integer) as changed from a), l as (select *, max(changed) {trailing(600)} = 0 as stable from c) select device_id, round(avg(cast(pressure > 300 as integer)) filter (where fault_label = 'none' and stable), 6) as far_stable, round(avg(cast(pressure > 300 as integer)) filter (where fault_label = 'none'), 6) as far, round(avg(cast(pressure > 300 as integer)) filter (where fault_label <> 'none'), 6) as detection from l group by 1",
    ),
    "l_lead_time": (
        lambda s, d: panel(s, d).groupBy("device_id").agg((F.min(F.when(F.col("outlet_temp") > 70, F.col("t"))) - F.min(F.when((F.col("outlet_temp") > 60) & (F.col("t") >= 1200) & (F.col("t") % 300 == 0), F.col("t")))).alias("lead")),
        f"{WITH} select device_id, min(t) filter (where outlet_temp > 70) - min(t) filter (where outlet_temp > 60 and t >= 1200 and t % 300 = 0) as lead from panel group by 1",
    ),
    "l_peak_per_fault": (lambda s, d: panel(s, d).where(F.col("fault_label").contains("结垢")).groupBy("device_id").agg(r6(F.max("outlet_temp")).alias("peak")), f"{WITH} select device_id, round(max(outlet_temp), 6) as peak from panel where contains(fault_label, '结垢') group by 1"),
    "s_range_scan": (lambda s, d: store.range_scan(panel(s, d), 1000, 2000, "melting", ["device_id", "t", "pressure"]).select("device_id", "t", r6("pressure").alias("pressure")), f"{WITH} select device_id, t, round(pressure, 6) as pressure from panel where t between 1000 and 2000 and operating_condition = 'melting'"),
    "s_latest_n": (lambda s, d: store.latest(panel(s, d), 100).select("device_id", "t"), f"{WITH} select device_id, t from panel order by t desc, device_id limit 100"),
    "s_partition_stats": (lambda s, d: store.partition_stats(panel(s, d)), f"{WITH} select t // 3600 as bucket, count(*) as n_rows from panel group by 1"),
    "s_insert_ignore": (lambda s, d: store.insert_ignore(panel(s, d).where("t % 3 = 0"), panel(s, d).where("t % 2 = 0"), ["device_id", "t"]).select("device_id", "t"), f"{WITH} select device_id, t from panel where t % 2 = 0 and t % 3 <> 0"),
    "s_sampled_persist": (lambda s, d: sampled(panel(s, d)).groupBy("device_id").agg(F.count(F.lit(1)).alias("n")), f"{WITH} select device_id, count(*) as n from panel where t % 10 = 0 group by 1"),
    "b_sliding_windows": (
        lambda s, d: ds.sliding_windows(panel(s, d).select("device_id", "t", "fault_label"), 1200, 600).groupBy("device_id", "start").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fault_label").alias("n_labels")).where("n = 1200"),
        f"{WITH}, s as (select distinct device_id, (t // 600) * 600 as start from panel) select s.device_id, s.start, count(*) as n, count(distinct fault_label) as n_labels from s join panel p on p.device_id = s.device_id and p.t >= s.start and p.t < s.start + 1200 group by 1, 2 having count(*) = 1200",
    ),
    "b_stratified_split": (lambda s, d: ds.stratified_split(table(s, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 0.1), "with x as (select doc_id, lang, row_number() over (partition by lang order by md5('split|' || cast(doc_id as varchar)), doc_id) as k, count(*) over (partition by lang) as n from documents) select doc_id, lang, case when k <= ceil(n * 1e-1) then 'val' else 'train' end as split from x"),
    "k_quota_take": (lambda s, d: ds.quota(table(s, d, "documents").select("doc_id", "source"), "source", "doc_id", 7), "with x as (select doc_id, source, row_number() over (partition by source order by md5('quota|' || cast(doc_id as varchar)), doc_id) as k from documents) select doc_id, source from x where k <= 7"),
    "u_split_leakage": (
        lambda s, d: (x := ds.stratified_split(table(s, d, "documents").select("doc_id", "lang", "text"), ["lang"], "doc_id", 0.1).withColumn("mark", ds.fingerprint(F.col("text")))).where("split = 'val'").join(x.where("split = 'train'").select("mark").distinct(), "mark", "left_semi").select("doc_id"),
        "with x as (select doc_id, text, row_number() over (partition by lang order by md5('split|' || cast(doc_id as varchar)), doc_id) as k, count(*) over (partition by lang) as n from documents), y as (select *, k <= ceil(n * 1e-1) as val from x) select doc_id from y where val and text in (select text from y where not val)",
    ),
    "u_fingerprint_dedupe": (lambda s, d: ds.dedupe_first(table(s, d, "documents").select("doc_id", "text"), ds.fingerprint(F.col("text")), "doc_id").select("doc_id"), "select min(doc_id) as doc_id from documents group by text"),
    "u_benchmark_overlap": (
        lambda s, d: table(s, d, "benchmark").select("item_id", F.explode(F.split("text", r"\s+")).alias("word")).distinct().join(table(s, d, "conversations").select(F.explode(F.split("text", r"\s+")).alias("word")).distinct(), "word", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("n")),
        r"with b as (select distinct item_id, unnest(regexp_split_to_array(text, '\s+')) as word from benchmark), c as (select distinct unnest(regexp_split_to_array(text, '\s+')) as word from conversations) select item_id, count(*) as n from b where word in (select word from c) group by 1",
    ),
    "b_messages_build": (turns, "select conv_id, count(*) as n, sha256(string_agg(role || ':' || text, chr(10) order by turn)) as mark from conversations group by 1"),
    "a_conflicting_labels": (lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id").groupBy(ds.fingerprint(F.col("text")).alias("mark")).agg(F.count_distinct("quality").alias("n")).where("n > 1").groupBy().agg(F.count(F.lit(1)).alias("n_conflicts")), "select count(*) as n_conflicts from (select text from documents d join labels l on d.doc_id = l.doc_id group by text having count(distinct quality) > 1)"),
    "f_numbers_in": (
        lambda s, d: table(s, d, "events").select("event_id", F.array_join(F.transform(tx.numbers_in(F.concat("props", F.lit(" -1.5, x2"))), lambda x: x.cast("int").cast("string")), ",").alias("numbers")),
        r"select event_id, array_to_string(list_transform(regexp_extract_all(props || ' -1.5, x2', '-?\d+\.?\d*'), lambda x: cast(trunc(cast(x as double)) as integer)), ',') as numbers from events",
    ),
    "t_score_throttle": (lambda s, d: panel(s, d).select("device_id", "t", F.coalesce(st.throttled_at(100), F.lit(-1)).alias("taken")), f"{WITH} select device_id, t, case when t >= 100 then 100 + (t - 100) // 10 * 10 else -1 end as taken from panel"),
    "t_transition_lock": (lambda s, d: st.transition_lock(panel(s, d).select("device_id", "t", "operating_condition")).select("device_id", "t", "locked"), f"{LOCK_SQL} select * from l"),
    "t_sustained": (lambda s, d: st.sustained(panel(s, d).select("device_id", "t", "pressure"), F.col("pressure") > 300).select("device_id", "t", "sustained"), f"{WITH} select device_id, t, coalesce(sum(cast(pressure > 300 as integer)) {trailing(60)} >= 25, false) as sustained from panel"),
    "t_first_trigger": (lambda s, d: st.first_trigger(panel(s, d), F.col("outlet_temp") > 70), f"{WITH} select device_id, min(t) as first_t from panel where outlet_temp > 70 and t >= 600 group by 1"),
    "t_sessions": (
        lambda s, d: table(s, d, "events").withColumn("gap", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id")) > 3_600_000_000, F.lit(True))).groupBy("user_id").agg(F.count_if("gap").alias("n_sessions")),
        "with g as (select user_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 3600000000, true) as gap from events) select user_id, count(*) filter (where gap) as n_sessions from g group by 1",
    ),
}
