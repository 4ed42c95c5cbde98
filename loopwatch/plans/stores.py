"""Queries over a store that is written, shared sessions, answers about the present, backtests and paired resampling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loopwatch.contract import CHANNELS
from loopwatch.operators import answers as an
from loopwatch.operators import audit as au
from loopwatch.operators import metrics as m
from loopwatch.operators import scoring as sc
from loopwatch.operators import text as tx
from loopwatch.plans.common import WITH, panel, r6, table
from loopwatch.sources import session, store
from loopwatch.streaming import processor


def built(s, d) -> str:
    """A store of the panel, written in two overlapping loads, the second of which comes twice."""
    path = f"{store.shared_folder(s)}/store/{uuid.uuid4().hex}"
    rows = store.written(panel(s, d))  # three loads read it
    store.insert(s, path, rows.where("t % 3 <> 0"), ["device_id", "t"])
    for _ in range(2):
        store.insert(s, path, rows.where("t % 2 = 0 or t % 3 = 0").withColumn("pressure", F.col("pressure") + F.when(F.col("t") % 3 != 0, 1000.0).otherwise(0.0)), ["device_id", "t"])
    return path


def store_sizes(s, d):
    return store.sizes(s, built(s, d)).select("bucket", "n_rows", (F.col("bytes") > 0).alias("sized"), F.col("n_files").between(1, 4).alias("few_files"))


def store_range(s, d):
    """Readings of an hour and a bit, from the store; what a later load says of a held reading doesn't count."""
    return store.range_scan(store.read_store(s, built(s, d)), 1000, 5000, None, ["device_id", "t", "pressure"]).select("device_id", "t", F.round("pressure", 4).alias("pressure"))


def shared_session(s, d):
    """Two summaries of one session's readings."""
    held = session.Sessions()
    frame = lambda: held.open("line", lambda: panel(s, d).select("device_id", "t", "pressure", "operating_condition"))
    by_device = frame().groupBy(F.col("device_id").cast("string").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last_t"))
    by_condition = frame().groupBy(F.col("operating_condition").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last_t"))
    return by_device.unionByName(by_condition)


def questions(s, d):
    """A question for each order, about a device at a time; some devices are never heard of, some times lie after the last reading."""
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 6).cast("long").alias("device_id"), (F.col("o_orderkey") * 7 % 20_000).cast("long").alias("t"))


ASKED = f"{WITH}, q as (select o_orderkey as case_id, cast(o_custkey % 6 as bigint) as device_id, cast(o_orderkey * 7 % 20000 as bigint) as t from orders), a as (select q.case_id, q.device_id, q.t, p.t as read_t, p.* exclude (device_id, t) from q asof left join panel p on q.device_id = p.device_id and q.t >= p.t)"
PHASE = "case operating_condition " + " ".join(f"when '{k}' then '{k}'" for k in an.PHASES) + " else 'unknown' end"
LABEL = f"case {PHASE} " + " ".join(f"when '{k}' then '{v}'" for k, v in an.PHASES.items()) + " end"


def judged(s, d):
    """Orders as evaluation windows of two methods, by customer."""
    k = F.col("o_orderkey")
    return table(s, d, "orders").select("o_custkey", (k % 10 < 9).cast("int").alias("lora"), ((k * 7 + F.col("o_custkey")) % 10 < 8).cast("int").alias("dpo"))


def bootstrap_sql(draws: int = 10_000, seed: int = 7) -> str:
    mix = lambda x: f"(xor({x}, ({x}) >> 16) * {m._MIX}) & {m._32}"
    counts = " + ".join(f"cast(h >= {p} as bigint)" for p in m.POISSON)
    return f"""
with o as (select o_custkey as c, sum(cast(o_orderkey % 10 < 9 as integer)) as a, sum(cast((o_orderkey * 7 + o_custkey) % 10 < 8 as integer)) as b, count(*) as n from orders group by 1),
x as (select d, a, b, n, xor(((c & {m._32}) * {m._BY_CLUSTER}) & {m._32}, ((d + {seed}) * {m._BY_DRAW}) & {m._32}) as h0 from o, range({draws}) as r(d)),
y as (select d, a, b, n, {mix("h0")} as h1 from x), z as (select d, a, b, n, {mix("h1")} as h2 from y), w as (select d, a, b, n, xor(h2, h2 >> 16) as h from z),
v as (select d, sum(a * k) / cast(sum(n * k) as double) as a, sum(b * k) / cast(sum(n * k) as double) as b from (select *, {counts} as k from w) group by d having sum(n * k) > 0),
p as (select sum(a) / cast(sum(n) as double) as a, sum(b) / cast(sum(n) as double) as b from o),
l as (select 'lora' as method, a as m from v union all select 'dpo', b from v union all select 'dpo-lora', b - a from v), q as (select 'lora' as method, a as m from p union all select 'dpo', b from p union all select 'dpo-lora', b - a from p)
select q.method, round(any_value(q.m), 6) as mean, round(quantile_cont(l.m, 0.025), 6) as lo, round(quantile_cont(l.m, 0.975), 6) as hi from q join l using (method) group by 1"""


BACKTEST = f"""{WITH}, n as (select device_id, max(t) + 1 as n from panel group by 1), o as (select device_id, n - 120 * (k + 1) as origin from n, range(8) as r(k) where n - 120 * (k + 1) - 600 >= 0),
x as (select o.device_id, origin, max(case when t = origin - 1 then outlet_temp end) as last, regr_slope(outlet_temp, t) as slope from o join panel p on p.device_id = o.device_id and p.t >= origin - 600 and p.t < origin group by 1, 2),
s as (select x.device_id, p.t - origin as step, outlet_temp as y, last as hold, last + slope * (p.t - origin + 1) as trend from x join panel p on p.device_id = x.device_id and p.t >= origin and p.t < origin + 120)
select method, device_id, cast(step as integer) as step, count(*) as n, round(avg(abs(f - y) / greatest(abs(y), 1e-6)), 6) + 0e0 as mape from (select device_id, step, y, 'hold' as method, hold as f from s union all select device_id, step, y, 'trend', trend from s) group by 1, 2, 3"""

def as_text(s, d):
    """The panel as a recorder's text columns, with a time that can't be read and pressures that are no numbers."""
    p = panel(s, d)
    when = F.when(F.col("t") % 17 == 0, "bad").otherwise(F.date_format(F.timestamp_seconds(1_767_225_600 + F.col("t")), "yyyy-MM-dd HH:mm:ss"))
    pressure = F.when(F.col("t") % 19 == 0, "NaN").when(F.col("t") % 23 == 0, "-").otherwise(F.col("pressure").cast("string"))
    return p.select(when.alias("timestamp"), *(pressure.alias(c) if c == "pressure" else F.col(c).cast("string").alias(c) for c in CHANNELS), "operating_condition", "fault_label", "device_id", F.floor(F.col("t") / 2048).alias("part"))


def folder(s) -> str:
    return f"{store.shared_folder(s)}/files/{uuid.uuid4().hex}"


def by_condition(df):
    return df.groupBy("operating_condition").agg(F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("n_times"), F.count("pressure").alias("n_pressures"), F.round(F.sum("pressure"), 3).alias("total"), F.max("timestamp").cast("string").alias("last"))


def csv_scan(s, d):
    path = folder(s)
    as_text(s, d).drop("part").write.option("header", True).csv(path)
    return by_condition(store.read_csv(s, path))


def upload(s, d):
    """JSON lines that lack most of the contract's columns; lines without a time go."""
    path = folder(s) + ".jsonl"
    as_text(s, d).select("timestamp", "pressure", "operating_condition").write.json(path)
    return by_condition(store.read_upload(s, path))


def replayed(s, d):
    """The CSV files as a stream, a few for each batch."""
    path = folder(s)
    as_text(s, d).hint("rebalance", "part").drop("part", "device_id").write.option("header", True).csv(f"{path}/in")
    stream = store.replay(s, f"{path}/in", 4)
    return by_condition(processor.run_available(s, stream, path))


def by_condition_sql(keep: str) -> str:
    return f"""{WITH}, x as (select *, case when t % 17 <> 0 then make_timestamp((1767225600 + t) * 1000000) end as ts, case when t % 19 <> 0 and t % 23 <> 0 then pressure end as p from panel)
select operating_condition, count(*) as n, count(ts) as n_times, count(p) as n_pressures, round(sum(p), 3) as total, cast(max(ts) as varchar) as last from x where {keep} group by 1"""


def evidence(s, d):
    """What each window of the panel could quote, every third wrongly, and whether it is traced to its sensors."""
    stats = au.window_statistics(panel(s, d), ["pressure", "outlet_temp"], held=True)
    named = F.when(F.col("channel") == "pressure", "管道压力").otherwise("出水温度")
    w = stats.groupBy("device_id", "window_id").agg(F.array_sort(F.collect_list(F.struct(named.alias("name"), "mean", "deviation", "slope"))).alias("observed"))
    n = F.col("device_id") * 1000 + F.col("window_id")
    off = F.when(n % 3 == 0, 1.0).otherwise(0.0)
    items = F.transform("observed", lambda x: F.concat(x["name"], F.lit("均值 "), F.format_string("%.1f", x["mean"] + off)))
    said = F.when(n % 5 == 0, F.expr("cast(array() as array<string>)")).when(n % 7 == 0, F.array(F.lit("缺失通道：湿度"))).otherwise(F.array_append(items, F.lit("缺失通道：湿度")))
    return w.select("device_id", "window_id", tx.traceable(said, F.col("observed"), F.lit("湿度"), ["管道压力", "出水温度"]).alias("traced"))


QUERIES = {
    "s_csv_scan": (csv_scan, by_condition_sql("true")),
    "s_upload": (upload, by_condition_sql("ts is not null")),
    "s_replay": (replayed, by_condition_sql("ts is not null")),
    "f_traced_evidence": (evidence, f"{WITH}, w as (select distinct device_id, t // 600 as window_id from panel), k as (select *, device_id * 1000 + window_id as n from w) select device_id, window_id, n % 3 <> 0 and n % 5 <> 0 and n % 7 <> 0 as traced from k"),
    "s_store_sizes": (store_sizes, f"{WITH} select t // 3600 as bucket, count(*) as n_rows, true as sized, true as few_files from panel group by 1"),
    "s_store_range": (store_range, f"{WITH} select device_id, t, round(pressure, 4) as pressure from panel where t between 1000 and 5000"),
    "s_session_source": (shared_session, f"{WITH} select cast(device_id as varchar) as what, count(*) as n, max(t) as last_t from panel group by 1 union all select operating_condition, count(*), max(t) from panel group by 1"),
    "s_manifest": (
        lambda s, d: store.manifest(table(s, d, "documents").select("doc_id", "lang", "n_chars", "source"), ["lang"]),
        """with x as (select lang, md5(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source})) as h from documents)
select lang, count(*) as n_rows, cast(sum(cast('0x' || substr(h, 1, 15) as bigint)) as varchar) || '-' || cast(sum(cast('0x' || substr(h, 17, 15) as bigint)) as varchar) as mark from x group by 1""",
    ),
    "g_current": (
        lambda s, d: an.snapshots(questions(s, d), panel(s, d)).select("case_id", "read_t", "age", "fresh", "condition", *(r6(c).alias(c) for c in CHANNELS)),
        f"{ASKED} select case_id, read_t, t - read_t as age, coalesce(t - read_t <= 30, false) as fresh, case when read_t is not null then {PHASE} end as condition, {', '.join(f'round({c}, 6) + 0e0 as {c}' for c in CHANNELS)} from a",
    ),
    "g_current_answer": (
        lambda s, d: an.headline(an.snapshots(questions(s, d), panel(s, d).withColumn("operating_condition", F.when(F.col("t") % 3 != 0, F.col("operating_condition"))))),
        f"""{ASKED}, b as (select case_id, t, read_t, case when read_t % 3 <> 0 then operating_condition end as operating_condition from a)
select case_id, case when read_t is null then '还没有本轮实际监测数据' else (case when t - read_t <= 30 then '当前回放观测' else '最近一次观测（已停止或数据超过 30 秒未更新）' end) || '：' || {LABEL} || '。数据时间：' || read_t end as answer from b""",
    ),
    "g_limits": (
        lambda s, d: an.limits(questions(s, d)),
        "select o_orderkey as case_id, rule, setting from orders, (values " + ", ".join(f"('{a}', '{b}')" for a, b in an.LIMITS) + ") as v(rule, setting)",
    ),
    "a_paired_bootstrap": (lambda s, d: m.paired_bootstrap(judged(s, d), "o_custkey", ["lora", "dpo"]).select("method", *(r6(c).alias(c) for c in ("mean", "lo", "hi"))), bootstrap_sql()),
    "l_window_scores": (
        lambda s, d: sc.WindowEnergy().scores(panel(s, d), ["flow_rate", "flow_velocity"]).select("device_id", "t", r6("score").alias("score")),
        f"{WITH}, x as (select device_id, t, count(*) over w as n, sum(flow_rate * flow_rate + flow_velocity * flow_velocity) over w as e from panel window w as (partition by device_id order by t rows between 59 preceding and current row)) select device_id, t, round(sqrt(e / 120), 6) as score from x where n = 60",
    ),
    "l_backtest_steps": (
        lambda s, d: sc.errors_by_step(panel(s, d), "outlet_temp", {"hold": sc.HoldLast(600, 120), "trend": sc.Trend(600, 120)}, 8).select("method", "device_id", "step", "n", r6("mape").alias("mape")),
        BACKTEST,
    ),
}
