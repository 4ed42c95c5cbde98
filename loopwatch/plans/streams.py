"""Queries that run as streams over files, to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loopwatch.operators.scoring import fuse
from loopwatch.plans.common import panel, table
from loopwatch.plans.sensors import OSC, RULE_CASES, W, WITH_G, trailing
from loopwatch.sources.store import shared_folder
from loopwatch.streaming import event_time as et
from loopwatch.streaming import processor as p
from loopwatch.streaming import sessions, sinks

#: Readings that only fill the state of the preloaded run.
SEED = 1000
KNOWN = "nullif(operating_condition, '')"


def r4(c):
    return F.round(c, 4) + F.lit(0.0)


def readings(s, d):
    """The panel as the live path reads it. A diagnosis that starts at a time divisible by seven succeeds."""
    score = fuse(F.col("pressure") / 100, F.col("flow_rate") / 10 - 1)
    return p.prepared(panel(s, d), score, F.col("outlet_temp") > 74, F.col("t") % 7 == 0)


def shown(frames):
    return frames.select("device_id", "t", r4("margin").alias("margin"), "at_risk", r4("eta").alias("eta"), "n_rules", r4("osc").alias("osc"), r4("score").alias("score"), "locked", "sustained", "fault", "started", "ordered")


def stateful_run(s, d):
    """Every reading of the panel through the live path, in files of stretches of time."""
    return shown(p.over_files(s, readings(s, d), p.live, dealt=True))  # the panel numbers a device's readings in one task


def preloaded_run(s, d):
    """The live path from the seed's end on; the seed is the query's initial state."""
    return shown(p.over_files(s, readings(s, d), p.live, dealt=True, before=F.col("t") < SEED))


def frames_sql(seed: int = 0) -> str:
    """The frames by windows over whole series, and the diagnoses by recursion."""
    fired = " + ".join(f"coalesce(cast({c} as integer), 0)" for _, c, _ in RULE_CASES)
    return f"""{WITH_G.replace("with ", "with recursive ", 1)}, {OSC.split(", ok as", 1)[1].join(["ok as", ""])},
a as (select dm.*, osc, {fired} + coalesce(cast(osc > 3 as integer), 0) as n_rules, t + 1 - {seed} as live, regr_slope(margin, t) {trailing(120)} as slope,
  5e-1 * greatest(0e0, least(1e0, pressure / 100 / 3e0)) + 5e-1 * greatest(0e0, least(1e0, -(flow_rate / 10 - 1))) as raw,
  coalesce(count({KNOWN}) {trailing(30)} >= 5 and min({KNOWN}) {trailing(30)} <> max({KNOWN}) {trailing(30)}, false) as changing
  from dm left join osc using (device_id, t)),
b as (select *, case when t < 99 then 0e0 else first_value(raw) over (partition by device_id, (t + 1) // 10 order by t) end as score,
  coalesce(t - max(case when changing then t end) over (partition by device_id order by t rows between unbounded preceding and current row) < 600, false) as locked from a),
c as (select *, sum(cast(score > 6e-1 as integer)) {trailing(60)} >= 25 as sustained from b),
z as (select *, (n_rules > 0 or outlet_temp > 74 or (not locked and sustained)) and live >= 600 as fault from c where t >= {seed}),
hits as (select device_id, t, t % 7 = 0 as good, t + 25 as until from z where fault),
nexts as (select h.device_id, h.t, h.good, n.t as later from hits h asof left join hits n on h.device_id = n.device_id and h.until <= n.t),
starts as (select device_id, t, good, later from nexts where (device_id, t) in (select (device_id, min(t)) from hits group by device_id)
  union all select n.device_id, n.t, n.good, n.later from starts s join nexts n on n.device_id = s.device_id and n.t = s.later where not s.good),
orders_ as (select device_id, t + 25 as t from starts where good)
select device_id, t, round(margin, 4) + 0e0 as margin, margin < 3 as at_risk,
  case when live >= 600 and live % 60 = 0 and slope < 0 and margin >= 3 and (margin - 3) / -slope <= 600 then round((margin - 3) / -slope, 4) + 0e0 end as eta,
  n_rules, round(osc, 4) + 0e0 as osc, round(score, 4) + 0e0 as score, locked, sustained, fault,
  (device_id, t) in (select (device_id, t) from starts) as started, (device_id, t) in (select (device_id, t) from orders_) as ordered from z"""


#: A session is stale six hours after its last event.
LIMIT = 21_600
#: Files hold four days; an event comes up to eight days after its time, and the watermark stays a day behind.
DAY, PART, HOLD, DELAY = 86_400, 345_600, 172_800, 86_400


def stale_run(s, d):
    """Sessions of users that have gone stale by the last event's time."""
    rows = table(s, d, "events").select(F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    return p.over_files(s, rows, lambda x: sessions.stale_sessions(x, "user_id", "ts", LIMIT), F.floor(F.unix_seconds("ts") / (5 * DAY)), ("user_id",))


STALE_SQL = f"""
with e as (select user_id, ts, epoch_us(ts) as us from events), g as (
  select *, lead(us) over (partition by user_id order by us) as later, coalesce(us - lag(us) over (partition by user_id order by us) > {LIMIT}000000, true) as first from e
), n as (select *, sum(cast(first as integer)) over (partition by user_id order by us) as k from g), x as (
  select user_id as key, k, min(ts) as first_ts, max(ts) as last_ts, count(*) as n, max(us) as last_us, max(later) filter (where later is null or later - us > {LIMIT}000000) as later,
  bool_or(later is null) as open from n group by 1, 2
)
select key, first_ts, last_ts, n, last_ts + interval {LIMIT} seconds as stale_ts from x where not open or last_us + {LIMIT}000000 <= (select max(us) // 1000 * 1000 from e)
"""


def arrivals(s, d):
    """Events in the order they come: each up to eight days after its time, and every tenth a second time two days later."""
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("value").cast("double").alias("value"))
    seconds = F.unix_seconds("ts") + F.col("event_id") % 5 * HOLD
    first = e.withColumn("arrived", F.floor(seconds / PART))
    return first.unionByName(e.where(F.col("event_id") % 10 == 0).withColumn("arrived", F.floor((seconds + HOLD) / PART)))


def event_run(s, d, closed):
    rows = arrivals(s, d)
    step = lambda x: closed(et.once(x, "ts", "event_id", f"{DELAY} seconds"))
    return p.over_files(s, rows, step, F.col("arrived"), (), 1)


ON_TIME = f"""
with e as (select *, epoch_us(ts) as us, epoch_us(ts) // 1000000 + event_id % 5 * {HOLD} as come from events), a as (
  select *, cast(come // {PART} as bigint) as part from e union all select *, cast((come + {HOLD}) // {PART} as bigint) from e where event_id % 10 = 0
), parts as (select part, max(us) // 1000 * 1000 as top from a group by part), marks as (
  select part, max(top) over (order by part rows between unbounded preceding and {{back}} preceding) - {DELAY}000000 as mark from parts
), ok as (
  select event_id, any_value(ts) as ts, any_value(us) as us, any_value(user_id) as user_id, any_value(event_type) as event_type, any_value(value) as value
  from a join marks using (part) where mark is null or us > mark group by event_id
), last as (select max(top) - {DELAY}000000 as mark from parts)"""
BACK = 2


def persisted_run(s, d):
    """One reading in ten of each batch, persisted by a query whose batches are all delivered a second time."""
    base = f"{shared_folder(s)}/stream/{uuid.uuid4().hex}"
    rows = panel(s, d).select("device_id", "t", "pressure")
    p.in_order(s, rows, f"{base}/in", F.floor(F.col("t") / p.STRETCH), ("device_id",))
    for state in ("first", "again"):  # another checkpoint: all batches come again, with the same ids
        stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{base}/in")
        query = stream.writeStream.foreachBatch(sinks.persist_batches(f"{base}/sink", p.sampled)).option("checkpointLocation", f"{base}/{state}").trigger(availableNow=True).start()
        query.awaitTermination()
    return sinks.persisted(s, f"{base}/sink", "device_id long, t long, pressure double").select("device_id", "t", F.round("pressure", 4).alias("pressure"))


QUERIES = {
    "t_stateful_run": (stateful_run, frames_sql()),
    "t_preloaded_run": (preloaded_run, frames_sql(SEED)),
    "t_stale_sessions": (stale_run, STALE_SQL),
    "t_event_windows": (
        lambda s, d: event_run(s, d, lambda x: et.windowed(x, "ts", "event_type", "1 day")).select("event_type", "start", "n", F.round("total", 4).alias("total")),
        f"{ON_TIME.format(back=BACK)} select event_type, make_timestamp(us // {DAY}000000 * {DAY}000000) as start, count(*) as n, round(sum(value), 4) as total from ok group by 1, 2 having max(us) // {DAY}000000 * {DAY}000000 + {DAY}000000 <= (select mark from last)",
    ),
    "t_event_sessions": (
        lambda s, d: event_run(s, d, lambda x: et.sessions(x, "ts", "user_id", "6 hours")),
        f"""{ON_TIME.format(back=BACK)}, g as (select *, coalesce(us - lag(us) over (partition by user_id order by us) >= {LIMIT}000000, true) as first from ok), k as (select *, sum(cast(first as integer)) over (partition by user_id order by us) as k from g)
select user_id, min(ts) as start, max(ts) + interval {LIMIT} seconds as "end", count(*) as n from k group by user_id, k having max(us) + {LIMIT}000000 <= (select mark from last)""",
    ),
    "s_persist_stream": (persisted_run, f"{WITH_G} select device_id, t, round(pressure, 4) as pressure from panel where t % 10 = 0"),
}
