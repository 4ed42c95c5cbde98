"""Queries over the sensor panel: contract, quality, features and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loopwatch.contract import CHANNELS
from loopwatch.functions import features as f
from loopwatch.operators import quality as q
from loopwatch.operators import rules as r
from loopwatch.plans.common import WITH, dirty, inline, panel, r6, table, values

BOUND_SQL = {c: f"({c} < {lo!r} or {c} > {hi!r})" for c, (lo, hi) in q.BOUNDS.items()}
FIRST = f"{WITH}, firsts as (select * from (select *, row_number() over (partition by device_id, t order by arrival_seq) as rn from dirty) where rn = 1)"
GRID = f"{FIRST}, span as (select device_id, min(t) as lo, max(t) as hi from firsts group by 1), g as (select device_id, unnest(range(lo, hi + 1)) as t from span), grid as (select g.device_id, g.t, firsts.* exclude (device_id, t) from g left join firsts on g.device_id = firsts.device_id and g.t = firsts.t)"
FILLED = f"{GRID}, labelled as (select * replace (coalesce(last_value(operating_condition ignore nulls) over (partition by device_id order by t rows between unbounded preceding and current row), first_value(operating_condition ignore nulls) over (partition by device_id order by t rows between current row and unbounded following)) as operating_condition) from grid)"
DEW = "(cabinet_temp - 243.12e0 * g / (17.62e0 - g))"
WITH_G = f"{WITH}, d as (select *, ln(greatest(1e0, least(100e0, cabinet_humidity)) / 100e0) + 17.62e0 * cabinet_temp / (243.12e0 + cabinet_temp) as g from panel), dm as (select *, {DEW} as margin from d)"
RULE_CASES = [
    ("OUTLET_TEMP_HIGH", "outlet_temp > 55", "outlet_temp"), ("INLET_TEMP_HIGH", "inlet_temp > 35", "inlet_temp"),
    ("DELTA_T_HIGH", "outlet_temp - inlet_temp > 25", "outlet_temp - inlet_temp"), ("PRESSURE_LOW", "pressure < 150", "pressure"),
    ("PRESSURE_HIGH", "pressure > 300", "pressure"), ("FLOW_LOW", "flow_rate / 8e0 < 8e-1", "flow_rate"), ("FLOW_HIGH", "flow_rate / 8e0 > 12e-1", "flow_rate"),
    ("CONDUCTIVITY_HIGH", "conductivity > 800", "conductivity"), ("DEW_MARGIN_LOW", "margin < 3", "margin"), ("HUMIDITY_HIGH", "cabinet_humidity > 70", "cabinet_humidity"),
    ("COMBO_HEAT_BUILDUP", "flow_rate / 8e0 < 8e-1 and outlet_temp > 55", "outlet_temp"), ("COMBO_LEAK_SUSPECT", "pressure < 180 and cabinet_humidity > 70", "pressure"),
]
ROW_RULES = " union all ".join(f"select device_id, t, '{n}' as rule_id, {v} as v from dm where {c}" for n, c, v in RULE_CASES)
ALERTS = f"{WITH_G}, row_alerts as ({ROW_RULES})"
SENSORS = list(r.RULE_SENSOR.items())
LAST = ["outlet_temp", "inlet_temp", "pressure", "flow_rate", "tank_level", "cabinet_humidity", "conductivity"]
W = "over (partition by device_id order by t)"


def trailing(n: int) -> str:
    return f"over (partition by device_id order by t rows between {n - 1} preceding and current row)"


OSC = f"{WITH}, ok as (select device_id, t, pressure, row_number() over (partition by device_id order by t) as k from panel where pressure is not null), o as (select device_id, t, regr_count(pressure, k) {trailing(60)} as n, regr_syy(pressure, k) {trailing(60)} as syy, regr_sxy(pressure, k) {trailing(60)} as sxy, regr_sxx(pressure, k) {trailing(60)} as sxx from ok), osc as (select device_id, t, case when n >= 10 then sqrt(greatest(0e0, (syy - sxy * sxy / sxx) / n)) end as osc from o)"
HEAT = f"{WITH}, h as (select *, case when electric_power >= 500 then (furnace_temp - lag(furnace_temp, 600) {W}) / 10e0 / electric_power end as ratio from panel)"


def counts(df):
    return df.groupBy("device_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


def contract_coerce(s, d):
    raw = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "bad").when(F.col("event_id") % 11 == 0, "NaN").otherwise(F.col("value").cast("string")).alias("v"))
    from loopwatch.contract import finite

    return raw.select("event_id", finite("v").alias("v"))


def clean_condition(s, d):
    """All twelve channels, each missing reading filled."""
    return sixes(q.condition_fill(q.on_grid(dirty(s, d), labels=True), CHANNELS))


def sixes(df):
    return df.select("device_id", "t", *(r6(c).alias(c) for c in CHANNELS))


NEAR = "last_value(case when {c} is not null then {x} end ignore nulls) over (partition by {p} order by t rows between unbounded preceding and 1 preceding) as p{y}, first_value(case when {c} is not null then {x} end ignore nulls) over (partition by {p} order by t rows between 1 following and unbounded following) as n{y}"


def near(c: str, p: str) -> str:
    return NEAR.format(c=c, x="t", y="t", p=p) + ", " + NEAR.format(c=c, x=c, y="v", p=p)


def per_channel(form: str, sep: str = ", ", channels=CHANNELS) -> str:
    return sep.join(form.replace("@r", repr(q.RATES[c])).replace("@lo", repr(q.BOUNDS[c][0])).replace("@hi", repr(q.BOUNDS[c][1])).replace("@", c) for c in channels)


AROUND = "(partition by device_id order by t rows between 60 preceding and 60 following)"
LABEL = "coalesce(last_value({c} ignore nulls) over (partition by device_id order by t rows between unbounded preceding and current row), first_value({c} ignore nulls) over (partition by device_id order by t rows between current row and unbounded following)) as {c}"
#: The whole chain in the order of the operators: grid, labels, bounds, rolling medians, jumps, both fills.
MASKED = f"""{GRID}, lab as (select * replace ({LABEL.format(c='operating_condition')}, {LABEL.format(c='fault_label')}) from grid),
bounded as (select * replace ({per_channel('case when @ between @lo and @hi then @ end as @')}), {per_channel('case when @ < @lo or @ > @hi then 1 else 0 end', ' + ')} as n_bad from lab),
meds as (select *, {per_channel('case when count(@) over w >= 5 then quantile_cont(@, 0.5) over w end as med_@')} from bounded window w as {AROUND}),
devs as (select *, {per_channel('abs(@ - med_@) as dev_@')} from meds),
mads as (select *, {per_channel('case when count(dev_@) over w >= 5 then quantile_cont(dev_@, 0.5) over w end as mad_@')}, {per_channel(f'coalesce(abs(@ - lag(@) {W}) > @r, false) as jump_@')} from devs window w as {AROUND}),
levels as (select device_id, {per_channel('coalesce(quantile_cont(abs(@), 0.5) filter (where abs(@) > 1e-6), 1e0) as level_@')} from bounded group by 1),
flags as (select mads.*, {per_channel('case when mad_@ is not null then greatest(14826e-4 * mad_@, greatest(2e-1, 2e-2 * level_@)) end as sigma_@')}, {per_channel(f'coalesce(lead(jump_@) over (partition by mads.device_id order by t), false) as next_@')} from mads join levels on mads.device_id = levels.device_id),
outs as (select *, {per_channel('coalesce(dev_@ > 5 * sigma_@, false) or jump_@ or next_@ as out_@')} from flags),
masked as (select * replace ({per_channel('case when not out_@ then @ end as @')}), n_bad + {per_channel('cast(out_@ as integer)', ' + ')} as n_out from outs)"""


def filled(src: str, by: str, into: str, line: bool) -> str:
    """A common table that fills each channel of src from its neighbours within `by`."""
    at = lambda c: near(c, by).replace(" as p", f" as {c}_p").replace(" as n", f" as {c}_n")
    both = "(1e0 / (t - @_pt) * @_pv + 1e0 / (@_nt - t) * @_nv) / (1e0 / (t - @_pt) + 1e0 / (@_nt - t))" if not line else "@_pv + (t - @_pt) / cast(@_nt - @_pt as double) * (@_nv - @_pv)"
    return f"{into}_b as (select *, {', '.join(at(c) for c in CHANNELS)} from {src}), {into} as (select device_id, t, operating_condition, {per_channel(f'coalesce(@, {both}, @_pv, @_nv) as @')} from {into}_b)"


CLEAN = f"{MASKED}, {filled('masked', 'device_id, operating_condition', 'half', False)}, {filled('half', 'device_id', 'whole', True)}, gaps as (select device_id, {per_channel('bool_or(@ is null) as gap_@')} from masked group by 1)"
SIX = per_channel("round(@, 6) as @")


def tail_stats(s, d):
    w = Window.partitionBy("device_id").orderBy(F.desc("t"))
    last = panel(s, d).withColumns({"k": F.row_number().over(w), "n_rows": F.count(F.lit(1)).over(Window.partitionBy("device_id"))}).where("k <= 240")
    now = lambda c: F.avg(F.when(F.col("k") <= 120, F.col(c)))
    before = F.avg(F.when(F.col("k") > 120, F.col("cabinet_humidity")))
    return last.groupBy("device_id").agg(
        r6(now("pressure")).alias("pressure"), r6(now("cabinet_humidity")).alias("humidity"), r6(now("flow_rate")).alias("flow"), r6(now("tank_level")).alias("level"),
        r6(F.when(F.count(F.lit(1)) >= 240, now("cabinet_humidity") - before)).alias("humidity_rise"), r6(now("outlet_temp") - now("inlet_temp")).alias("delta_t"),
        r6(f.detrended_std("case when k <= 120 then pressure end")).alias("swing"), r6(F.avg(F.when(F.col("k") <= 120, f.pq_offset())) * 100).alias("pq"),
        F.round(F.when((F.count(F.when(F.col("k") <= 120, 1)) >= 20) & (now("electric_power") > 500), (F.max(F.when(F.col("k") == 1, F.col("furnace_temp"))) - F.max(F.when(F.col("k") == F.least(F.lit(120), F.col("n_rows")), F.col("furnace_temp")))) / (F.count(F.when(F.col("k") <= 120, 1)) / 60.0) / now("electric_power")), 8).alias("heating"),
    )


LATE, PQ_SQL = "case when k <= 120 then pressure end", "(pressure - (120e0 + 22e-1 * flow_rate * flow_rate)) / (120e0 + 22e-1 * flow_rate * flow_rate)"
TAIL = f"""{WITH}, l as (select *, row_number() over (partition by device_id order by t desc) as k, count(*) over (partition by device_id) as n_rows from panel)
select device_id, round(avg(pressure) filter (where k <= 120), 6) as pressure, round(avg(cabinet_humidity) filter (where k <= 120), 6) as humidity,
 round(avg(flow_rate) filter (where k <= 120), 6) as flow, round(avg(tank_level) filter (where k <= 120), 6) as level,
 round(case when count(*) >= 240 then avg(cabinet_humidity) filter (where k <= 120) - avg(cabinet_humidity) filter (where k > 120) end, 6) as humidity_rise,
 round(avg(outlet_temp) filter (where k <= 120) - avg(inlet_temp) filter (where k <= 120), 6) as delta_t,
 round(case when count({LATE}) >= 10 then sqrt(greatest(0e0, (regr_syy({LATE}, t) - regr_sxy({LATE}, t) * regr_sxy({LATE}, t) / regr_sxx({LATE}, t)) / count({LATE}))) end, 6) as swing, round(avg({PQ_SQL}) filter (where k <= 120) * 100, 6) as pq,
 round(case when count(*) filter (where k <= 120) >= 20 and avg(electric_power) filter (where k <= 120) > 500 then (max(furnace_temp) filter (where k = 1) - max(furnace_temp) filter (where k = least(120, n_rows))) / (count(*) filter (where k <= 120) / 60e0) / avg(electric_power) filter (where k <= 120) end, 8) as heating
from l where k <= 240 group by device_id"""


def window_stats(s, d):
    p = panel(s, d).withColumn("window_id", F.floor(F.col("t") / 600).cast("long"))
    return p.groupBy("device_id", "window_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(F.col("t") % 600 >= 480, F.col("pressure")))).alias("tail_mean"), r6(f.detrended_std("pressure")).alias("osc"), F.round(f.slope("outlet_temp") * 60, 6).alias("slope_per_min"))


QUERIES = {
    "contract_coerce": (contract_coerce, "select event_id, case when event_id % 7 = 0 or event_id % 11 = 0 then null else value end as v from events"),
    "panel_profile": (
        lambda s, d: panel(s, d).groupBy("device_id", "operating_condition").agg(F.count(F.lit(1)).alias("n"), *(r6(F.avg(c)).alias(c) for c in ("pressure", "flow_rate", "outlet_temp"))),
        f"{WITH} select device_id, operating_condition, count(*) as n, round(avg(pressure), 6) as pressure, round(avg(flow_rate), 6) as flow_rate, round(avg(outlet_temp), 6) as outlet_temp from panel group by 1, 2",
    ),
    "json_props_extract": (
        lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")),
        "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events",
    ),
    "series_downsample": (
        lambda s, d: panel(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("device_id"))).where(F.col("t") % F.greatest(F.lit(1), F.floor(F.col("n") / 2000)) == 0).select("device_id", "t", F.round(F.coalesce("pressure", F.lit(0.0)), 1).alias("pressure")),
        f"{WITH}, n as (select *, count(*) over (partition by device_id) as n from panel) select device_id, t, round(coalesce(pressure, 0e0), 1) as pressure from n where t % greatest(1, n // 2000) = 0",
    ),
    "q_out_of_order": (lambda s, d: q.out_of_order(dirty(s, d)), f"{WITH} select device_id, count(*) filter (where t < p) as n_out_of_order from (select device_id, t, lag(t) over (partition by device_id order by arrival_seq) as p from dirty) group by 1"),
    "q_dedup_keep_first": (lambda s, d: q.dedup_keep_first(dirty(s, d)).select("device_id", "t", "arrival_seq"), f"{FIRST} select device_id, t, arrival_seq from firsts"),
    "q_grid_gaps": (lambda s, d: q.to_grid(q.dedup_keep_first(dirty(s, d))).groupBy("device_id").agg(F.count(F.lit(1)).alias("n_grid"), F.count_if(F.col("arrival_seq").isNull()).alias("n_gaps")), f"{GRID} select device_id, count(*) as n_grid, count(*) filter (where arrival_seq is null) as n_gaps from grid group by 1"),
    "q_label_ffill": (lambda s, d: q.fill_labels(q.to_grid(q.dedup_keep_first(dirty(s, d)))).select("device_id", "t", "operating_condition"), f"{FILLED} select device_id, t, operating_condition from labelled"),
    "q_bounds_mask": (
        lambda s, d: q.mask_bounds(dirty(s, d)).groupBy("device_id").agg(*(F.count(c).alias(c) for c in q.BOUNDS)),
        f"{WITH} select device_id, " + ", ".join(f"count(*) filter (where {c} is not null and not {BOUND_SQL[c]}) as {c}" for c in q.BOUNDS) + " from dirty group by 1",
    ),
    "q_hampel": (
        lambda s, d: q.hampel_flags(dirty(s, d), CHANNELS).select("device_id", "t", *(x for c in CHANNELS for x in (r6(f"med_{c}").alias(f"med_{c}"), r6(f"sigma_{c}").alias(f"sigma_{c}"), F.col(f"is_outlier_{c}").cast("int").alias(f"out_{c}")))),
        f"{MASKED} select device_id, t, {per_channel('round(med_@, 6) as med_@, round(sigma_@, 6) as sigma_@, cast(coalesce(dev_@ > 5 * sigma_@, false) as integer) as out_@')} from outs",
    ),
    "q_rate_limit": (
        lambda s, d: q.rate_flags(dirty(s, d), CHANNELS).select("device_id", "t", *(F.col(f"is_jump_{c}").cast("int").alias(f"jump_{c}") for c in CHANNELS)),
        f"{MASKED} select device_id, t, {per_channel('cast(jump_@ or next_@ as integer) as jump_@')} from outs",
    ),
    "q_condition_fill": (
        clean_condition,
        f"{FILLED}, {filled('labelled', 'device_id, operating_condition', 'half', False)} select device_id, t, {SIX} from half",
    ),
    "q_linear_fill": (
        lambda s, d: sixes(q.linear_fill(q.on_grid(dirty(s, d).select("device_id", "t", "arrival_seq", *CHANNELS)).drop("arrival_seq"), CHANNELS)),
        f"{GRID}, {filled('grid', 'device_id', 'whole', True)} select device_id, t, {SIX} from whole",
    ),
    "q_report": (
        lambda s, d: q.report(dirty(s, d)),
        FIRST + ", f as (select *, " + " + ".join(f"(case when {BOUND_SQL[c]} then 1 else 0 end)" for c in q.BOUNDS) + " as bad, " + " + ".join(f"(case when {c} is null then 1 else 0 end)" for c in q.BOUNDS)
        + """ as nulls from firsts), k as (select device_id, count(*) as n_rows, max(t) - min(t) + 1 - count(*) as n_gaps, cast(sum(bad) as bigint) as n_bad, cast(sum(nulls) as bigint) as n_missing, round(avg(case when nulls = 0 then 1e0 else 0e0 end), 6) as completeness from f group by 1),
 u as (select device_id, count(*) - count(distinct t) as n_duplicates from dirty group by 1), o as (select device_id, count(*) filter (where t < p) as n_out_of_order from (select device_id, t, lag(t) over (partition by device_id order by arrival_seq) as p from dirty) group by 1)
select k.*, n_duplicates, n_out_of_order, case when completeness >= 99e-2 then 'ok' else 'degraded' end as status from k join u on k.device_id = u.device_id join o on k.device_id = o.device_id""",
    ),
    "q_clean_chain": (lambda s, d: sixes(q.clean(dirty(s, d))), f"{CLEAN} select whole.device_id, t, {per_channel('round(case when gap_@ then round_even(@, 1) else @ end, 6) as @')} from whole join gaps on whole.device_id = gaps.device_id"),
    "q_clean_report": (
        lambda s, d: q.clean_report(dirty(s, d)),
        f"{MASKED}, o as (select device_id, count(*) as total_out, cast(sum({per_channel('(case when @ is null then 1 else 0 end)', ' + ')}) as bigint) as missing_filled, cast(sum(n_out) as bigint) as outliers_removed, case when {per_channel('count(@) > 0', ' and ')} then 1e0 else 0e0 end as completeness from masked group by 1), i as (select device_id, count(*) as total_in, count(*) - count(distinct t) as duplicates_removed, count(distinct t) as n from dirty group by 1), l as (select device_id, count(*) filter (where t < p) as out_of_order_fixed from (select device_id, t, lag(t) over (partition by device_id order by arrival_seq) as p from dirty) group by 1) select o.*, total_in, duplicates_removed, out_of_order_fixed, total_out - n as gaps_filled, case when completeness >= 99e-2 then 'ok' else 'degraded' end as status from o join i on o.device_id = i.device_id join l on o.device_id = l.device_id",
    ),
    "f_dew_margin": (lambda s, d: panel(s, d).select("device_id", "t", r6(f.dew_margin()).alias("margin")), f"{WITH_G} select device_id, t, round(margin, 6) as margin from dm"),
    "f_heat_rate": (lambda s, d: panel(s, d).select("device_id", "t", F.round(f.heating_rate_per_power(), 9).alias("ratio")), f"{HEAT} select device_id, t, round(ratio, 9) as ratio from h"),
    "f_pq_offset": (lambda s, d: panel(s, d).select("device_id", "t", r6(f.pq_offset()).alias("pq")), f"{WITH} select device_id, t, round((pressure - (120e0 + 22e-1 * flow_rate * flow_rate)) / (120e0 + 22e-1 * flow_rate * flow_rate), 6) + 0e0 as pq from panel"),
    "f_seasonal_threshold": (
        lambda s, d: f.seasonal_inlet_threshold(panel(s, d), 7200).select("device_id", "t", r6("threshold").alias("threshold")),
        f"{WITH} select device_id, t, round(case when count(inlet_temp) {trailing(7200)} >= 3600 then 35 + greatest(0e0, avg(inlet_temp) {trailing(7200)} - 28) end, 6) as threshold from panel",
    ),
    "f_detrended_std": (lambda s, d: f.rolling_detrended_std(panel(s, d), "pressure").select("device_id", "t", r6("osc").alias("osc")), f"{OSC} select device_id, t, round(osc, 6) as osc from osc"),
    "f_trend_eta": (
        lambda s, d: f.sampled_windows(panel(s, d).select("device_id", "t", "outlet_temp"), 600, 60).groupBy("device_id", "due").agg(f.slope("outlet_temp").alias("m"), F.max_by("outlet_temp", "t").alias("now"), F.count(F.lit(1)).alias("n"), F.max("t").alias("t")).where("n >= 60 and t = due").select("device_id", "t", F.round(f.trend_eta(F.col("now"), F.col("m"), 60.0, 600.0), 3).alias("eta")),
        f"{WITH}, x as (select *, regr_slope(outlet_temp, t) {trailing(600)} as m from panel) select device_id, t, round(case when outlet_temp >= 60 then 0e0 when m > 1e-6 and (60 - outlet_temp) / m <= 600 then (60 - outlet_temp) / m end, 3) as eta from x where t >= 59 and (t + 1) % 60 = 0",
    ),
    "f_heat_balance": (
        lambda s, d: panel(s, d).select("device_id", "t", r6(f.expected_heat_kw(F.col("flow_rate"), F.col("outlet_temp") - F.col("inlet_temp"))).alias("heat_kw"), r6(f.expected_delta_t(F.col("electric_power") * 0.25, F.col("flow_rate"))).alias("expected"), (f.heat_imbalance(F.col("electric_power") * 0.25, F.col("flow_rate"), F.col("outlet_temp") - F.col("inlet_temp")) > 0.1).alias("off")),
        f"{WITH}, e as (select *, outlet_temp - inlet_temp as dt, least(60e0, electric_power * 25e-2 / (4186e-3 * greatest(flow_rate, 3e-1))) as ex from panel) select device_id, t, round(4186e-3 * flow_rate * dt, 6) as heat_kw, round(ex, 6) as expected, abs(dt - ex) / greatest(ex, 1e0) > 1e-1 as off from e",
    ),
    "f_tail_stats": (tail_stats, TAIL),
    "f_window_stats": (
        window_stats,
        f"{WITH} select device_id, t // 600 as window_id, count(*) as n, round(avg(pressure) filter (where t % 600 >= 480), 6) as tail_mean, round(case when count(*) >= 10 then sqrt(greatest(0e0, (regr_syy(pressure, t) - regr_sxy(pressure, t) * regr_sxy(pressure, t) / regr_sxx(pressure, t)) / count(*))) end, 6) as osc, round(regr_slope(outlet_temp, t) * 60, 6) as slope_per_min from panel group by 1, 2",
    ),
    "f_last_row": (
        lambda s, d: dirty(s, d).groupBy("device_id").agg(*(r6(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("t", F.col("arrival_seq"))))).alias(c) for c in LAST)),
        f"{WITH} select device_id, " + ", ".join(f"round(arg_max({c}, t * 1000000 + arrival_seq) filter (where {c} is not null), 6) as {c}" for c in ("outlet_temp", "inlet_temp", "pressure", "flow_rate", "tank_level", "cabinet_humidity", "conductivity")) + " from dirty group by 1",
    ),
    "f_condensation": (
        lambda s, d: f.condensation(panel(s, d)).select("device_id", "t", F.bround("margin", 2).alias("margin"), "at_risk", F.round("eta", 1).alias("eta"), "predicted"),
        f"{WITH_G}, m as (select device_id, t, margin, regr_slope(margin, t) {trailing(600)} as s from dm), x as (select *, case when s < 0 and margin >= 3 then (margin - 3) / -s end as e from m where (t + 1) % 60 = 0) select device_id, t, round_even(margin, 2) as margin, margin < 3 as at_risk, round(e, 1) as eta, coalesce(e <= 600, false) as predicted from x",
    ),
    "r_row_alerts": (lambda s, d: counts(r.row_alerts(panel(s, d))), f"{ALERTS} select device_id, rule_id, count(*) as n, round(sum(round_even(v, 2)), 6) as total from row_alerts group by 1, 2"),
    "r_pressure_osc": (lambda s, d: r.pressure_oscillation(panel(s, d)).groupBy("device_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t")), f"{OSC} select device_id, 'PRESSURE_OSC' as rule_id, count(*) as n, min(t) as first_t from osc where osc > 3 group by 1"),
    "r_heat_drift": (
        lambda s, d: r.heat_drift(panel(s, d)).groupBy("device_id", "rule_id").agg(F.count(F.lit(1)).alias("n")),
        f"{HEAT}, st as (select * from h where operating_condition in ('melting', 'holding') and ratio is not null), b as (select device_id, quantile_cont(ratio, 0.5) as base from st group by 1) select st.device_id, 'HEAT_RATE_DRIFT' as rule_id, count(*) as n from st join b on st.device_id = b.device_id where abs(base) > 1e-6 and abs(ratio - base) / abs(base) > 15e-2 group by 1",
    ),
    "r_pq_offset": (lambda s, d: r.pq_alerts(panel(s, d)).groupBy("device_id", "rule_id").agg(F.count(F.lit(1)).alias("n")), f"{WITH} select device_id, 'PQ_OFFSET' as rule_id, count(*) as n from panel where abs((pressure - (120e0 + 22e-1 * flow_rate * flow_rate)) / (120e0 + 22e-1 * flow_rate * flow_rate)) > 1e-1 group by 1"),
    "r_dew_predict": (
        lambda s, d: r.dew_predict(panel(s, d)).select("device_id", "t"),
        f"{WITH_G}, m as (select device_id, t, margin, regr_slope(margin, t) {trailing(600)} as s, row_number() {W} as k from dm) select device_id, t from m join (select device_id as d, count(*) as n_rows from dm group by 1) on d = device_id where k >= 600 and (k - 600) % 60 = 0 and k < n_rows and s < 0 and margin >= 3 and (margin - 3) / -s <= 600",
    ),
    "r_sensor_map": (
        lambda s, d: r.sensors_of(r.row_alerts(panel(s, d)), values(s, SENSORS, "rule_id, sensor")).groupBy("device_id", "sensor").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules")),
        f"{ALERTS} select device_id, sensor, count(*) as n, string_agg(distinct a.rule_id, ',' order by a.rule_id) as rules from row_alerts a join {inline(SENSORS, 'rule_id, sensor')} on a.rule_id = v.rule_id group by 1, 2",
    ),
    "r_alert_rate": (
        lambda s, d: r.row_alerts(panel(s, d)).groupBy("device_id").agg(F.count(F.lit(1)).alias("n")).join(panel(s, d).groupBy("device_id").agg(F.count(F.lit(1)).alias("rows")), "device_id").select("device_id", r6(F.col("n") / F.col("rows")).alias("rate")),
        f"{ALERTS} select device_id, round(n / cast(c as double), 6) as rate from (select device_id, count(*) as n from row_alerts group by 1) join (select device_id, count(*) as c from panel group by 1) using (device_id)",
    ),
    "r_all_alerts": (
        lambda s, d: counts(r.all_alerts(panel(s, d), 7200)),
        f"""{WITH_G}, season as (select *, case when count(inlet_temp) {trailing(7200)} >= 3600 then 35 + greatest(0e0, avg(inlet_temp) {trailing(7200)} - 28) else 35 end as lim, lag(furnace_temp, 600) {W} as f0 from dm),
rows_ as ({" union all ".join(f"select device_id, '{n}' as rule_id, {v} as v from season where {c}" for n, c, v in [(n, "inlet_temp > lim" if n == "INLET_TEMP_HIGH" else c, v) for n, c, v in RULE_CASES])}),
{OSC.removeprefix(WITH).removeprefix(', ')}, h as (select *, case when electric_power >= 500 then (furnace_temp - f0) / 10e0 / electric_power end as ratio from season),
st as (select * from h where operating_condition in ('melting', 'holding') and ratio is not null), b as (select device_id, quantile_cont(ratio, 0.5) as base from st group by 1),
m as (select device_id, t, margin, regr_slope(margin, t) {trailing(600)} as s, row_number() {W} as k, count(*) over (partition by device_id) as n_rows from dm),
pq as (select device_id, (pressure - (120e0 + 22e-1 * flow_rate * flow_rate)) / (120e0 + 22e-1 * flow_rate * flow_rate) as v from panel),
every as (select * from rows_ union all select device_id, 'PRESSURE_OSC', osc from osc where osc > 3 union all select st.device_id, 'HEAT_RATE_DRIFT', ratio from st join b on st.device_id = b.device_id where abs(base) > 1e-6 and abs(ratio - base) / abs(base) > 15e-2
 union all select device_id, 'PQ_OFFSET', v from pq where abs(v) > 1e-1 union all select device_id, 'DEW_PREDICT', margin from m where k >= 600 and (k - 600) % 60 = 0 and k < n_rows and s < 0 and margin >= 3 and (margin - 3) / -s <= 600)
select device_id, rule_id, count(*) as n, round(sum(round_even(v, 2)), 6) as total from every group by 1, 2""",
    ),
    "r_latest_alerts": (
        lambda s, d: r.latest_alerts(r.row_alerts(panel(s, d))).select("device_id", F.array_join("rules", ",").alias("rules"), F.array_join("last", ",").alias("last")),
        f"{ALERTS}, k as (select *, row_number() over (partition by device_id order by t desc, rule_id) as k from row_alerts) select device_id, (select string_agg(distinct rule_id, ',' order by rule_id) from row_alerts r where r.device_id = k.device_id) as rules, string_agg(rule_id || '@' || t, ',' order by k) as last from k where k <= 10 group by 1",
    ),
    "r_sensors_or_default": (
        lambda s, d: r.sensors_or_default(r.row_alerts(panel(s, d).where("device_id % 2 = 0")), panel(s, d).select("device_id").distinct(), values(s, SENSORS, "rule_id, sensor")).select("device_id", F.array_join("sensors", ",").alias("sensors")),
        f"{ALERTS}, x as (select device_id, string_agg(distinct sensor, ',' order by sensor) as s from row_alerts a join {inline(SENSORS, 'rule_id, sensor')} on a.rule_id = v.rule_id where device_id % 2 = 0 group by 1) select p.device_id, coalesce(s, '出水温度,压力,流量,湿度') as sensors from (select distinct device_id from panel) p left join x on p.device_id = x.device_id",
    ),
}
