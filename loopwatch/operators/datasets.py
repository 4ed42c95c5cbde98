"""Building and auditing labelled sets: windows, splits, quotas, fingerprints, leakage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwatch.functions.dims import small
from loopwatch.functions.features import BLOCK
from loopwatch.functions.scans import numbered


def sliding_windows(df: DataFrame, span: int, step: int) -> DataFrame:
    """Each reading once for every window [start, start + span) that holds it."""
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - span + 1) / step)).cast("bigint")
    return df.withColumn("start", F.explode(F.sequence(first, F.floor(F.col("t") / step).cast("bigint")))).withColumn("start", F.col("start") * step)


def hash_order(seed: str, *keys: str) -> Column:
    """An order that looks random and that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def hash_ranked(df: DataFrame, by: list[str], key: str, seed: str) -> DataFrame:
    """df with k, a row's place (from 1) in its group's hash order, and n, the group's size. Rows are counted by group and four
    digits of the hash first, so a large group is ranked in many tasks."""
    marked = df.withColumns({"_h": hash_order(seed, key), "_p": F.substring(hash_order(seed, key), 1, 4)})
    counts = marked.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    up = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), F.col("_p").alias("_q"), (F.sum("_c").over(up) - F.col("_c")).alias("_o"), F.sum("_c").over(Window.partitionBy(*by)).alias("n"))
    on = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*by, "_p").orderBy("_h", key)
    out = marked.withColumn("_k", F.row_number().over(within)).join(counts, on).withColumn("k", F.col("_k") + F.col("_o"))
    return out.drop("_h", "_p", "_q", "_k", "_o", *(f"_g{i}" for i in range(len(by))))


def stratified_split(df: DataFrame, strata: list[str], key: str, share: float, seed: str = "split") -> DataFrame:
    """df with split: in every stratum the first `share` of rows in hash order is held out."""
    ranked = hash_ranked(df, strata, key, seed)
    return ranked.withColumn("split", F.when(F.col("k") <= F.ceil(F.col("n") * share), "val").otherwise("train")).drop("k", "n")


def group_holdout(df: DataFrame, group: str, share: float, seed: str = "hold") -> DataFrame:
    """df with held: whole groups, the rounded share of them in hash order, so no group is on both sides."""
    groups = hash_ranked(df.select(group).distinct().withColumn("_all", F.lit(1)), ["_all"], group, seed)
    return df.join(groups.select(group, (F.col("k") <= F.round(F.col("n") * share)).alias("held")), group)


def quota(df: DataFrame, by: str, key: str, most: int, seed: str = "quota") -> DataFrame:
    return hash_ranked(df, [by], key, seed).where(F.col("k") <= most).drop("k", "n")


def feasible_take(df: DataFrame, kind: str, key: str, shares: dict[str, float], target: int, seed: str = "take") -> DataFrame:
    """As many rows as the scarcest kind allows, the target at most, in the given shares; each kind in hash order."""
    share = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))
    have = df.groupBy(kind).agg(F.count(F.lit(1)).alias("_c"))
    every = df.sparkSession.createDataFrame(list(shares.items()), "_kind string, _share double").join(have.withColumnRenamed(kind, "_kind"), "_kind", "left")
    n = every.agg(F.floor(F.least(F.lit(target), F.min(F.coalesce("_c", F.lit(0)) / F.col("_share")))).alias("_n"))
    ranked = hash_ranked(df.where(F.col(kind).isin(list(shares))), [kind], key, seed).drop("n").join(F.broadcast(n))
    return ranked.where(F.col("k") <= F.bround(share[F.col(kind)] * F.col("_n"))).drop("k", "_n")


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def dedupe_first(df: DataFrame, mark: Column, key: str) -> DataFrame:
    """The row with the smallest key of each fingerprint, by a minimum that combines before the shuffle."""
    marked = df.withColumn("_f", mark)
    first = marked.groupBy("_f").agg(F.min(key).alias(key))
    return marked.join(first, ["_f", key], "left_semi").drop("_f")


def messages(turns: DataFrame) -> DataFrame:
    """A row for each conversation, its turns in order."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def fault_windows(df: DataFrame, ends: list[int], window: int = 1200, tail: int = 120) -> DataFrame:
    """device_id, end and label of the windows that end at fixed times, lie whole in the series and have one label in their tail."""
    placed = df.withColumn("end", F.explode(F.array(*map(F.lit, ends)))).where((F.col("t") < F.col("end")) & (F.col("t") >= F.col("end") - window))
    late = F.when(F.col("t") >= F.col("end") - tail, F.col("fault_label"))
    g = placed.groupBy("device_id", "end").agg(F.count(F.lit(1)).alias("n"), F.min(late).alias("label"), F.max(late).alias("_l"), F.count(late).alias("_k"))
    return g.where((F.col("n") == window) & (F.col("label") == F.col("_l")) & (F.col("_k") == tail)).select("device_id", "end", "label")


def labelled_windows(df: DataFrame, span: int = 1200, step: int = 600, tail: int = 120, composite: bool | None = None, keep: int | None = None) -> DataFrame:
    """device_id, start and label of whole windows whose tail has one label other than none; composite: only those with several
    faults, or only single ones; keep: so many of a label at most, evenly strided over its windows."""
    late = F.when(F.col("t") >= F.col("start") + span - tail, F.col("fault_label"))
    g = sliding_windows(df.select("device_id", "t", "fault_label"), span, step).groupBy("device_id", "start").agg(F.count(F.lit(1)).alias("n"), F.min(late).alias("label"), F.max(late).alias("_l"))
    out = g.where((F.col("n") == span) & (F.col("label") == F.col("_l")) & (F.col("label") != "none")).select("device_id", "start", "label")
    if composite is not None:
        out = out.where(F.contains("label", F.lit("+")) == composite)
    if keep is None:
        return out
    # a label's windows are counted by device and stretch of time before they are numbered
    ranked = numbered(out, ["label"], [F.col("device_id"), F.floor(F.col("start") / (64 * BLOCK))], ["start"], "_k", "_n").withColumn("_k", F.col("_k") - 1)
    return ranked.where(F.col("_k") % F.greatest(F.lit(1), F.floor(F.col("_n") / keep)) == 0).where(F.floor(F.col("_k") / F.greatest(F.lit(1), F.floor(F.col("_n") / keep))) < keep).drop("_k", "_n")


def transition_windows(df: DataFrame, span: int = 1200, step: int = 60, first: int = 600, tail: int = 120) -> DataFrame:
    """device_id and start of whole windows, every `step` from `first` on, whose tail's condition is not the same throughout."""
    # slots that no window cuts, nor its tail, are summed before they are repeated for the windows that hold them
    slot = math.gcd(span, step, tail)
    kind = F.coalesce("operating_condition", F.lit(""))
    slots = df.groupBy("device_id", (F.floor(F.col("t") / slot) * slot).alias("t")).agg(F.count(F.lit(1)).alias("_n"), F.min(kind).alias("_a"), F.max(kind).alias("_b"))
    late = lambda c: F.when(F.col("t") >= F.col("start") + span - tail, F.col(c))
    g = sliding_windows(slots, span, step).where(F.col("start") >= first).groupBy("device_id", "start").agg(F.sum("_n").alias("n"), F.min(late("_a")).alias("a"), F.max(late("_b")).alias("b"))
    return g.where((F.col("n") == span) & (F.col("a") != F.col("b"))).select("device_id", "start")


def near_limit(gold: Column, hum: Column, dh: Column, ps: Column, pq: Column, q: Column) -> Column:
    """Whether a window's statistics lie where its fault is easily taken for another. Missing ones take normal values."""
    hum, dh, ps, pq, q = (F.coalesce(c, F.lit(x)) for c, x in ((hum, 50.0), (dh, 0.0), (ps, 0.0), (pq, 0.0), (q, 8.0)))
    out = F.when(gold == "管道泄漏", hum.between(60, 70) | dh.between(2.5, 6.0)).when(gold == "水泵气蚀", ps.between(2.0, 4.5))
    return out.when(gold == "线圈结垢", pq.between(7.0, 14.0)).when(gold == "过滤器堵塞", q.between(6.0, 7.2) & (pq < 10)).otherwise(False)


def dominant(hum: Column, dh: Column, ps: Column, pq: Column, q: Column) -> Column:
    """The main cause of several, by the strength of its signs; null if all are weak."""
    hum, dh, ps, pq, q = (F.coalesce(c, F.lit(x)) for c, x in ((hum, 50.0), (dh, 0.0), (ps, 0.0), (pq, 0.0), (q, 8.0)))
    return F.when((hum > 70) | ((dh > 4) & (q < 7.8)), "管道泄漏").when(ps > 3, "水泵气蚀").when(pq >= 10, "线圈结垢").when(q < 6.4, "过滤器堵塞")


# The confidence a kind of sample is taught.
TAUGHT = {"boundary": 0.78, "composite": 0.85, "transition": 0.90, "antihall": 0.50}


def taught_confidence(kind: Column) -> Column:
    out = F.lit(0.88)
    for k, v in TAUGHT.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


# Readings that no plant can give, taken in turn, and what is wrong with them.
VIOLATIONS = [("出水温度", 5.0, "second_law"), ("湿度", 130.0, "bounds"), ("压力", -50.0, "bounds"), ("流量", 80.0, "bounds")]


def violated(df: DataFrame, seq: str) -> DataFrame:
    """df (outlet, inlet, hum, p, q) with one reading replaced by an impossible one, in turn by seq, and `claim`, its name and value."""
    k = F.pmod(F.col(seq), F.lit(len(VIOLATIONS)))
    columns = {"出水温度": "outlet", "湿度": "hum", "压力": "p", "流量": "q"}
    out = {columns[n]: F.when(k == i, F.lit(v)).otherwise(F.col(columns[n])) for i, (n, v, _) in enumerate(VIOLATIONS)}
    claim = F.element_at(F.array(*(F.lit(f"{n}={v}") for n, v, _ in VIOLATIONS)), (k + 1).cast("int"))
    return df.withColumns({**out, "claim": claim})


def grounded(claim: Column, outlet: Column, inlet: Column, hum: Column, p: Column, q: Column) -> Column:
    """Whether the claimed value is among the readings and one of them is indeed impossible."""
    said = F.regexp_extract(claim, r"=(-?\d+\.?\d*)", 1).try_cast("double")
    there = F.exists(F.array(outlet, inlet, hum, p, q), lambda x: F.abs(x - said) < 1e-6)
    beyond = ~outlet.between(0, 100) | ~inlet.between(0, 60) | ~hum.between(0, 100) | ~p.between(0, 1000) | ~q.between(0, 50) | (outlet < inlet)
    return F.coalesce(there & beyond, F.lit(False))


def outside_in(samples: DataFrame, group: str, key: str, pairs: int = 1, margin: float = 0.15) -> DataFrame:
    """Preference pairs of a group's samples (reward, correct, root_cause): the best with the worst, the next with the next, while
    their rewards are apart; where the better one is wrong too, only if both name one cause."""
    order = Window.partitionBy(group)
    up = samples.withColumns({"_lo": F.row_number().over(order.orderBy("reward", key)), "_n": F.count(F.lit(1)).over(order)})
    worst = up.where((F.col("_lo") <= pairs) & (2 * F.col("_lo") <= F.col("_n"))).select(group, F.col("_lo").alias("rank"), F.col(key).alias("rejected"), F.col("reward").alias("_r"), F.col("root_cause").alias("_c"))
    best = up.withColumn("rank", F.col("_n") - F.col("_lo") + 1).select(group, "rank", F.col(key).alias("chosen"), "reward", "correct", "root_cause")
    both = worst.join(best, [group, "rank"]).withColumn("margin", F.col("reward") - F.col("_r"))
    fine = (F.col("margin") >= margin) & (F.col("correct") | F.col("root_cause").eqNullSafe(F.col("_c")))
    return both.where(fine).select(group, "rank", "chosen", "rejected", "margin")


def mixed(real: DataFrame, simulated: DataFrame, key: str, ratio: int = 3, least: int = 0, seed: str = "mix") -> DataFrame:
    """All real rows, and at least `ratio` times as many simulated ones in hash order, or all there are. origin tells them apart."""
    n = real.agg(F.greatest(F.count(F.lit(1)) * ratio, F.lit(least)).alias("_want"))
    sim = hash_ranked(simulated.withColumn("_all", F.lit(1)), ["_all"], key, seed).drop("n", "_all").join(F.broadcast(n)).where(F.col("k") <= F.col("_want")).drop("k", "_want")
    return joined_sets(real.withColumn("origin", F.lit("real")), sim.withColumn("origin", F.lit("simulated")))


def joined_sets(*sets: DataFrame) -> DataFrame:
    """One set of several; a column that one lacks is null there."""
    out = sets[0]
    for x in sets[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def overlaps(sets: dict[str, DataFrame], pairs: list[tuple[str, str]], key: str) -> DataFrame:
    """check and n: how many keys each two sets share; a clean split has none."""
    held = joined_sets(*(df.select(key, F.lit(name).alias("_set")).distinct() for name, df in sets.items()))
    each = held.groupBy(key).agg(F.collect_set("_set").alias("_in"))  # as many as there are sets
    hit = each.agg(*(F.count_if(F.array_contains("_in", a) & F.array_contains("_in", b)).alias(f"{a}_vs_{b}") for a, b in pairs))
    return hit.select(F.explode(F.array(*(F.struct(F.lit(f"{a}_vs_{b}").alias("check"), F.col(f"{a}_vs_{b}").alias("n")) for a, b in pairs))).alias("x")).select("x.*")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of a that b lacks, of b that a lacks, and whether both hold the same."""
    both = joined_sets(a.select(key, F.lit(1).alias("_a")), b.select(key, F.lit(1).alias("_b"))).groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"), (F.count_if(F.col("_b").isNull() | F.col("_a").isNull()) == 0).alias("equal"))


def failures(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key and failed: a row for each check of a row that does not hold; one that can't be told does not hold."""
    out = F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()))
    return df.select(key, F.explode(F.filter(out, lambda x: x.isNotNull())).alias("failed"))


def support(actual: DataFrame, other: DataFrame, thresholds: DataFrame) -> DataFrame:
    """How far a case's channels (case_id, fault, channel, mean, deviation) lie from the same case without the fault, in units of each
    channel's threshold; the deviation counts where the fault and channel have a limit for it. Hidden channels are null and don't
    count; without any the support is 0."""
    o = other.select("case_id", "fault", "channel", F.col("mean").alias("_m"), F.col("deviation").alias("_d"))
    both = actual.join(o, ["case_id", "fault", "channel"]).join(small(thresholds), ["fault", "channel"])
    score = F.greatest(F.abs(F.col("mean") - F.col("_m")) / F.col("by_mean"), F.abs(F.col("deviation") - F.col("_d")) / F.col("by_deviation"))
    return both.groupBy("case_id", "fault").agg(F.coalesce(F.max(score), F.lit(0.0)).alias("support"))
