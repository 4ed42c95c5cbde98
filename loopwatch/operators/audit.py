"""Audits of labelled window samples: what a row must satisfy, and what must hold over a whole set of splits.

A sample is a row of SAMPLE. Its statistics are arrays of (channel, mean, deviation, slope), seen in the window and in an early
reference of the same run; support tells for each fault how far the window lies from the same window without that fault.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwatch.functions.features import detrended_std, slope
from loopwatch.operators.datasets import failures, overlaps

STATS = "array<struct<channel: string, mean: double, deviation: double, slope: double>>"
SAMPLE = (
    f"sample_id long, split string, version string, roles array<string>, prompt string, observed {STATS}, reference {STATS}, hidden array<string>, unavailable string, support map<string, double>, "
    "gold_causes array<string>, gold string, gold_more boolean, root_causes array<string>, root_cause string, more boolean, confidence double, evidence array<string>, sop array<string>, "
    "input string, seed long, episode_id string, equipment_id string, window_end long"
)
VERSION = "hard_faults_v1"
ROLES = ["system", "user", "assistant"]
# What a sample is called that has no cause, names that must not be told, and the ends of an episode's windows.
UNCERTAIN, NORMAL = "证据不足，需补充数据", "未见明显故障"
SECRET = ["counterfactual_support", "injected_faults", "simulation_config", "episode_id"]
WINDOW_ENDS = [1200, 1800]
# Kinds of samples that a regression set keeps.
HARD_KINDS = ["boundary", "transition", "antihall", "composite"]
#: Readings of a window's end that its mean is of.
TAIL = 120


def window_statistics(df: DataFrame, channels: list[str], span: int = 600, tail: int = TAIL, places: int = 3, held: bool = False) -> DataFrame:
    """device_id, window_id, channel, mean (of the last `tail` seconds), deviation (what a line leaves, population) and slope (a minute),
    all to `places` places, of every channel of each window of `span` seconds. The tail ends with the window or, if `held`, with its
    last reading, so that a window that broke off has a mean too."""
    w = df.withColumn("window_id", F.floor(F.col("t") / span).cast("long"))
    late = F.col("t") % span >= span - tail
    if held:
        w = w.withColumn("_end", F.max("t").over(Window.partitionBy("device_id", "window_id")))
        late = F.col("t") > F.col("_end") - tail
    each = w.groupBy("device_id", "window_id").agg(*(x for c in channels for x in (F.avg(F.when(late, F.col(c))).alias(f"m_{c}"), detrended_std(c).alias(f"d_{c}"), slope(c).alias(f"s_{c}"))))
    cut = lambda x: F.round(x, places) + F.lit(0.0)
    rows = F.array(*(F.struct(F.lit(c).alias("channel"), cut(F.col(f"m_{c}")).alias("mean"), cut(F.col(f"d_{c}")).alias("deviation"), cut(F.col(f"s_{c}") * 60).alias("slope")) for c in channels))
    return each.select("device_id", "window_id", F.explode(rows).alias("x")).select("device_id", "window_id", "x.*")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def evidence_lines(observed: Column, hidden: Column, unavailable: Column) -> Column:
    """All that a sample's evidence may say: each channel's statistics, and which channels are missing."""
    text = lambda x: x.cast("string")
    lines = F.transform(observed, lambda x: F.concat(x["channel"], F.lit("均值 "), text(x["mean"]), F.lit("，去趋势标准差 "), text(x["deviation"]), F.lit("，每分钟变化 "), text(x["slope"])))
    return F.when(F.size(hidden) > 0, F.concat(lines, F.array(F.concat(F.lit("缺失通道："), unavailable)))).otherwise(lines)


def sample_checks(names: dict[str, str], split_names: tuple[str, ...] = ("train", "val", "eval")) -> dict[str, Column]:
    """What a sample must satisfy, by name. names: the label of each fault of the support."""
    c = F.col
    label = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    seen, before = (F.array_sort(F.transform(x, lambda s: s["channel"])) for x in ("observed", "reference"))
    numbers = F.flatten(F.transform(F.concat("observed", "reference"), lambda s: F.array(s["mean"], s["deviation"], s["slope"])))
    strengths = F.map_values("support")
    supported = F.array_sort(F.transform(F.map_keys(F.map_filter("support", lambda k, v: v >= 1)), lambda k: F.element_at(label, k)))
    expected = F.when(F.size(supported) > 0, F.array_join(supported, " + ")).when(c("more"), UNCERTAIN).otherwise(NORMAL)
    allowed = evidence_lines(c("observed"), c("hidden"), c("unavailable"))
    return {
        "roles": c("roles") == F.array(*map(F.lit, ROLES)),
        "split": c("split").isin(*split_names),
        "version": c("version") == VERSION,
        "reference_channels": F.array_distinct(seen) == F.array_distinct(before),
        "hidden_exposed": ~F.arrays_overlap(seen, "hidden"),
        "finite": F.forall(numbers, _finite),
        "deviation": F.forall(F.concat("observed", "reference"), lambda s: s["deviation"] >= 0),
        "support": F.forall(strengths, lambda v: _finite(v) & (v >= 0)),
        "causes": (c("root_causes") == c("gold_causes")) & (c("gold_causes") == supported),
        "flag": c("more").isNotNull(),
        "flag_match": c("more") == c("gold_more"),
        "text": (c("root_cause") == c("gold")) & (c("gold") == expected),
        "confidence": _finite(c("confidence")) & c("confidence").between(0, 1),
        "evidence": (F.size("evidence") > 0) & (F.size(F.array_except("evidence", allowed)) == 0),
        "sop": (F.size("sop") > 0) & F.forall("sop", lambda s: F.trim(s) != ""),
        "secret": ~reduce(lambda a, b: a | b, (F.contains("prompt", F.lit(x)) for x in SECRET)),
    }


def audit_rows(samples: DataFrame, names: dict[str, str]) -> DataFrame:
    """sample_id and failed: each check that a sample does not pass."""
    return failures(samples, "sample_id", sample_checks(names))


def audit_sets(samples: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """check, split and n: inputs that a split holds twice, episodes of it whose windows aren't the two that they must be, and
    samples whose input or seed an earlier set (input, seed) has. Only what fails has a row."""
    none = F.lit(1)
    twice = samples.groupBy("split", "input").agg(F.count(none).alias("c")).where("c > 1").groupBy("split").agg(F.sum(F.col("c") - 1).alias("n")).withColumn("check", F.lit("duplicate_input"))
    ends = samples.groupBy("split", "episode_id").agg(F.count(none).alias("c"), F.min("window_end").alias("lo"), F.max("window_end").alias("hi"))
    broken = ends.where(~((F.col("c") == 2) & (F.col("lo") == WINDOW_ENDS[0]) & (F.col("hi") == WINDOW_ENDS[1]))).groupBy("split").agg(F.count(none).alias("n")).withColumn("check", F.lit("episode_windows"))
    found = [twice, broken]
    if history is not None:
        for key in ("input", "seed"):
            seen = samples.join(history.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
            found.append(seen.groupBy("split").agg(F.count(none).alias("n")).withColumn("check", F.lit(f"historical_{key}")))
    return reduce(DataFrame.unionByName, found).select("check", "split", "n")


def identity_overlaps(samples: DataFrame, keys: tuple[str, ...] = ("input", "seed", "episode_id", "equipment_id"), splits: tuple[str, ...] = ("train", "val", "eval")) -> DataFrame:
    """identity, check and n: how many values of each identity two splits share; clean splits share none."""
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1 :]]
    own = {s: samples.where(F.col("split") == s) for s in splits}
    return reduce(DataFrame.unionByName, (overlaps(own, pairs, k).withColumn("identity", F.lit(k)) for k in keys)).select("identity", "check", "n")


def set_counts(samples: DataFrame, injected: str, shifted: str) -> DataFrame:
    """A row for each split: samples, episodes, those with several injected faults or target causes, with a part of the injected faults
    as targets, with hidden channels, without any fault, and with a shifted envelope. injected, shifted: columns."""
    n_in, n_out = F.size(injected), F.size("gold_causes")
    return samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("episode_id").alias("episodes"), F.count_if(n_in > 1).alias("injected_compound"), F.count_if(n_out > 1).alias("multi_cause"),
        F.count_if((n_in > n_out) & (n_out > 0)).alias("partial_compound"), F.count_if(F.size("hidden") > 0).alias("hidden"), F.count_if(n_in == 0).alias("normal"), F.count_if(shifted).alias("shifted"),
    )


def leak_checks(prompts: DataFrame, stress: DataFrame, pool: DataFrame, tuned: DataFrame) -> DataFrame:
    """check and n, all of which must be 0: inputs that prompts or stress cases share with the tuning set's eval part, with each other
    and with its train and val parts, and seeds that pool, stress and tuning sets share. All have input and seed, tuned split too."""
    parts = {"prompts": prompts, "stress": stress, "sft_eval": tuned.where("split = 'eval'"), "sft_train_val": tuned.where("split in ('train', 'val')")}
    by_input = overlaps(parts, [("prompts", "sft_eval"), ("stress", "sft_eval"), ("stress", "prompts"), ("prompts", "sft_train_val")], "input")
    seeds = {"pool_seeds": pool, "stress_seeds": stress, "sft_seeds": tuned}
    return by_input.unionByName(overlaps(seeds, [("pool_seeds", "sft_seeds"), ("stress_seeds", "sft_seeds"), ("stress_seeds", "pool_seeds")], "seed"))


def regression_cases(feedback: DataFrame, evaluated: DataFrame) -> DataFrame:
    """case_id, kind, gold, source, prompt and answer: usable feedback (order_id, prompt, output, actual, is_true_fault), and evaluation
    samples (doc_id, kind, gold, prompt, answer) of the hard kinds."""
    there = lambda x: F.coalesce(F.col(x), F.lit("")) != ""
    real = feedback.where(F.col("is_true_fault") & there("prompt") & there("actual"))
    real = real.select(F.col("order_id").alias("case_id"), F.lit("feedback").alias("kind"), F.col("actual").alias("gold"), F.lit("feedback").alias("source"), "prompt", F.coalesce("output", F.lit("")).alias("answer"))
    seeds = evaluated.where(F.col("kind").isin(*HARD_KINDS)).select(F.col("doc_id").alias("case_id"), "kind", "gold", F.lit("curated_eval").alias("source"), "prompt", "answer")
    return real.unionByName(seeds)


def split_pool(windows: DataFrame, near: Column, most: int | None = None, seed_order: str = "case_id") -> DataFrame:
    """windows of faults (fault, ...) with kind: boundary where near holds, else clear; of each fault the first `most` by `seed_order`."""
    out = windows
    if most is not None:
        w = Window.partitionBy("fault").orderBy(seed_order)
        out = out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
    return out.withColumn("kind", F.when(F.coalesce(near, F.lit(False)), "boundary").otherwise("clear"))


def confusion_table(scored: DataFrame, labels: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """A row for each gold label and a column for the count of each predicted one; other predictions count as other."""
    named = F.when(F.col(pred).isin(*labels), F.col(pred)).otherwise("other")
    return scored.groupBy(gold).agg(*(F.count_if(named == x).alias(f"pred_{x}") for x in [*labels, "other"]))
