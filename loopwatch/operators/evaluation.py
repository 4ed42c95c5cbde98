"""Scores of answers and what sums them up: rewards, evaluation tables with their gates, rollout groups, runs and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwatch.operators import text as t
from loopwatch.operators.graph import contradicted
from loopwatch.functions.scans import null_safe
from loopwatch.operators.metrics import nearest_rank, set_f1

# Weights of a composite reward's parts; kinds of cases with a fault and of those near a limit; answers without a fault.
WEIGHTS = {"gold": 0.50, "calib": 0.15, "hallu": 0.15, "faith": 0.10, "json": 0.05, "sop": 0.05}
FAULT_KINDS, CONFUSION_KINDS, HARD_KINDS = ["clear", "boundary", "composite", "misleading"], ["boundary"], ["boundary", "transition", "antihall", "composite"]
NO_FAULT, DATA_BAD = "无故障（工况切换正常波动）", "数据质量异常（建议人工核查）"
MARGIN, GATES = 0.15, {"json": 0.99, "faith": 0.98, "hallu": 1.0}


def sop_score(cause: Column, sop: Column, faults: list[str], actions: dict[str, list[str]]) -> Column:
    """Share of steps that name an action of the cause's fault; 1 for any steps where the graph has no say, 0 without steps."""
    allowed = F.expr("cast(array() as array<string>)")
    for fault, names in actions.items():
        allowed = F.when(cause == fault, F.array(*map(F.lit, names))).otherwise(allowed)
    hit = F.filter(sop, lambda s: (F.trim(s) != "") & F.exists(allowed, lambda a: F.contains(s, a) | F.contains(a, s)))
    free = ~cause.isin(faults) | (F.size(allowed) == 0)
    return F.when(F.size(sop) == 0, 0.0).when(free, 1.0).otherwise(F.size(hit) / F.size(sop))


def unsupported_evidence(cause: Column, evidence: Column, indicates: list[tuple[str, str]], sensors: list[str]) -> Column:
    """Whether the evidence names a sensor that the graph knows but not as a sign of the cause. Causes outside it are not judged."""
    pairs = F.array(*(F.lit(f"{f}|{s}") for f, s in indicates))
    faults = sorted({f for f, _ in indicates})
    off = F.exists(evidence, lambda e: e.isin(sensors) & ~F.array_contains(pairs, F.concat(cause, F.lit("|"), e)))
    return cause.isin(faults) & off


def reward(answer: Column, prompt: Column, gold: Column, faults: list[str], actions: dict[str, list[str]], indicates: list[tuple[str, str]], sensors: list[str]) -> Column:
    """The composite reward and its parts; all are 0 for an answer that can't be read or whose confidence is not in [0, 1]."""
    conf = answer["confidence"]
    ok = answer.isNotNull() & ~F.isnan(conf) & conf.between(0, 1)
    right = F.coalesce(answer["root_cause"] == gold, F.lit(False)).cast("double")
    parts = {
        "gold": right,
        "calib": 1.0 - F.pow(conf - right, F.lit(2.0)),
        "hallu": (~contradicted(answer["evidence"]) & ~unsupported_evidence(answer["root_cause"], answer["evidence"], indicates, sensors)).cast("double"),
        "faith": t.faithful(answer["evidence"], t.numbers_in(prompt)).cast("double"),
        "json": F.lit(1.0),
        "sop": sop_score(answer["root_cause"], answer["sop"], faults, actions),
    }
    gated = {k: F.when(F.coalesce(ok, F.lit(False)), v).otherwise(0.0) for k, v in parts.items()}
    total = sum((F.lit(w) * gated[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.struct(total.alias("total"), *(v.alias(k) for k, v in gated.items()))


def hard_reward(valid: Column, gold: Column, pred: Column, same_flag: Column, traced: Column, sop: Column) -> Column:
    """The reward of a set of causes: exact set, set F1, uncertainty, evidence, steps, and a base; 0 for an invalid answer."""
    exact = (F.array_sort(gold) == F.array_sort(pred)).cast("double")
    total = 0.4 * exact + 0.2 * set_f1(gold, pred) + 0.2 * same_flag.cast("double") + 0.1 * traced.cast("double") + 0.05 * sop + 0.05
    return F.when(valid, total).otherwise(0.0)


def _rate(within: Column, hit: Column) -> Column:
    """Share of rows within that hit; 0 where there are none."""
    return F.coalesce(F.avg(F.when(within, hit.cast("double"))), F.lit(0.0))


def confidence_gap(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean confidence of right and of wrong answers, their difference, and the share of wrong ones at 0.8 or more. Null where
    there are no such answers."""
    right, wrong = F.col("correct"), ~F.col("correct")
    a, b = F.avg(F.when(right, F.col("conf"))), F.avg(F.when(wrong, F.col("conf")))
    return df.groupBy(*by).agg(a.alias("mean_correct"), b.alias("mean_wrong"), (a - b).alias("gap"), F.avg(F.when(wrong & F.col("conf").isNotNull(), (F.col("conf") >= 0.8).cast("double"))).alias("wrong_high"))


def summary(df: DataFrame) -> DataFrame:
    """The evaluation's one row: accuracy by subset, JSON, evidence and check rates, false positives, refusals, and hard gates.

    df: kind, gold, rc, rc_raw, rc_arb, json_ok, faith_ok, hallu_ok, error."""
    every, ok = F.lit(True), F.col("json_ok")
    is_ = lambda c: F.coalesce(F.col(c) == F.col("gold"), F.lit(False))
    fault, confused = F.col("kind").isin(FAULT_KINDS), F.col("kind").isin(CONFUSION_KINDS)
    pool, trans, anti = ok & (F.col("kind") != "antihall"), F.col("kind") == "transition", F.col("kind") == "antihall"
    other = lambda name: ~F.coalesce(F.col("rc") == name, F.lit(False))
    out = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fault).alias("n_fault"), F.count_if(pool).alias("n_pool"), F.count_if(trans).alias("n_transition"), F.count_if(anti).alias("n_antihall"), F.count("error").alias("n_errors"),
        _rate(every, ok).alias("json_rate"), _rate(every, is_("rc")).alias("acc_overall"), _rate(fault, is_("rc")).alias("acc_fault"), _rate(fault, is_("rc_raw")).alias("acc_fault_raw"), _rate(fault, is_("rc_arb")).alias("acc_fault_arb"),
        _rate(confused, is_("rc")).alias("acc_confusion"), _rate(pool, F.col("faith_ok")).alias("faith_rate"), _rate(pool, F.col("hallu_ok")).alias("hallu_rate"), _rate(trans, other(NO_FAULT)).alias("false_positive"), _rate(anti, ~other(DATA_BAD)).alias("refuse_rate"),
    )
    return out.withColumns({f"gate_{k}": F.col(f"{k}_rate") >= v for k, v in GATES.items()})


def latency(df: DataFrame, value: str = "latency") -> DataFrame:
    """One row: the nearest-rank median and 95th percentile, mean and maximum of read answers."""
    ok = df.where("json_ok").withColumn("_g", F.lit(1))
    out = ok.agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    for name, share in (("p50", 0.5), ("p95", 0.95)):
        # no answers have no rank: the row stays, with nulls
        out = out.join(F.broadcast(nearest_rank(ok, ["_g"], value, share).select(F.col("value").alias(name))), F.lit(True), "left")
    return out


def describe(df: DataFrame, by: str, value: str) -> DataFrame:
    out = df.groupBy(by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    for name, share in (("p50", 0.5), ("p95", 0.95)):
        out = null_safe(out, nearest_rank(df, [by], value, share).withColumnRenamed("value", name), [by], "left")
    return out


def uncertainty(df: DataFrame) -> DataFrame:
    """One row over answers (gold_more, pred_more, pred, injected, correct, conf): precision and recall of asking for more data, how
    often a normal case gets a cause, joint accuracy, and the Brier score. Null where nothing can be counted."""
    asked = F.coalesce(F.col("pred_more"), F.lit(False))
    tp, fp, fn = F.count_if(F.col("gold_more") & asked), F.count_if(~F.col("gold_more") & asked), F.count_if(F.col("gold_more") & ~asked)
    normal = F.col("injected") == 0
    right = F.col("correct").cast("double")
    return df.agg(
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.avg(F.when(normal, (F.size("pred") > 0).cast("double"))).alias("normal_false_positive"),
        F.count_if(normal).alias("n_normal"), F.avg(right).alias("joint_accuracy"), F.avg(F.pow(F.col("conf") - right, F.lit(2.0))).alias("brier"), F.count("conf").alias("n_calibrated"),
    )


def macro_f1(classes: DataFrame) -> DataFrame:
    """The mean F1 of the classes that have one."""
    return classes.agg(F.avg("f1").alias("macro_f1"), F.count("f1").alias("n_classes"))


def rollout_groups(samples: DataFrame, by: list[str]) -> DataFrame:
    """Per prompt its samples' number, rewards and span, and how many were right; one sample has no deviation."""
    r, n = F.col("reward"), F.count(F.lit(1))
    return samples.groupBy(*by).agg(n.alias("n"), F.avg(r).alias("mean"), F.when(n > 1, F.stddev_pop(r)).otherwise(0.0).alias("std"), F.min(r).alias("min"), F.max(r).alias("max"), (F.max(r) - F.min(r)).alias("span"), F.count_if("correct").alias("n_correct"), F.count_if("json_ok").alias("n_json_ok"))


def rollout_summary(groups: DataFrame, by: list[str]) -> DataFrame:
    return groups.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("span").alias("span_mean"), F.count_if(F.col("span") >= MARGIN).alias("n_wide"), F.count_if(F.col("span") == 0).alias("n_flat"), F.avg(F.col("n_correct") / F.greatest("n", F.lit(1))).alias("correct_rate"))


def across_runs(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over runs; nulls don't count."""
    return df.groupBy(by).agg(*(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))))


def paired(base: DataFrame, other: DataFrame, key: list[str], flags: list[str], output: str) -> DataFrame:
    """One row: of cases that both methods answered, how many answers are equal, and for each flag how many became right or wrong."""
    b = other.select(*key, *(F.col(f).alias(f"_{f}") for f in [*flags, output]))
    both = base.join(b, key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(output).eqNullSafe(F.col(f"_{output}"))).alias("identical"), *(x for f in flags for x in (F.count_if(~F.col(f) & F.col(f"_{f}")).alias(f"{f}_improved"), F.count_if(F.col(f) & ~F.col(f"_{f}")).alias(f"{f}_regressed"))))


def misaligned(runs: DataFrame, dataset: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows that only one side has, and rows whose columns differ; null equals null."""
    d = dataset.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_there"))
    both = runs.withColumn("_here", F.lit(True)).join(d, key, "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = F.col("_here").isNotNull() & F.col("_there").isNotNull()
    return both.agg(F.count_if(F.col("_there").isNull()).alias("n_extra"), F.count_if(F.col("_here").isNull()).alias("n_lacking"), F.count_if(met & ~same).alias("n_differ"))


def regressions(results: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases that passed before and don't now, and cases that the baseline doesn't hold."""
    was = baseline.select("case_id", F.col("passed").alias("_was"))
    return results.join(was, "case_id").where("_was and not passed").drop("_was"), results.join(was, "case_id", "left_anti")


def cause_errors(df: DataFrame) -> DataFrame:
    """How often each cause is missed, and how often it is named without being there."""
    missed = df.select(F.explode(F.array_except("gold", "pred")).alias("cause"), F.lit("missed").alias("error"))
    extra = df.select(F.explode(F.array_except("pred", "gold")).alias("cause"), F.lit("extra").alias("error"))
    return missed.unionByName(extra).groupBy("cause", "error").agg(F.count(F.lit(1)).alias("n"))
