"""Mixing sources to target weights: a temperature on token shares, realised as budgeted block permutations.

Shares p of tokens become weights proportional to p ** t. The temperature t in [0, 1] is bisected so that the weights reach
a target entropy (a fraction of the greatest, that of equal weights) as nearly as a limit on repetition allows: no source is
read more than `most_repeats` times. Entropy and repetition both fall as t rises, so both limits are one bisection each.

A source's budget is its weight times the token budget. Its rows lie in blocks by a hash of doc_id. Each pass over the source
takes its blocks in another order; passes are whole while the budget lasts, the last takes whole blocks in its order and
the rows of one more block in theirs, up to and with the row that reaches the budget. Only that one block is ever sorted.

A null text has no tokens; rows without tokens cost nothing and appear in whole passes only; a source of such rows has one. A null source is a source of its own. Repeated rows share a block and are each taken. Ties of
order break by doc_id and then by row contents. An empty table gives an empty result. Columns named like the added ones
(n_tokens, weight, copies, place) are replaced; others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopwatch.llm import common

ENTROPY, MOST_REPEATS, BLOCKS, STEPS, PARTS = 0.95, 4.0, 1024, 5, 16


def _entropies(shares: DataFrame, at: list[float]) -> list[tuple[float, float]]:
    """For each temperature the entropy of the weights and the largest ratio of a weight to a share, from one small aggregate."""
    columns = []
    for i, t in enumerate(at):
        columns += [F.sum(F.pow("p", F.lit(t))).alias(f"z{i}"), F.sum(F.pow("p", F.lit(t)) * F.log("p")).alias(f"l{i}"), F.max(F.pow("p", F.lit(t - 1))).alias(f"m{i}")]
    row = shares.agg(*columns).first()
    return [(math.log(row[f"z{i}"]) - t * row[f"l{i}"] / row[f"z{i}"], row[f"m{i}"] / row[f"z{i}"]) for i, t in enumerate(at)]


def temperature(shares: DataFrame, budget_ratio: float, entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS) -> float:
    """The t in [0, 1] for sources with token shares p (all above 0). Each job narrows the bracket to one part of PARTS."""
    n = shares.count()
    if n < 2:
        return 1.0
    target = entropy * math.log(n)

    def search(good) -> float:
        """The least t that is good; good() must hold from some t on, and is taken to hold at 1."""
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            at = [lo + (hi - lo) * i / PARTS for i in range(PARTS)]
            ok = [good(x) for x in _entropies(shares, at)]
            first = ok.index(True) if True in ok else PARTS
            if first == 0:
                return at[0]
            lo, hi = at[first - 1], (at[first] if first < PARTS else hi)
        return hi

    by_entropy = search(lambda x: x[0] <= target)
    by_repeats = search(lambda x: x[1] * budget_ratio <= most_repeats)
    return max(by_entropy, by_repeats)


def plan(spark: SparkSession, docs: DataFrame, budget_ratio: float = 1.0, entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS, seed: int = 17, blocks: int = BLOCKS, scratch: common.Scratch | None = None) -> DataFrame:
    """docs with n_tokens, weight (of the source), copies (how often the row is read, 0 or more) and place (its block and the number
    of whole passes, from which `realise` tells the order)."""
    scratch = scratch or common.Scratch(spark)
    docs = docs.drop("n_tokens", "weight", "copies", "place")
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)).cast("int")
    # counted once and kept: the decisions below read only these few columns
    # the tables by source and block have at most `blocks` rows for each source: a few tasks write them
    few = 8
    small = scratch.save(docs.select("doc_id", "source", F.xxhash64("text").alias("h"), tokens.alias("n_tokens"), block.alias("block")), "tokens")
    sums = scratch.save(small.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")).coalesce(few), "blocks")
    sources = sums.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = scratch.save(sources.select("source", "tokens", (F.col("tokens") / F.lit(max(total, 1))).alias("p")).coalesce(few), "shares")
    t = temperature(shares.where("p > 0"), budget_ratio, entropy, most_repeats)
    z = shares.where("p > 0").agg(F.sum(F.pow("p", F.lit(t)))).first()[0] or 1.0
    weights = shares.withColumn("weight", F.when(F.col("p") > 0, F.pow("p", F.lit(t)) / z).otherwise(0.0))
    weights = weights.withColumn("budget", F.floor(F.col("weight") * budget_ratio * total).cast("long"))
    weights = weights.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long"))
    weights = scratch.save(weights.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0)).coalesce(few), "weights")
    # a source has `blocks` blocks at most, so its window stays small whatever the source holds
    same = F.col("source").eqNullSafe(F.col("w_source"))
    w = weights.withColumnRenamed("source", "w_source").drop("tokens")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "passes", "block"), "block")
    laid = sums.join(w, same).drop("w_source").withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.select("source", "block", "weight", "passes", "rest", ((F.col("upto") <= F.col("rest")) & (F.col("rest") > 0)).alias("whole"), (F.col("rest") - (F.col("upto") - F.col("tokens"))).alias("left"))
    laid = scratch.save(laid.withColumn("part", ~F.col("whole") & (F.col("left") > 0)).coalesce(few), "laid")
    # the one block of each source that is taken in part
    b = laid.where("part").select(F.col("source").alias("w_source"), F.col("block").alias("w_block"), "left", "passes")
    cut = small.join(b, F.col("source").eqNullSafe(F.col("w_source")) & (F.col("block") == F.col("w_block")))
    inside = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "passes", "doc_id"), "doc_id", "h")
    cut = cut.withColumn("before", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    taken = cut.where("before < left").groupBy("source", "doc_id", "h").agg(F.count(F.lit(1)).alias("extra"))
    # the row travels whole, so no name of it can clash
    out = docs.select(F.struct(*docs.columns).alias("row"), "source", "doc_id", tokens.alias("n"), block.alias("b"), F.xxhash64("text").alias("h"))
    l = laid.select(F.col("source").alias("l_source"), F.col("block").alias("l_block"), "weight", "passes", F.col("whole").cast("long").alias("more"))
    out = out.join(l, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("b") == F.col("l_block")))
    x = taken.select(F.col("source").alias("x_source"), F.col("doc_id").alias("x_doc"), F.col("h").alias("x_h"), F.lit(1).cast("long").alias("extra"))
    out = out.join(x, F.col("source").eqNullSafe(F.col("x_source")) & F.col("doc_id").eqNullSafe(F.col("x_doc")) & F.col("h").eqNullSafe(F.col("x_h")), "left")
    copies = F.col("passes") + F.when(F.col("n") > 0, F.col("more") + F.coalesce("extra", F.lit(0))).otherwise(0)
    place = F.struct(F.lit(seed).alias("seed"), F.col("b").alias("block"), F.col("passes").cast("long").alias("passes"))
    return out.select("row.*", F.col("n").alias("n_tokens"), "weight", copies.cast("long").alias("copies"), place.alias("place"))


def realise(planned: DataFrame, columns: list[str], ordered: bool = False) -> DataFrame:
    """The rows of the mix: each as often as it is read. ordered: with `order`, the pass, and what the pass's permutation of blocks
    and of rows within a block puts this reading at; a reader that sorts a shard of a source by it reads block after block."""
    rows = planned.where("copies > 0").select(F.struct(*columns).alias("row"), "doc_id", "place", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("k"))
    if not ordered:
        return rows.select("row.*")
    n = F.least(F.col("k").cast("long"), F.col("place.passes"))
    key = lambda c: F.xxhash64(F.col("place.seed"), n, c)
    return rows.select("row.*", F.struct(n.alias("pass"), key(F.col("place.block")).alias("block"), key(F.col("doc_id")).alias("row")).alias("order"))
