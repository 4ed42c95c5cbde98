"""Metrics over scored rows: accuracy, calibration, class F1, error taxonomy, percentiles, bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwatch.functions.scans import null_safe


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float, bins: int = 1024) -> DataFrame:
    """The value at the rounded rank (half to even) of each group, null groups too: no interpolation and no sketch. Numeric values.

    Equal values are counted before the exchange. A group's span of values is cut into bins; their counts tell which bin holds the
    rank, and only its distinct values meet in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    spans = counts.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("_n"))
    share_of = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor(share_of * bins))).otherwise(0)
    binned = null_safe(counts, spans, by).withColumns({"_b": at, "_k": F.bround(F.lit(share) * (F.col("_n") - 1))})
    whole = binned.groupBy(*by, "_b").agg(F.sum("_c").alias("_c"), F.first("_k").alias("_k"))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    held = whole.withColumn("_before", before).where((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c"))).select(*by, "_b", "_before")
    inside = null_safe(binned, held, [*by, "_b"])
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    ranked = inside.withColumn("_upto", upto)
    return ranked.where((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c"))).select(*by, F.col(value).alias("value"))


def calibration(df: DataFrame, by: list[str], conf: str = "conf", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over confidences in [0, 1]."""
    ok = df.where(F.col(conf).between(0, 1)).withColumns({"_c": F.col(correct).cast("double"), "_b": F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1))})
    binned = ok.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("n"), F.sum("_c").alias("hits"), F.sum(conf).alias("conf"), F.sum(F.pow(F.col(conf) - F.col("_c"), 2)).alias("sq"))
    return binned.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("hits") - F.col("conf"))) / F.sum("n")).alias("ece"))


def class_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """tp, fp, fn and f1 of each class of two label sets; null where a class never occurs."""
    g = df.select(F.explode(gold).alias("label"), F.array_contains(pred, F.col("label")).alias("both"), F.lit(1).alias("side"))
    p = df.select(F.explode(pred).alias("label"), F.array_contains(gold, F.col("label")).alias("both"), F.lit(0).alias("side"))
    n = lambda c: F.count_if(c)
    out = g.unionByName(p).groupBy("label").agg(n(F.col("both") & (F.col("side") == 1)).alias("tp"), n(~F.col("both") & (F.col("side") == 0)).alias("fp"), n(~F.col("both") & (F.col("side") == 1)).alias("fn"))
    return out.withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")))


def spearman(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """by and rho: the correlation of ranks in each group, equal values sharing their mean rank; rows with a null don't count."""

    # a rank depends on values alone, so rows are counted by pairs of values first; ranks are doubled and counted from their mean,
    # which is known, so they are whole numbers
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by, F.col(a).alias("_x"), F.col(b).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    every = F.sum("_n").over(Window.partitionBy(by))

    def rank(c: str) -> Column:
        upto = F.sum("_n").over(Window.partitionBy(by).orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return (2 * upto - F.sum("_n").over(Window.partitionBy(by, c)) - every).cast("double")

    ranked = cells.select(by, "_n", rank("_x").alias("_a"), rank("_y").alias("_b"))
    total = lambda x, y: F.sum(F.col("_n") * F.col(x) * F.col(y))
    return ranked.groupBy(by).agg(F.try_divide(total("_a", "_b"), F.sqrt(total("_a", "_a")) * F.sqrt(total("_b", "_b"))).alias("rho"))


def set_f1(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def error_class(valid: Column, sets_match: Column, flag_match: Column) -> Column:
    return F.when(~valid, "invalid").when(sets_match & flag_match, "correct").when(~sets_match & flag_match, "set_only").when(sets_match, "uncertainty_only").otherwise("both")


def cluster_numbers(sums: DataFrame, cluster: str) -> DataFrame:
    """sums with k from 1 on, in the order of two digits of the cluster's MD5 and then of the cluster: counted by digits first, so
    that no task holds all clusters."""
    own = sums.withColumn("_d", F.substring(F.md5(F.col(cluster).cast("string")), 1, 2))
    sizes = own.groupBy("_d").agg(F.count(F.lit(1)).alias("_c"))  # 256 rows at most
    before = sizes.select("_d", (F.sum("_c").over(Window.orderBy("_d")) - F.col("_c")).alias("_o"), F.sum("_c").over(Window.partitionBy()).alias("e"))
    return own.join(F.broadcast(before), "_d").withColumn("k", F.row_number().over(Window.partitionBy("_d").orderBy(cluster)) + F.col("_o")).drop("_d", "_o")


def bootstrap(df: DataFrame, cluster: str, values: str | list[str], draws: int = 200, seed: int = 7) -> DataFrame:
    """method, mean, lo and hi (2.5 % and 97.5 %) of each value's mean under resampling of clusters, and of its difference to the
    first's (method a-b). All take the same draws. Draws are hashes, so any engine can repeat them.

    Clusters are summed first; what is crossed with the draws is one row for each cluster, not each reading."""
    values = [values] if isinstance(values, str) else values
    sums = df.groupBy(cluster).agg(*(F.sum(v).alias(v) for v in values), F.count(F.lit(1)).alias("n"))
    ids = cluster_numbers(sums, cluster)
    picks = ids.select(F.col("k").alias("slot"), "e").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    digits = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("bigint")
    picks = picks.select("draw", (1 + digits % F.col("e")).alias("k"))
    means = picks.join(ids, "k").groupBy("draw").agg(*((F.sum(v) / F.sum("n")).alias(v) for v in values))
    named = [(v, F.col(v)) for v in values] + [(f"{v}-{values[0]}", F.col(v) - F.col(values[0])) for v in values[1:]]
    long = means.select(F.explode(F.array(*(F.struct(F.lit(n).alias("method"), x.alias("m")) for n, x in named))).alias("r")).select("r.*")
    return long.groupBy("method").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), F.avg("m").alias("mean"))


#: Cumulated probabilities of the Poisson distribution of mean 1, in parts of 2**32: a count is how many of them a hash reaches.
POISSON = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(10)]
#: Odd multipliers of the hash.
_BY_CLUSTER, _BY_DRAW, _MIX = 2654435761, 2246822519, 73244475
_32 = (1 << 32) - 1


def draw_counts(clusters: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """How often each draw takes each cluster: a count of mean 1 from a 32-bit hash of seed, draw and cluster, which any engine can
    repeat. clusters: whole numbers."""
    low = np.uint64(_32)
    a = (clusters.astype(np.uint64) & low) * np.uint64(_BY_CLUSTER) & low
    b = (draws.astype(np.uint64) + np.uint64(seed)) * np.uint64(_BY_DRAW) & low
    h = a[:, None] ^ b[None, :]
    for _ in range(2):
        h = (h ^ h >> np.uint64(16)) * np.uint64(_MIX) & low
    return np.searchsorted(np.array(POISSON, np.uint64), h ^ h >> np.uint64(16), side="right")


def paired_bootstrap(df: DataFrame, cluster: str, values: list[str], draws: int = 10_000, seed: int = 7, share: float = 0.95) -> DataFrame:
    """method, mean (of all rows), lo and hi of each value's pooled mean under resampling of clusters, and of its difference to the
    first's (method a-b), by percentiles; all methods take the same draws. cluster is a column of whole numbers; rows without it
    don't count, and a missing value adds nothing to its sum.

    Clusters are summed first. A task then adds up its clusters for all draws in arrays, and hands on a row for each draw: no row
    for a cluster and draw ever exists, and memory is bounded by the draws. Each draw takes a cluster a hashed number of times of
    mean 1, so clusters need no numbers and no task has to know them all."""
    sums = df.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).cast("long").alias("_c")).agg(*(F.coalesce(F.sum(F.col(v).cast("double")), F.lit(0.0)).alias(f"_s{i}") for i, v in enumerate(values)), F.count(F.lit(1)).cast("double").alias("_n"))
    width = len(values) + 1

    def run(batches):
        total = np.zeros((width, draws))
        for b in batches:
            rows = np.stack([b.column(1 + i).to_numpy() for i in range(width)])
            ids = b.column(0).to_numpy()
            for lo in range(0, len(ids), 64):  # counts of a few clusters at a time
                total += rows[:, lo : lo + 64] @ draw_counts(ids[lo : lo + 64], np.arange(draws), seed)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int32)), *(pa.array(x) for x in total)], names=["draw", *(f"_s{i}" for i in range(width - 1)), "_n"])

    schema = ", ".join(["draw int", *(f"_s{i} double" for i in range(width - 1)), "_n double"])
    each = sums.mapInArrow(run, schema).groupBy("draw").agg(*(F.sum(f"_s{i}").alias(f"_s{i}") for i in range(width - 1)), F.sum("_n").alias("_n")).where("_n > 0")
    whole = sums.agg(*((F.sum(f"_s{i}") / F.sum("_n")).alias(f"_m{i}") for i in range(width - 1)))
    names = [(v, (i,)) for i, v in enumerate(values)] + [(f"{v}-{values[0]}", (i, 0)) for i, v in enumerate(values) if i]
    of = lambda cols, ks: F.col(cols[ks[0]]) if len(ks) == 1 else F.col(cols[ks[0]]) - F.col(cols[ks[1]])
    means = each.select(*((F.col(f"_s{i}") / F.col("_n")).alias(f"_d{i}") for i in range(width - 1)))
    drawn = means.select(F.explode(F.array(*(F.struct(F.lit(n).alias("method"), of([f"_d{i}" for i in range(width - 1)], ks).alias("m")) for n, ks in names))).alias("x")).select("x.*")
    points = whole.select(F.explode(F.array(*(F.struct(F.lit(n).alias("method"), of([f"_m{i}" for i in range(width - 1)], ks).alias("mean")) for n, ks in names))).alias("x")).select("x.*")
    edge = (1 - share) / 2
    return points.join(drawn.groupBy("method").agg(F.percentile("m", F.lit(edge)).alias("lo"), F.percentile("m", F.lit(1 - edge)).alias("hi")), "method")
