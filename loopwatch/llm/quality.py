"""Quality rules whose cutoffs come from the data: mergeable quantile sketches for each language and source.

`text_features` counts, in one pass over whole texts, what the rules need. `sketches` counts log-spaced buckets of each
metric; such counts merge by addition, in any order, with the same result. `cutoffs` reads quartiles from them and puts an
upper fence above (and for mean word length also a lower one). A group of fewer than `MIN_GROUP` rows takes its language's
merged sketch, a small language the one of all rows. `judge` joins the fences to the rows.

Null texts count as texts without words and fail. Null languages and sources are groups of their own. Repeated rows are
judged alike and each counted. An empty table gives an empty result. Extra columns are carried by `judge`; a table that has
columns named like the features should rename them first, as `apply` does by working on doc_id, text, lang and source only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopwatch.llm import common
from loopwatch.llm.textarrays import _power_table, mix, pieces, windows, words

WINDOW, MIN_WORDS, MOST_REPEATED = 8, 20, 30
#: Relative error of a sketch's quantiles.
ACCURACY = 0.01
MIN_GROUP = 100
#: Metric: (interquartile ranges above the upper quartile, least distance above it). The distance keeps a group in which
#: nearly all values are equal, and whose range is 0, from losing rows that differ by little.
FENCES = {"symbols_per_word": (6.0, 0.25), "upper_share": (6.0, 0.25), "dup_line_share": (6.0, 0.5), "repeat_share": (6.0, 0.3), "echo_share": (6.0, 0.2), "word_length": (6.0, 2.0)}
LOWER_FENCES = {"word_length": (6.0, 2.0)}

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_echoes"]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:], dtype=np.int64)
    return total[offsets[1:]] - total[offsets[:-1]]


def _duplicates(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def count_features(column: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text of a binary column."""
    w = words(column)
    buf, off, n = w.bytes, w.offsets, len(w.first) - 1
    inside = np.zeros(len(buf) + 1, np.int32)
    inside[w.starts] += 1
    inside[w.ends] -= 1
    inside = np.cumsum(inside[:-1]).astype(bool) if len(buf) else np.zeros(0, bool)
    chars = _per_text(inside & ((buf & 0xC0) != 0x80), off)
    # lines: each text starts one, and each line feed the next
    feeds = np.flatnonzero(buf == 10)
    of_feed = np.searchsorted(off, feeds, side="right") - 1
    doc = np.concatenate((np.arange(n), of_feed))
    starts, ends = np.concatenate((off[:-1], feeds + 1)), np.concatenate((off[1:], feeds))
    by_start, by_end = np.lexsort((starts, doc)), np.lexsort((ends, doc))
    starts, ends, doc = starts[by_start], ends[by_end], doc[by_start]
    up, down = _power_table(len(buf) + 2)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    total = np.concatenate(([0], np.cumsum(inside)))
    real = total[ends] > total[starts]
    starts, ends, doc = starts[real], ends[real], doc[real]
    lines = mix((sums[ends] - sums[starts]) * down[starts] + mix(doc.astype(np.uint64) + np.uint64(1)) + (ends - starts).astype(np.uint64))
    n_lines = np.bincount(doc, minlength=n)
    _, firsts = np.unique(lines, return_index=True)
    n_dup = n_lines - np.bincount(doc[firsts], minlength=n)
    # words in windows that occur twice or more in their text
    hashes = w.hashes()
    at, runs = windows(hashes, w.doc, WINDOW)
    again = at[_duplicates(mix(runs + mix(w.doc[at].astype(np.uint64))))]
    covered = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.subtract.at(covered, np.minimum(again + WINDOW, len(w.starts)), 1)
    repeat = np.bincount(w.doc[np.cumsum(covered[:-1]) > 0], minlength=n)
    echo = np.bincount(w.doc[1:][(hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n)
    return [np.diff(w.first), chars, _per_text(_SYMBOL[buf], off), n_dup, repeat, n_lines, _per_text(_UPPER[buf], off), _per_text(_LETTER[buf], off), echo]


def text_features(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the columns in carry and COUNTS of every row, over its whole text."""

    def run(batches):
        for b in batches:
            column = b.column(3)
            for lo, hi in pieces(column):
                got = count_features(column.slice(lo, hi - lo))
                own = [b.column(names.index(c)).slice(lo, hi - lo) for c in out]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int64()) for x in got)], names=[*out, *COUNTS])

    used = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("binary").alias("text"), *(c for c in carry if c != "text"))
    names, out = used.columns, ["doc_id", "lang", "source", *carry]
    kinds = ", ".join(f"`{c}` {used.schema[c].dataType.simpleString()}" for c in out)
    rows = used.mapInArrow(run, kinds + ", " + ", ".join(f"{c} long" for c in COUNTS))
    return rows.withColumn("text", F.col("text").cast("string")) if "text" in carry else rows


def metrics(features: DataFrame) -> DataFrame:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return features.withColumns(
        {
            "symbols_per_word": share("n_symbols", "n_words"),
            "upper_share": share("n_upper", "n_letters"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "echo_share": share("n_echoes", "n_words"),
            "word_length": share("word_chars", "n_words"),
        }
    )


_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)


def sketches(measured: DataFrame) -> DataFrame:
    """Row counts by lang, source, metric and bucket. Bucket b holds values in (g**(b-1), g**b]; zero has the least bucket."""
    names = list(FENCES)
    long = measured.select("lang", "source", F.expr(f"stack({len(names)}, {', '.join(f"'{m}', {m}" for m in names)}) as (metric, value)"))
    bucket = F.when(F.col("value") <= 0, F.lit(-(1 << 30))).otherwise(F.ceil(F.log("value") / math.log(_GAMMA)).cast("int"))
    return long.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows, q25 and q75 of each metric by the columns given, from merged sketches."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "metric")
    upto = merged.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("bucket"))})
    value = F.when(F.col("bucket") == -(1 << 30), F.lit(0.0)).otherwise(F.pow(F.lit(_GAMMA), F.col("bucket")) * (2 / (1 + _GAMMA)))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("total")), F.struct("bucket", value.alias("v")))).getField("v")
    return upto.groupBy(*by, "metric").agg(F.max("total").alias("rows"), at(0.25).alias("q25"), at(0.75).alias("q75"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """A row for each lang and source, with the fences hi_<metric> and lo_<metric>."""

    def wide(by, tag):
        q = quartiles(sketch, by)
        spread = F.col("q75") - F.col("q25")
        hi = {m: F.max(F.when(F.col("metric") == m, F.col("q75") + F.greatest(spread * k, F.lit(least)))) for m, (k, least) in FENCES.items()}
        lo = {m: F.max(F.when(F.col("metric") == m, F.col("q25") - F.greatest(spread * k, F.lit(least)))) for m, (k, least) in LOWER_FENCES.items()}
        return q.groupBy(*by).agg(F.max("rows").alias(f"{tag}_rows"), *(c.alias(f"{tag}_hi_{m}") for m, c in hi.items()), *(c.alias(f"{tag}_lo_{m}") for m, c in lo.items()))

    own, lang, every = wide(["lang", "source"], "own"), wide(["lang"], "lang").withColumnRenamed("lang", "lang_"), wide([], "all")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_"))).crossJoin(F.broadcast(every))  # `every` is one row
    fences = [f"hi_{m}" for m in FENCES] + [f"lo_{m}" for m in LOWER_FENCES]
    pick = lambda c: F.when(F.col("own_rows") >= MIN_GROUP, F.col(f"own_{c}")).when(F.col("lang_rows") >= MIN_GROUP, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))
    return joined.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *(pick(c).alias(c) for c in fences))


def judge(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """The rows with base_failed and kept."""
    beyond = [F.col(m) > F.col(f"hi_{m}") for m in FENCES] + [F.col(m) < F.col(f"lo_{m}") for m in LOWER_FENCES]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    odd = beyond[0]
    for c in beyond[1:]:
        odd = odd | c
    on = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    return measured.join(fences, on, "left").withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(odd, F.lit(False))).drop("f_lang", "f_source")


def apply(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the counts, the metrics, the fences, base_failed and kept of every row of docs."""
    scratch = common.Scratch(spark)
    measured = metrics(scratch.save(text_features(docs), "features"))
    return judge(measured, cutoffs(sketches(measured)))
