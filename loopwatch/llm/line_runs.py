"""Removal of repeated runs of lines, by a suffix array over line ids built with distributed prefix doubling.

Texts are cut at line feeds; lines that hold a word get an id. A line whose id occurs once ends every repeated run, so only
positions with repeated ids enter the suffix array. Round j ranks the positions by their first 2**j lines: pairs of ranks
(of a position and of the one 2**(j-1) lines on) are counted, pairs that occur once leave, the others are sorted over all
partitions and numbered in that order. Positions of equal rank form the suffix array's interval of longest common prefix
2**j at least; rounds go on until no interval is left. A run of `min_lines` lines is read from two overlapping ranks.

In each interval the first place keeps its lines; each other place is a later copy of as many lines as the interval's prefix is
long. A place's deepest interval in which it is not the first decides, and a maximal run of n lines is the union of two places'
intervals of the greatest power of two in n, so what is deleted are the later copies of maximal repeated runs, whole.

Where `long_words` is given, a single line of so many words or more is a run of its own.

Of equal runs the first, by doc_id and line, stays; lines of the later ones are deleted. A later copy may overlap the first one:
its lines go all the same, so of three equal lines the first stays (the run of lines 2 and 3 repeats that of 1 and 2), while of
two equal lines both stay, as no run of two lines occurs twice. Runs that overlap in a text are deleted as one. Blank lines belong to no run and stay, except that a text that loses all its lines becomes empty.

A null text has no lines and stays null. Rows with null doc_id come first in the order. Repeated rows (equal doc_id and text)
count as one and get equal texts. Ties can't occur: places are distinct. Extra columns are carried; columns named n_lines,
n_deleted, longest_run or common_prefix are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwatch.llm import common
from loopwatch.llm.textarrays import IN_WORD, _offsets, _power_table, mix, pieces

MIN_LINES = 2
#: A row of docs, for joins: its id and its text.
KEY = ["doc", "th"]


def line_ids(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """doc, th, at (line of the text), i (line among those with a word), id and, with long_words, whether it is long, of every
    line with a word."""

    def run(batches):
        for b in batches:
            column = b.column(2)
            for lo, hi in pieces(column):
                part = column.slice(lo, hi - lo)
                if part.null_count:
                    part = part.fill_null(b"")
                off = _offsets(part)
                data = part.buffers()[2]
                buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
                off = off - off[0]
                n = hi - lo
                feeds = np.flatnonzero(buf == 10)
                of = np.searchsorted(off, feeds, side="right") - 1
                doc = np.concatenate((np.arange(n), of))
                starts, ends = np.concatenate((off[:-1], feeds + 1)), np.concatenate((off[1:], feeds))
                order = np.lexsort((starts, doc))
                doc, starts, ends = doc[order], starts[order], ends[np.lexsort((ends, doc))]
                at = np.arange(len(doc)) - np.searchsorted(doc, doc)
                up, down = _power_table(len(buf) + 2)
                sums = np.zeros(len(buf) + 1, np.uint64)
                np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
                full = np.concatenate(([0], np.cumsum(IN_WORD[buf])))
                real = full[ends] > full[starts]
                doc, starts, ends, at = doc[real], starts[real], ends[real], at[real]
                ids = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                i = np.arange(len(doc)) - np.searchsorted(doc, doc)
                more, names = [], ["doc", "th", "at", "i", "id"]
                if long_words is not None:
                    inside = IN_WORD[buf].astype(bool)
                    # a text can begin inside a word of the one before
                    begun = np.concatenate(([0], np.cumsum(inside[1:] & ~inside[:-1]))) if len(buf) else np.zeros(1, np.int64)
                    begun = np.concatenate(([0], begun + (inside[:1].sum() if len(buf) else 0)))
                    n_words = begun[ends] - begun[starts] + (inside[starts] & (starts > 0) & inside[np.maximum(starts - 1, 0)])
                    more, names = [pa.array(n_words >= long_words)], [*names, "long"]
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(at.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(ids.view(np.int64)), *more], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc long, th long, at int, i int, id long" + ("" if long_words is None else ", long boolean"))


def _ranked(scratch: common.Scratch, positions: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Positions whose columns' values occur twice or more, with rank r (in the values' order), size and first place."""
    places = positions.withColumn("place", F.struct("doc", "th", "i"))
    classes = places.groupBy(*columns).agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("first")).where("size > 1")
    # numbers that grow with the partition and within it: after a global sort, the order of the values
    classes = scratch.save(classes.orderBy(*columns).withColumn("r", F.monotonically_increasing_id()), f"{name}_classes")
    return scratch.save(positions.join(classes, columns).select("doc", "th", "i", "r", "size", "first"), name)


def _shifted(level: DataFrame, by: int) -> DataFrame:
    """Each position's rank a and the rank b of the position `by` lines on, where that has one."""
    ahead = level.select("doc", "th", (F.col("i") - by).alias("i"), F.col("r").alias("b"))
    return level.select("doc", "th", "i", F.col("r").alias("a")).withColumn("doc", F.coalesce("doc", F.lit(-(1 << 63)))).join(ahead.withColumn("doc", F.coalesce("doc", F.lit(-(1 << 63)))), ["doc", "th", "i"])


def later_runs(spark: SparkSession, lines: DataFrame, scratch: common.Scratch, min_lines: int = MIN_LINES) -> DataFrame:
    """doc, th, i and width: places that share a prefix of min_lines lines or more with an earlier one, and how many lines their
    deepest such interval's prefix has (a power of two, or min_lines)."""
    j = 0
    level = _ranked(scratch, lines.select(F.coalesce("doc", F.lit(-(1 << 63))).alias("doc"), "th", "i", "id"), ["id"], "level_0")
    later = []
    while True:
        width = 1 << j
        intervals = [(level, width)] if width >= min_lines else []
        if width < min_lines < 2 * width:
            intervals.append((_ranked(scratch, _shifted(level, min_lines - width), ["a", "b"], "runs"), min_lines))
        later += [x.where(F.struct("doc", "th", "i") != F.col("first")).select("doc", "th", "i", F.lit(w).alias("width")) for x, w in intervals]
        if level.isEmpty():
            break
        level = _ranked(scratch, _shifted(level, width), ["a", "b"], f"level_{j + 1}")
        j += 1
    if not later:
        return level.select("doc", "th", "i", F.lit(min_lines).alias("width"))  # no line occurs twice
    return common.union(later).groupBy("doc", "th", "i").agg(F.max("width").alias("width"))


def later_lines(lines: DataFrame) -> DataFrame:
    """doc, th and i of the long lines that occur earlier."""
    places = lines.where("long").select(F.coalesce("doc", F.lit(-(1 << 63))).alias("doc"), "th", "i", "id")
    first = places.groupBy("id").agg(F.min(F.struct("doc", "th", "i")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return places.join(first, "id").where(F.struct("doc", "th", "i") != F.col("first")).select("doc", "th", "i")


def dedup(spark: SparkSession, docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """docs with the text that is left, n_lines (with a word, before), n_deleted, longest_run (deleted in one run) and
    common_prefix (the greatest depth of a deleted run)."""
    scratch = common.Scratch(spark)
    docs = docs.drop("n_lines", "n_deleted", "longest_run", "common_prefix")
    lines = scratch.save(line_ids(docs, long_words).dropDuplicates(["doc", "th", "i"]), "lines")
    later = later_runs(spark, lines, scratch, min_lines)
    if long_words is not None:
        later = later.unionByName(later_lines(lines).withColumn("width", F.lit(1)))
    runs = F.struct("i", "width")
    starts = later.groupBy("doc", "th").agg(F.sort_array(F.collect_list(runs)).alias("starts"), F.max("width").alias("common_prefix"))
    starts = scratch.save(starts.select("doc", "th", F.struct(F.col("starts.i"), F.col("starts.width"), "common_prefix").alias("runs")), "starts")
    # a text and its own starts meet; both are as long as the text. The row travels whole, so no name of it can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("th"))
    joined = rows.join(starts.hint("merge"), ["doc", "th"], "left").select("row.*", "runs.*")
    names, place = docs.columns, docs.columns.index("text")
    n = len(names)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def cut(batches):
        for b in batches:
            texts, total, gone, longest = [], [], [], []
            for text, own, widths in zip(b.column(place).to_pylist(), b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True):
                parts = (text or "").encode().split(b"\n")
                worded = [k for k, p in enumerate(parts) if p.split()]
                dead: set[int] = set()
                run = best = 0
                reach = -1
                for s, width in zip(own or (), widths or (), strict=True):
                    end = max(s + width, reach)
                    run = end - max(s, reach) + (run if s <= reach else 0)
                    reach, best = end, max(best, run)
                    dead.update(range(s, s + width))
                total.append(len(worded))
                gone.append(len(dead))
                longest.append(best)
                if not dead:
                    texts.append(text)
                elif len(dead) == len(worded):
                    texts.append("")
                else:
                    drop = {worded[i] for i in dead}
                    texts.append(b"\n".join(p for k, p in enumerate(parts) if k not in drop).decode())
            columns = [pa.array(texts, pa.string()) if k == place else b.column(k) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (total, gone, longest)), b.column(n + 2).cast(pa.int64())], names=[*names, "n_lines", "n_deleted", "longest_run", "common_prefix"])

    return joined.mapInArrow(cut, ", ".join([*fields, "n_lines long", "n_deleted long", "longest_run long", "common_prefix long"]))
