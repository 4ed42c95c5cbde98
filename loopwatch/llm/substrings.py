"""Removal of byte strings that occur earlier, over a sparse suffix array refined by bucket pointers.

Every start of a string of `length` bytes is a suffix to be placed. Its first bucket is the q-gram with the least identifier
among those that the string holds (the leftmost of equal ones), so that equal strings share a bucket at an equal offset and only
one q-gram in some thirty-five needs a row. Consecutive starts with the same q-gram travel as one unit: (lo, n) and the offset r
of that q-gram.

A bucket is refined by the identifiers of the q-grams at later offsets: what all strings of a unit share names its bucket, all
that they cover names its class in the bucket, and both are folded from the q-grams' identifiers at offsets q, 2q and so on.
Buckets of one row leave: their strings occur once. At the first level buckets are counted before anything else travels. Of a class, all rows but the first are later copies, whole. Only the first
rows of buckets with several classes go on; they are cut into units of fewer starts, whose buckets reach deeper, and the same
step is applied to those, down to single starts, where bucket and class are the same. So a group of copies enters a deeper level
once, whatever its size, and counts and minima are all that is gathered by bucket.

A start is a later copy if an equal string starts in a smaller document, or earlier in its own; overlaps count, and all strings
are judged on the input. Documents are ordered by doc_id, null first, and then by the hash of their text; rows of equal doc_id
and text count as one document and get equal results. Null and empty texts have no strings, nor has a text shorter than
`length`. Strings are compared by two 64-bit names. A text is one row and its arrays take some hundred bytes a byte of it, in
pieces of 0.6 MB or one text. Extra columns are carried; columns named n_bytes, spans or kept are replaced. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwatch.llm import common
from loopwatch.llm.textarrays import _offsets, _power_table, mix, pieces

LENGTH, Q = 100, 32
#: Starts in a unit at the levels after the first.
STEPS = (8, 1)
KEY = ["doc", "th"]
UNIT = "doc long, th long, lo int, n int, r int, bucket long, own long"
_NULL = -(1 << 63)


def _names(buf: np.ndarray, q: int) -> np.ndarray:
    """The identifier of the q bytes from each place on."""
    n = len(buf)
    up, down = _power_table(n + 2)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[q:] - sums[:-q]) * down[: n - q + 1])


def _fold(names: np.ndarray, q: int, at: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The identifier of bytes [at, at+size), from those of its q-grams at offsets 0, q, 2q ... and of its last."""
    out = mix(seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
    for k in range(0, int(size.max(initial=0)), q):
        on = size > k
        step = names[np.where(on, at + np.minimum(k, size - q), 0)]
        out = np.where(on, mix(out * np.uint64(0xD6E8FEB86659FD93) + step), out)
    return out


def _least(names: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` names from each place on."""
    least, span = names, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    over = width - span
    return np.minimum(least[:-over], least[over:]) if over else least


def _first_units(names: np.ndarray, off: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lo, n and the place p of the least q-gram, of every unit of texts that lie between the offsets."""
    width = length - q + 1
    counts = np.maximum(np.diff(off) - length + 1, 0)
    total = int(counts.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3
    starts = np.repeat(off[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(total)
    least = _least(names, width)[starts]
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)))
    at = np.flatnonzero(new)
    lo, hi = starts[at], starts[np.concatenate((at[1:], [total])) - 1]
    p = lo + np.lib.stride_tricks.sliding_window_view(names, width)[lo].argmin(1)
    ties = np.flatnonzero(hi > p)  # the least q-gram occurs again and goes on being the least
    if not len(ties):
        return lo, hi - lo + 1, p
    parts = [(np.delete(lo, ties), np.delete(hi, ties), np.delete(p, ties))]
    for a, b, first in zip(lo[ties].tolist(), hi[ties].tolist(), p[ties].tolist(), strict=True):
        places = a + np.flatnonzero(names[a : b + width] == names[first])
        places = places[: np.searchsorted(places, b) + 1]
        parts.append((np.concatenate(([a], places[:-1] + 1)), np.minimum(places, b), places))
    lo, hi, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    return lo, hi - lo + 1, p


def _cut(lo: np.ndarray, n: np.ndarray, r: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each unit cut where the offset r of its q-gram is divisible by step: lo, n, p, and which unit it was."""
    top, low = r // step, (r - n + 1) // step
    count = top - low + 1
    of = np.repeat(np.arange(len(lo)), count)
    block = top[of] - (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    p = (lo + r)[of]
    first = np.minimum(r[of], block * step + step - 1)
    last = np.maximum((r - n + 1)[of], block * step)
    return p - first, first - last + 1, p, of


def _bucket(names: np.ndarray, p: np.ndarray, r: np.ndarray, step: int, length: int, q: int) -> np.ndarray:
    """The name of what all strings of each unit share, were it as wide as it may be."""
    block = r // step
    return _fold(names, q, p - block * step, np.full(len(p), length - step + 1), block)


def _rows(names, off, lo, n, p, step, length, q, doc, th, at) -> pa.RecordBatch:
    r = p - lo
    bucket = _bucket(names, p, r, step, length, q)
    own = _fold(names, q, lo, n - 1 + length, r)
    rows = pa.array(at)
    text = np.searchsorted(off, lo, side="right") - 1
    columns = [doc.take(rows), th.take(rows), *(pa.array(x.astype(np.int32)) for x in (lo - off[text], n, r)), *(pa.array(x.view(np.int64)) for x in (bucket, own))]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "th", "lo", "n", "r", "bucket", "own"])


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a binary column: rows lo to hi, their bytes and offsets."""
    for lo, hi in pieces(column):
        part = column.slice(lo, hi - lo)
        if part.null_count:
            part = part.fill_null(b"")
        off = _offsets(part)
        if off[-1] > off[0]:
            yield lo, hi, np.frombuffer(part.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def first_units(rows: DataFrame, length: int, q: int, only_bucket: bool = False) -> DataFrame:
    """Units of all texts by their least q-gram, or only their buckets."""

    def run(batches):
        for b in batches:
            for lo, _, buf, off in _texts(b.column(2)):
                if len(buf) < length:
                    continue
                names = _names(buf, q)
                start, n, p = _first_units(names, off, length, q)
                if only_bucket:
                    yield pa.RecordBatch.from_arrays([pa.array(_bucket(names, p, p - start, length - q + 1, length, q).view(np.int64))], names=["bucket"])
                elif len(start):
                    at = lo + np.searchsorted(off, start, side="right") - 1
                    yield _rows(names, off, start, n, p, length - q + 1, length, q, b.column(0), b.column(1), at)

    return rows.mapInArrow(run, "bucket long" if only_bucket else UNIT)


def finer_units(rows: DataFrame, opened: DataFrame, step: int, length: int, q: int) -> DataFrame:
    """Open units, cut into units of at most `step` starts; each text meets its own."""
    units = opened.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "n", "r")).alias("units"))
    units = units.select(*KEY, F.col("units.lo").alias("lo"), F.col("units.n").alias("n"), F.col("units.r").alias("r"))
    # rows of equal doc_id and text are one document
    met = rows.join(units.hint("merge"), KEY).select(*KEY, "text", "lo", "n", "r")

    def run(batches):
        for b in batches:
            runs = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (b.column(3), b.column(4), b.column(5))]
            first = b.column(3).offsets.to_numpy().astype(np.int64)
            first = first - first[0]
            for lo, hi, buf, off in _texts(b.column(2)):
                names = _names(buf, q)
                mine = slice(first[lo], first[hi])
                text = np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1]))
                start, n, p, of = _cut(runs[0][mine] + off[text], runs[1][mine], runs[2][mine], step)
                yield _rows(names, off, start, n, p, step, length, q, b.column(0), b.column(1), lo + text[of])

    return met.mapInArrow(run, UNIT)


def _refined(scratch: common.Scratch, units: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Later copies (doc, th, lo, n) among the units, and the units whose buckets stay open (doc, th, lo, n, r)."""
    place = F.struct("doc", "th", "lo", "n", "r")
    classes = scratch.save(units.groupBy("bucket", "own").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("first")), f"{name}_classes")
    buckets = classes.groupBy("bucket").agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("classes")).where("rows > 1")
    shared = scratch.save(classes.join(buckets, "bucket").select("bucket", "own", "size", "first", "classes"), f"{name}_shared")
    scratch.drop(f"{name}_classes")
    later = units.join(shared.where("size > 1").select("bucket", "own", "first").hint("shuffle_hash"), ["bucket", "own"])
    later = later.where(F.struct(*KEY, "lo") != F.struct("first.doc", "first.th", "first.lo")).select(*KEY, "lo", "n")
    return scratch.save(later, f"{name}_later"), shared.where("classes > 1").select("first.*")


def later_starts(spark: SparkSession, docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """doc, th, lo, n: runs of n starts from lo on whose strings of `length` bytes start earlier too. doc, th: a row's doc_id (the
    least number for null) and the hash of its text."""
    if not 1 <= q <= length:
        raise ValueError("q must lie between 1 and length")
    scratch = common.Scratch(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    buckets = first_units(rows, length, q, only_bucket=True).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("bucket")
    buckets = scratch.save(buckets, "buckets")
    units = scratch.save(first_units(rows, length, q).join(buckets.hint("shuffle_hash"), "bucket"), "units_0")
    later, opened = _refined(scratch, units, "level_0")
    found = [later]
    scratch.drop("units_0", "buckets")
    for k, step in enumerate((s for s in STEPS if s <= length - q), 1):
        units = scratch.save(finer_units(rows, opened, step, length, q), f"units_{k}")
        later, opened = _refined(scratch, units, f"level_{k}")
        scratch.drop(f"units_{k}", f"level_{k - 1}_shared")
        found.append(later)
    return common.union(found)


def dedup(spark: SparkSession, docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """docs with n_bytes, spans (start and end of the maximal removed runs, in bytes) and kept (the bytes that are left)."""
    docs = docs.drop("n_bytes", "spans", "kept")
    runs = F.sort_array(F.collect_list(F.struct("lo", "n")))
    found = later_starts(spark, docs, length, q).groupBy(*KEY).agg(runs.alias("runs")).select(*KEY, F.col("runs.lo").alias("lo"), F.col("runs.n").alias("n"))
    found = found.select(*KEY, F.struct("lo", "n").alias("runs"))
    # the row travels whole, so no name of it can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), F.xxhash64("text").alias("th"))
    joined = rows.join(found.hint("merge"), KEY, "left").select("row", F.col("row.text").cast("binary").alias("text"), "runs.lo", "runs.n")
    names = [*docs.columns, "n_bytes", "spans", "kept"]

    def cut(batches):
        for b in batches:
            size, spans, kept = [], [], []
            for text, lo, n in zip(b.column(1), b.column(2), b.column(3), strict=True):
                data = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
                size.append(len(data))
                if not lo.is_valid:
                    spans.append([])
                    kept.append(data.to_pybytes())
                    continue
                start = lo.values.to_numpy().astype(np.int64)
                end = np.maximum.accumulate(start + n.values.to_numpy() - 1 + length)
                new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
                start, end = start[new], end[np.concatenate((new[1:], [len(end)])) - 1]
                spans.append([{"start": int(a), "end": int(e)} for a, e in zip(start, end, strict=True)])
                left = memoryview(data)
                kept.append(b"".join(left[a:e] for a, e in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True)))
            more = [pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), *more], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return joined.mapInArrow(cut, ", ".join([*fields, "n_bytes long", "spans array<struct<start: long, end: long>>", "kept binary"]))
