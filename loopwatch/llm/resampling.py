"""Importance resampling towards a target, with word tries that live in a task.

Features of a text are all its runs of 1 to `orders` consecutive words. A task takes its texts in pieces of about `PIECE` bytes,
or one longer text, and keeps a trie of each piece's words in arrays: a node stands for the run on the path from the root, and
holds how often it occurs and the CRC-32 of its bytes, from which its children's go on, so a run is hashed once in a piece
however often it occurs. The nodes' counts go into the totals of their buckets, and Spark adds the tasks' totals. The gain of a
bucket follows from the totals of all documents and of the target. A second pass walks the same paths with the gain attached to
each node; a document's weight is the floored mean gain of its features.

To the weight comes noise that is drawn from the hash of doc_id, and the highest scores are drawn without replacement: a sort
over all partitions, whose sizes give each row its rank.

A null or empty text has no features and weight 0. A row without doc_id has no noise, so no score; it adds to the totals but is
neither counted nor drawn. Ties of the score go to the smaller doc_id; rows of equal score and doc_id follow each other in any
order, so repeated rows of one text give the same result rows. Only the columns named in `carry` are returned, whole, before
those that are added; where names are equal the added column stands. With an empty table, or an empty target, all totals of that
side are 0. Words are told apart by 64-bit hashes within a piece. A long text is one piece, and its arrays take some hundred
bytes a byte of it. Buckets are gathered on the driver: their number is a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopwatch.llm import common
from loopwatch.llm.textarrays import Words, _offsets, pieces

BUCKETS, ORDERS, SEED, PERCENT, MIN_WORDS = 10_000, 2, 7, 25, 20
#: Bytes of text in a trie.
PIECE = 3_000_000
#: Bytes of a word up to which all nodes' states are advanced together.
TOGETHER = 48
#: A-Z become a-z; bytes outside digits, letters and characters beyond ASCII separate words.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in range(256)], np.uint8)
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    """What each byte adds to a CRC-32 state: eight steps of the reversed polynomial."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, state >> 1 ^ np.uint32(0xEDB88320), state >> 1)
    return state


_CRC = _crc_table()


def words(column: pa.Array) -> Words:
    """The words of each text of a binary column; a null text has none."""
    part = column.fill_null(b"") if column.null_count else column
    off = _offsets(part)
    buf = _LOWER[np.frombuffer(part.buffers()[2], np.uint8)[off[0] : off[-1]]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    inside = np.concatenate((buf != 0, [False]))
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    starts = np.flatnonzero(inside[:-1] & (first[:-1] | ~np.concatenate(([False], inside[:-2])))) if len(buf) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside[:-1] & (first[1:] | ~inside[1:])) + 1
    return Words(buf, off, starts, ends, np.searchsorted(off, starts, side="right") - 1, np.searchsorted(starts, off))


def advanced(state: np.ndarray, buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC states after the bytes buf[starts:starts+size]."""
    state = state.copy()
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -TOGETHER))  # these are longer
    for k in order[:long].tolist():
        state[k] = np.uint32(crc32(buf[starts[k] : starts[k] + size[k]].tobytes(), int(state[k] ^ _ONES))) ^ _ONES
    order = order[long:]
    left = np.searchsorted(-size[order], -np.arange(int(size[order].max(initial=0))))  # nodes with a byte at each place
    s, at = state[order], starts[order]
    for j, n in enumerate(left.tolist()):
        s[:n] = _CRC[(s[:n] ^ buf[at[:n] + j]) & 255] ^ s[:n] >> 8
    state[order] = s
    return state


def trie(w: Words, orders: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth of the trie: at which words its runs start, the node of each run, and the nodes' CRC-32."""
    if not len(w.starts):
        return
    n = len(w.starts)
    code, known = pd.factorize(w.hashes())
    word = np.empty(len(known), np.int64)
    word[code[::-1]] = np.arange(n)[::-1]  # where each distinct word occurs first
    size = w.ends - w.starts
    at, node = np.arange(n), code
    state = advanced(np.full(len(known), _ONES), w.bytes, w.starts[word], size[word])
    yield at, node, state ^ _ONES
    for depth in range(2, orders + 1):
        go = np.flatnonzero((at + depth - 1 < n) & (w.doc[np.minimum(at + depth - 1, n - 1)] == w.doc[at]))
        at, parent = at[go], node[go]
        if not len(at):
            return
        node, known = pd.factorize(parent * np.int64(len(word)) + code[at + depth - 1])
        parent, last = known // len(word), word[known % len(word)]
        state = state[parent]
        state = _CRC[(state ^ np.uint32(32)) & 255] ^ state >> 8
        state = advanced(state, w.bytes, w.starts[last], size[last])
        yield at, node, state ^ _ONES


def totals(texts: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """bucket and n: how many features of all rows of texts (one column) fall into each bucket."""

    def run(batches):
        held = np.zeros(buckets, np.int64)
        for b in batches:
            for lo, hi in pieces(b.column(0), PIECE):
                for _, node, crc in trie(words(b.column(0).slice(lo, hi - lo)), orders):
                    count = np.bincount(node, minlength=len(crc))
                    held += np.bincount(crc % np.uint32(buckets), weights=count, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["bucket", "n"])

    rows = texts.select(F.col(texts.columns[0]).cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from the totals (bucket, n) of the corpus and of the target."""
    have, want = ({r["bucket"]: r["n"] for r in x.collect()} for x in (corpus, target))
    n, m = sum(have.values()), sum(want.values())
    ratio = (float((want.get(k, 0) + 1) * (n + buckets)) / float((have.get(k, 0) + 1) * (m + buckets)) for k in range(buckets))
    return [math.floor(1000 * math.log(x)) for x in ratio]


def weights(docs: DataFrame, gain: list[int], carry: tuple[str, ...] = ("doc_id",), orders: int = ORDERS) -> DataFrame:
    """The carried columns, n_words, n_features and weight of each row of docs."""
    carry = tuple(c for c in carry if c not in ("n_words", "n_features", "weight", "score", "rank"))
    buckets = len(gain)

    def run(batches):
        table = np.array(gain, np.int64)
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for lo, hi in pieces(b.column(1), PIECE):
                w = words(b.column(1).slice(lo, hi - lo))
                total, count = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for at, node, crc in trie(w, orders):
                    own = table[crc % np.uint32(buckets)]
                    sums = np.concatenate(([0], np.cumsum(own[node])))
                    cut = np.searchsorted(at, w.first)  # runs start in the order of the texts
                    total += sums[cut[1:]] - sums[cut[:-1]]
                    count += np.diff(cut)
                n_words[lo:hi], n_features[lo:hi] = np.diff(w.first), count
                weight[lo:hi] = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), *map(pa.array, (n_words, n_features, weight))], names=[*carry, "n_words", "n_features", "weight"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields]
    rows = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join([*fields, "n_words long", "n_features long", "weight long"]))


def with_score(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """score: the weight and noise from the hash of the seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def ranked(rows: DataFrame, scratch: common.Scratch) -> DataFrame:
    """rows with rank 1, 2, 3 ... by score downwards, then doc_id: numbers of a sort over all partitions."""
    placed = scratch.save(rows.orderBy(F.desc("score"), "doc_id").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    # one row for each partition of the sort
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    at = F.col("_at") - F.shiftleft(part, 33)
    return placed.join(F.broadcast(before), part == F.col("_part")).withColumn("rank", F.col("_before") + at + 1).drop("_part", "_before", "_at")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, carry: tuple[str, ...] = ("doc_id",), *, buckets: int = BUCKETS, orders: int = ORDERS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The carried columns (doc_id among them), n_words, n_features, weight, score and rank of each row of docs (doc_id, text);
    rank is null where the row isn't drawn. target: a column of texts. `percent` of the rows with `min_words` words are drawn."""
    if not 0 <= percent <= 100 or orders < 1 or buckets < 1:
        raise ValueError("percent must lie between 0 and 100, orders and buckets must be positive")
    scratch = common.Scratch(spark)
    gain = gains(totals(docs.select("text"), buckets, orders), totals(target, buckets, orders), buckets)
    rows = scratch.save(with_score(weights(docs, gain, carry, orders), seed), "scored")
    fit = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    n_drawn = percent * rows.where(fit).count() // 100
    placed = ranked(rows.where(fit), scratch).withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    return placed.unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long")))
