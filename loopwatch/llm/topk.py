"""Exact top-k search by integer inner product, MaxScore over shards of vectors.

Components become floor(256 * x). Candidates are packed into blocks, queries too; a query block visits every candidate block.
Within a block each query's terms (components it weighs) are split by score bounds: the essential ones are those without
which no candidate could reach the query's k-th best score so far. Their postings are summed for all candidates of the block,
then the other terms are probed, in steps that double, only for the candidates still competitive. Each task keeps the k best of its blocks and the
shards' results are merged by query. Bounds never cut a candidate that ties with the k-th best, so ties go by vec_id exactly.

Vectors that are null or hold nulls or non-finite components, and rows with a null vec_id, take no part. Shorter vectors count
as padded with zeros; empty ones score 0. Rows with one vec_id and equal vectors are one row; with different vectors each is a
candidate, and the query is the least of them. A query with fewer candidates than k gets all. Empty tables give no rows.
Scores beyond 64 bits can't be expressed and raise OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, QUERY_BLOCK, BLOCK, SCALE = 5, 512, 4096, 256.0
#: A task sends on its results when it holds so many queries; the final ranking merges them.
MOST_QUERIES = 50_000
PACKED = "block long, n int, dim int, ids binary, data binary"
_EXACT = 1 << 53


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        dim = max(m.shape[1] for _, m in held)
        ids = np.concatenate([i for i, _ in held])
        data = np.concatenate([np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for _, m in held])
        held.clear()
        for lo in range(0, len(ids), size):
            i, m = ids[lo : lo + size], data[lo : lo + size]
            yield pa.RecordBatch.from_arrays([pa.array([int(i[0])]), pa.array([len(i)], pa.int32()), pa.array([dim], pa.int32()), pa.array([i.tobytes()]), pa.array([np.ascontiguousarray(m).tobytes()])], names=["block", "n", "dim", "ids", "data"])

    n = 0
    for b in batches:
        lists = b.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        rows = np.zeros((len(lengths), int(lengths.max(initial=0))))
        rows[np.arange(rows.shape[1])[None, :] < lengths[:, None]] = values
        held.append((b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), rows))
        n += len(lengths)
        if n >= size:
            yield from flush()
            n = 0
    if held and n:
        yield from flush()


def best_of_block(query: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the rows that score `least` or more. low, high: bounds of each component within the rows."""
    terms = np.flatnonzero(query)
    q = query[terms]
    bound = np.maximum(q * low[terms], q * high[terms])
    reach = bound - np.minimum(q * low[terms], q * high[terms])
    order = np.argsort(-reach, kind="stable")
    terms, q, bound = terms[order], q[order], bound[order]
    rest = np.concatenate((np.cumsum(bound[::-1])[::-1], [0.0]))  # the most that terms from here on can add
    if rest[0] < least:
        return np.zeros(0, np.int64), np.zeros(0)
    # a row that gains nothing over the least contribution of the essential terms can't reach `least` by the others
    reach = reach[order]
    without = np.concatenate(([0.0], np.cumsum(bound - reach))) + rest
    essential = int(np.searchsorted(-without, -least, side="right")) if least != -np.inf else len(terms)
    alive, score = None, None
    at = 0
    step = min(max(1, essential), max(1, len(terms)))
    while at < len(terms):
        to = min(len(terms), at + step)
        part = (rows[:, terms[at:to]] if alive is None else rows[np.ix_(alive, terms[at:to])]) @ q[at:to]
        score = part if score is None else score + part
        alive = np.arange(len(rows)) if alive is None else alive
        keep = score + rest[to] >= least
        if not keep.all():
            alive, score = alive[keep], score[keep]
        at, step = to, step * 2
        if not len(alive):
            break
    if score is None:
        alive, score = np.arange(len(rows)), np.zeros(len(rows))
    keep = score >= least
    return alive[keep], score[keep]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sent():
        out = [(q, int(v), int(s)) for q, (ids, scores) in best.items() for v, s in zip(ids, scores, strict=True)]
        best.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for row in b.to_pylist():
            queries = known.get(row["q_block"])
            if queries is None:
                queries = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_data"], np.float64).reshape(row["q_n"], row["q_dim"])
                if len(known) > 8:
                    known.clear()
                known[row["q_block"]] = queries
            ids, data = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.float64).reshape(row["n"], row["dim"])
            dim = max(row["dim"], row["q_dim"])
            data = np.pad(data, ((0, 0), (0, dim - row["dim"])))
            q_ids, q_data = queries[0], np.pad(queries[1], ((0, 0), (0, dim - row["q_dim"])))
            if dim and np.abs(data).max(initial=0) * np.abs(q_data).max(initial=0) * dim >= _EXACT:
                data, q_data = (np.vectorize(int, otypes=[object])(x) if x.size else x for x in (data, q_data))
            low, high = (data.min(0), data.max(0)) if dim else (np.zeros(0), np.zeros(0))
            for i, q_id in enumerate(q_ids.tolist()):
                got = best.get(q_id)
                least = got[1][-1] if got is not None and len(got[1]) >= k else -np.inf
                at, score = best_of_block(q_data[i], data, low, high, least)
                other = ids[at] != q_id
                own, score = ids[at][other], score[other]
                if got is not None:
                    own, score = np.concatenate((got[0], own)), np.concatenate((got[1], score))
                if len(own) > 8 * k and score.dtype != object:
                    cut = np.partition(score, len(score) - k)[len(score) - k]
                    own, score = own[score >= cut], score[score >= cut]
                first = sorted(range(len(own)), key=lambda j: (-score[j], own[j]))[:k]
                best[q_id] = own[first], score[first]
            if len(best) >= MOST_QUERIES:
                yield from sent()
    yield from sent()


def search(spark: SparkSession, vectors: DataFrame, is_query, k: int = K, shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of all other rows of vectors (vec_id, embedding) for each query row."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fit, F.lit(False)))
    usable = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates()
    queries = usable.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    packed = queries.repartition(blocks, "vec_id").mapInArrow(lambda it: _pack(it, QUERY_BLOCK), PACKED)
    # every shard of candidates gets a copy of every query block; both sides meet by shard. By its size Spark may still send all those
    # copies through the driver as a broadcast, so the join is named
    sent = packed.select(*(F.col(c).alias(f"q_{c}") for c in ("block", "n", "dim", "ids", "data")), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = usable.mapInArrow(lambda it: _pack(it, BLOCK), PACKED).withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    met = sent.join(held.hint("merge"), "shard").select("q_block", "q_n", "q_dim", "q_ids", "q_data", "n", "dim", "ids", "data")
    found = met.mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
