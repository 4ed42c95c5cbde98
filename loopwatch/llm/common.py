"""What several operators share: scratch tables in the shared folder, packed exchanges and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where the session names none, one process may take
    a new temporary folder (as tests do); a cluster may not, as its executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = getattr(scratch_root, "own", None) or tempfile.mkdtemp(prefix="loopwatch-")
        scratch_root.own = root
        root = f"file://{root}"
    return f"{root.rstrip('/')}/loopwatch"


#: Spark's own setting: a written table's shuffle files go once it is written, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written once and read again, so that a lost executor costs a reread and not the whole lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions an integer that Spark's hash partitioning sends there."""
    found: dict[int, int] = {}
    lo, step = 0, max(64, 12 * n)
    while len(found) < n:
        rows = spark.range(lo, lo + step, 1, 1).select(F.col("id").cast("int").alias("k")).groupBy(F.expr(f"pmod(hash(k), {n})").alias("p")).agg(F.min("k").alias("k"))
        for p, k in rows.collect():
            found.setdefault(p, k)
        lo += step
    return [found[p] for p in range(n)]


PACKED = "k int, blob binary"


class Packer:
    """Gathers parallel arrays by partition of their first, a 64-bit hash, and gives one packed row for each partition."""

    def __init__(self, keys: list[int], dtypes: list[str], most: int = 1_500_000):
        self.keys, self.row = np.asarray(keys, np.int32), np.dtype([(f"f{i}", t) for i, t in enumerate(dtypes)])
        self.held: list[np.ndarray] = []
        self.n, self.most = 0, most

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = np.empty(len(columns[0]), self.row)
        for i, c in enumerate(columns):
            rows[f"f{i}"] = c
        self.held.append(rows)
        self.n += len(rows)
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        rows = np.concatenate(self.held)
        self.held, self.n = [], 0
        part = ((rows["f0"] >> np.uint64(20)) % np.uint64(len(self.keys))).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        blobs = [x.tobytes() for x in np.split(rows, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(self.keys[part[at]], pa.int32()), pa.array(blobs, pa.binary())], names=["k", "blob"])


def exchange(packed: DataFrame, n: int, dtypes: list[str], use: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Deals packed rows to their partitions; use() gets all rows of one partition as a structured array."""
    row = np.dtype([(f"f{i}", t) for i, t in enumerate(dtypes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_buffer(), row) for b in batches for x in b.column(1)]
        if held:
            rows = np.concatenate(held)
            held.clear()
            yield from use(rows)

    return packed.repartition(n, "k").mapInArrow(run, schema)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], reduce(np.logical_or, [c[1:] != c[:-1] for c in columns]))))


def star_step(scratch: Scratch, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that join what edges (a, b) join, nearer to stars, by one large-star and one small-star step; and of each node
    comp, a node that it reaches, and other, the same if it has no second one. Both are written."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.greatest("v", "m").alias("x"), F.col("m").alias("v")).where("x <> v").select(F.col("x").alias("u"), "v")
    pairs = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("comp")))
    return pairs, scratch.save(ends.groupBy("node").agg(F.min("comp").alias("comp"), F.max("comp").alias("other")), f"{name}_nodes")


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b): a row (node, comp) for each node that has an edge, comp the smallest node it reaches.

    Alternates large-star and small-star steps, which keep the number of edges and end after few rounds at any size;
    nothing is gathered by group, only minima. It ends when the edges are stars: then no node has two values in the round's
    table of nodes, which is written and is the result.
    """
    k = 1
    while True:
        pairs, nodes = star_step(scratch, edges, f"{name}_{k}")
        scratch.drop(f"{name}_{k - 1}", f"{name}_{k - 1}_nodes")
        if nodes.where("comp <> other").isEmpty():
            return nodes.select("node", "comp")
        edges, k = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")), k + 1
