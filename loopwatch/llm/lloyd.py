"""Exact Lloyd rounds over integer vectors, by cover trees over the vectors and over the centroids.

Components become floor(scale * x). Vectors are written once in blocks; a block holds a cover tree over its vectors, which stand
in the tree's order: a node has a centre (one of its vectors), a radius, a range of vectors and children, whose centres lie
within half the radius of it; vectors that no group of some size could be formed for stay in a leaf of the node. In each round
every task builds a cover tree over the centroids and descends both trees together. Of the centroid nodes that a vector node
meets, those go that lie farther from all its vectors than another centroid does, by the distances of centres and the radii.
Where one centroid is left, it takes the vectors unseen; pairs of leaves are compared exactly, ties to the smaller number. A
task returns a sum and a count for each centroid; the new centroids are exact floored means.

Distances are whole numbers: in doubles where all intermediate values stay below 2**53, else in 64-bit integers; values beyond
those raise OverflowError. Bounds leave room for rounding, so they never decide a tie.

The first centroids are the vectors with the smallest SHA-256 of `seed:vec_id`, ties (repeated ids) to the smaller vector. Rows
without vec_id, with another number of components, or with one that is null or not finite take no part. Repeated rows count
each. With fewer vectors than centroids there are as many centroids as vectors; an empty table gives no rows. Other columns are
ignored. Centroids and their sums pass through the driver: k times dim numbers, both parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwatch.llm import common

K, ROUNDS, SEED, DIM, SCALE = 40, 5, 2, 64, 256.0
#: Vectors in a block, the most in a leaf that is split no further, and the fewest that form a child node.
BLOCK, LEAF, LEAST = 1024, 32, 8
CENTROID_LEAF = 2
#: Relative room for rounding in distances that bound.
SLACK = 1e-9
TREE = "ids array<long>, parts array<long>, centre array<int>, radius array<double>, lo array<int>, hi array<int>, child array<int>, n_children array<int>"


class Tree:
    """A cover tree: node i has centre[i] (a place in the tree's order), radius[i], places lo[i]:hi[i] and the n_children[i]
    nodes from child[i] on, none for a leaf."""

    def __init__(self, centre, radius, lo, hi, child, n_children):
        self.centre, self.radius, self.lo, self.hi, self.child, self.n_children = centre, radius, lo, hi, child, n_children


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = rows.astype(np.float64) - point
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def cover_tree(rows: np.ndarray, leaf: int = LEAF, least: int = LEAST) -> tuple[np.ndarray, Tree]:
    """The order of rows in the tree and the tree. Children lie within half their parent's radius around their own centres; rows
    that fewer than `least` others join there stay in one leaf around the parent's centre."""
    order = np.empty(len(rows), np.int64)
    nodes: list[list] = [[0, 0.0, 0, len(rows), 0, 0]]
    todo = [(0, np.arange(len(rows)), distances(rows, rows[0]), 0)]
    while todo:
        k, own, far, lo = todo.pop()  # own[0] is the centre
        radius = float(far.max())
        order[lo : lo + len(own)] = own
        nodes[k][:4] = [int(own[0]), radius, lo, lo + len(own)]
        if len(own) <= leaf or radius == 0:
            continue
        limit, groups, rest = radius / 2, [], []
        left, left_far = own, far
        while len(left):
            near = left_far <= limit
            group = (left[near], left_far[near])
            if len(group[0]) >= least or not groups and len(left) == len(own):
                groups.append(group)
            else:
                rest.append(group[0])
            left = left[~near]
            if len(left):
                left_far = distances(rows[left], rows[left[0]])
        if rest:
            if len(groups[0][0]) < least:  # the centre's own group goes with them
                rest.append(groups.pop(0)[0])
            if not groups:
                continue
            rest = np.concatenate(rest)
        nodes[k][4:] = [len(nodes), len(groups) + bool(len(rest))]
        at = lo
        for ids, dist in groups:
            todo.append((len(nodes), ids, dist, at))
            nodes.append([0, 0.0, 0, 0, 0, 0])
            at += len(ids)
        if len(rest):
            order[at : at + len(rest)] = rest
            nodes.append([int(own[0]), float(distances(rows[rest], rows[own[0]]).max()), at, at + len(rest), 0, 0])
    centre, *others = (np.array(x) for x in zip(*nodes, strict=True))
    where = np.empty(len(rows), np.int64)
    where[order] = np.arange(len(rows))
    return order, Tree(where[centre], *others)


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows to int64 centroids."""
    top = max(max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (rows, centroids))
    most = rows.shape[1] * (2 * top) ** 2
    if most < 1 << 53:
        a, b = rows.astype(np.float64), centroids.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)[None, :]).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("a squared distance goes beyond 64 bits")
    return np.stack([((rows - c) ** 2).sum(1) for c in centroids], axis=1)


def assign(rows: np.ndarray, tree: Tree, centroids: np.ndarray, order: np.ndarray, over: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row, its squared distance, and how many distances to rows were computed. order, over: the
    centroids' tree."""
    cluster, dist = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    points = centroids[order].astype(np.float64)
    n_exact = 0
    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        k, against = todo.pop()
        centre, radius = rows[tree.centre[k]].astype(np.float64), tree.radius[k]
        leaf = tree.n_children[k] == 0
        while True:
            gap = points[over.centre[against]] - centre
            far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            slack = SLACK * (far.max() + radius + over.radius[against].max() + 1)
            # a node's centre is a centroid, so some centroid is as near as this to each of the rows
            reach = far.min() + radius + slack
            against = against[far - radius - over.radius[against] <= reach]
            split = (over.n_children[against] > 0) & (leaf | (over.radius[against] >= radius))
            if not split.any():
                break
            finer = [np.arange(over.child[c], over.child[c] + over.n_children[c]) for c in against[split]]
            against = np.concatenate((against[~split], *finer))
        lo, hi = tree.lo[k], tree.hi[k]
        few = np.concatenate([order[over.lo[c] : over.hi[c]] for c in against]) if leaf or len(against) == 1 else None
        if few is not None and (leaf or len(few) == 1):
            few = np.sort(few)
            d = squared(rows[lo:hi], centroids[few])
            n_exact += d.size
            best = d.argmin(1)  # the first of equal ones, which has the smallest number
            cluster[lo:hi], dist[lo:hi] = few[best], d[np.arange(hi - lo), best]
        else:
            todo += [(c, against) for c in range(tree.child[k], tree.child[k] + tree.n_children[k])]
    return cluster, dist, n_exact


def blocks(usable: DataFrame, dim: int) -> DataFrame:
    """vec_id and parts (array of long), in blocks with their trees."""

    def packed(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        order, t = cover_tree(rows)
        values = [ids[order], rows[order].ravel(), t.centre.astype(np.int32), t.radius.astype(np.float64), *(x.astype(np.int32) for x in (t.lo, t.hi, t.child, t.n_children))]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["ids", "parts", "centre", "radius", "lo", "hi", "child", "n_children"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
        for b in batches:
            ids = np.concatenate((ids, b.column(0).to_numpy()))
            rows = np.concatenate((rows, b.column(1).flatten().to_numpy().reshape(-1, dim)))
            while len(ids) >= BLOCK:
                yield packed(ids[:BLOCK], rows[:BLOCK])
                ids, rows = ids[BLOCK:], rows[BLOCK:]
        if len(ids):
            yield packed(ids, rows)

    return usable.mapInArrow(run, TREE)


def _unpacked(b: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, Tree]]:
    for i in range(b.num_rows):
        ids, parts, *tree = (b.column(k)[i].values.to_numpy() for k in range(b.num_columns))
        yield ids, parts.reshape(-1, dim), Tree(*tree)


def _sums(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, parts (summed components) and n: one row for each task and centroid that has vectors."""
    k, dim = centroids.shape

    def run(batches):
        order, over = cover_tree(centroids, CENTROID_LEAF, 1)
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for _, rows, tree in _unpacked(b, dim):
                cluster, _, _ = assign(rows, tree, centroids, order, over)
                for c in np.unique(cluster):
                    total[c] += rows[cluster == c].sum(0)
                count += np.bincount(cluster, minlength=k)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.int64())), pa.array(count[at])], names=["cluster", "parts", "n"])

    return packed.mapInArrow(run, "cluster int, parts array<long>, n long")


def _assigned(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]

    def run(batches):
        order, over = cover_tree(centroids, CENTROID_LEAF, 1)
        for b in batches:
            for ids, rows, tree in _unpacked(b, dim):
                cluster, dist, _ = assign(rows, tree, centroids, order, over)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cluster.astype(np.int32)), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    return packed.mapInArrow(run, "vec_id long, cluster int, distance long")


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """vec_id and parts of the rows that take part."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") == dim) & fit, F.lit(False)))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale)).alias("parts"))


def cluster(spark: SparkSession, vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid of each row of vectors (vec_id, embedding)."""
    scratch = common.Scratch(spark)
    usable = integer_vectors(vectors, dim, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = usable.orderBy(key, "parts").limit(k).select("parts").collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["parts"] for r in first], np.int64)
    packed = scratch.save(blocks(usable, dim), "blocks")
    for _ in range(rounds):
        parts = _sums(packed, centroids).select("cluster", "n", F.posexplode("parts").alias("j", "s"))
        found = parts.groupBy("cluster", "j").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.sum("n").alias("n")).collect()
        centroids = centroids.copy()
        for r in found:
            centroids[r["cluster"], r["j"]] = int(r["s"]) // r["n"]
    done = scratch.save(_assigned(packed, centroids), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    # one row for each centroid
    about = spark.createDataFrame([(c, s, sum(inertia.values()), centroids[c].tolist()) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
