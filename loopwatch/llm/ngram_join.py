"""Exact Jaccard join of documents on word shingles, and the groups its links form.

Prefix filtering with rare shingles first; length, positional and suffix filters; each candidate pair verified once.

1. `shingle_counts` reduces every text to its number of distinct shingles and a 64-bit name of its shingle set. Texts with
   one set are one node from here on, so exact copies never meet as pairs.
2. `survivors` drops the nodes that can't reach the threshold with anybody: if overlap(x, y) >= a, then the first
   n - a + l shingles of x and y in any common order (here: by hash) share l. Only those travel, packed.
3. For the rest, document frequencies order shingles rare first, and a node posts its first n - a + 1.
4. Candidates are made in rounds. In each posting list some nodes are pivots, and only pairs of a pivot and a node of another
   component are verified; then the components are merged and used pivots leave the lists, as do lists that lie within one
   component. Rounds merge them by one step only (round 0: each node takes the least of itself and its neighbours, lists
   stay), and the steps go on to the end once no list is left. So no link between two components is lost and a list of k
   near copies costs k pairs.

Every text counts, whole. Null and empty texts, and texts of white space, have no shingles and no links. Rows with a null
doc_id link like others; a component gets a null component_id only if none of its rows has an id. Repeated rows are copies
like others. A node's text is read again by its first row's doc_id and text hash. Extra columns are ignored. Two sets of n and m
shingles are compared by 64-bit hashes: a wrong verdict needs two different shingles of one pair with equal hashes, and a wrong
name needs two sets with equal 64-bit sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwatch.llm import common
from loopwatch.llm.textarrays import mix, pieces, shingle_sets, words

WIDTH, PERCENT = 5, 80
_U64, _I64 = np.uint64, np.int64


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent / 100 * n): a set of n shares so many with any partner."""
    return (n * percent + 99) // 100


def _extra(n: np.ndarray) -> np.ndarray:
    """By how many a hash-ordered prefix is longer than need be for one common shingle, plus one; never falls as n grows."""
    return np.maximum(1, n // 10)


def _name(s: np.ndarray) -> int:
    return int(mix(s ^ _U64(0x2545F4914F6CDD1D)).sum(dtype=_U64).astype(_I64))


def _sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    texts = batch.column(column)
    for lo, hi in pieces(texts):
        yield lo, shingle_sets(words(texts.slice(lo, hi - lo), lower=True), width)


#: Stands for a null doc_id where rows are joined.
NO_ID = -(1 << 63)


def _texts(docs: DataFrame, *carry: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"), *carry)


def shingle_counts(docs: DataFrame, width: int = WIDTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, th (hash of the text), the columns in carry, n (distinct shingles) and node (name of the set) of every row."""
    rows = _texts(docs, *carry)
    own = ["doc_id", "th", *carry]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own)

    def run(batches):
        for b in batches:
            n, node = [], []
            for _, sets in _sets(b, 2, width):
                n += [len(s) for s in sets]
                node += [_name(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *b.columns[3:], pa.array(n, pa.int64()), pa.array(node, pa.int64())], names=[*own, "n", "node"])

    return rows.mapInArrow(run, kinds + ", n long, node long")


def _survivors(docs: DataFrame, sizes: DataFrame, width: int, percent: int, keys: list[int]) -> DataFrame:
    """Nodes whose hash-ordered prefix shares enough shingles with other nodes."""

    def post(batches):
        packer = common.Packer(keys, ["u8", "i8"])
        for b in batches:
            for _, sets in _sets(b, 0, width):
                hashes, nodes = [], []
                for s in sets:
                    if len(s):
                        hashes.append(s[: len(s) - _least_overlap(len(s), percent) + _extra(len(s))])
                        nodes.append(np.full(len(hashes[-1]), _name(s), _I64))
                if hashes:
                    yield from packer.add(np.concatenate(hashes), np.concatenate(nodes))
        yield from packer.flush()

    def shared(rows):
        order = np.lexsort((rows["f1"], rows["f0"]))
        h, node = rows["f0"][order], rows["f1"][order]
        at = common.runs(h, node)
        h, node = h[at], node[at]
        at = common.runs(h)
        many = np.repeat(np.diff(np.append(at, len(h))) > 1, np.diff(np.append(at, len(h))))
        found, n = np.unique(node[many], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(_I64))], names=["node", "shared"])

    packed = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(post, common.PACKED)
    hits = common.exchange(packed, len(keys), ["u8", "i8"], shared, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))
    least = F.expr(f"greatest(1, ((n * {percent} + 99) div 100) div 10)")
    return sizes.join(hits, "node").where(F.col("shared") >= least).select("node", "n", "doc", "th")


def _prefixes(sets: DataFrame, percent: int, keys: list[int]) -> DataFrame:
    """Posting rows (h, node, n, pos): the shared shingles within each node's rare-first prefix and their places in the order."""
    fields = ["u8", "i8", "i4"]

    def post(batches):
        packer = common.Packer(keys, fields)
        for b in batches:
            for node, n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = np.frombuffer(blob.as_buffer(), _U64)
                yield from packer.add(s, np.full(len(s), node, _I64), np.full(len(s), n, np.int32))
        yield from packer.flush()

    def frequencies(rows):
        order = np.lexsort((rows["f1"], rows["f0"]))
        rows = rows[order]
        rows = rows[common.runs(rows["f0"], rows["f1"])]
        at = common.runs(rows["f0"])
        df = np.diff(np.append(at, len(rows)))
        df = np.repeat(df, df)
        keep = df > 1
        rows, df = rows[keep], df[keep]
        packer = common.Packer(keys, ["u8", "i8", "i4", "u8", "i8"])
        yield from packer.add(mix(rows["f1"].astype(_U64)), rows["f1"], rows["f2"], rows["f0"], df)
        yield from packer.flush()

    def first(rows):
        order = np.lexsort((rows["f3"], rows["f4"], rows["f1"]))
        rows = rows[order]
        at = common.runs(rows["f1"])
        size = np.diff(np.append(at, len(rows)))
        n = rows["f2"].astype(_I64)
        pos = np.arange(len(rows)) - np.repeat(at, size) + n - np.repeat(size, size)
        keep = pos <= n - _least_overlap(n, percent)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows["f3"][keep].view(_I64), rows["f1"][keep], n[keep], pos[keep])], names=["h", "node", "n", "pos"])

    counted = common.exchange(sets.mapInArrow(post, common.PACKED), len(keys), fields, frequencies, common.PACKED)
    return common.exchange(counted, len(keys), ["u8", "i8", "i4", "u8", "i8"], first, "h long, node long, n long, pos long")


def _suffix_distance(x: np.ndarray, y: np.ndarray) -> int:
    """No more than the number of hashes in just one of the sets: sums of differences over 64 ranges of hashes."""
    a, b = (np.bincount((s >> _U64(58)).astype(_I64), minlength=64) for s in (x, y))
    return int(np.abs(a - b).sum())


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, with their overlap."""

    def run(batches):
        for b in batches:
            out = []
            for p, q, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U64), np.frombuffer(y.as_buffer(), _U64)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                if _suffix_distance(x, y) > len(x) + len(y) - 2 * need:
                    continue
                both = np.sort(np.concatenate((x, y)), kind="stable")
                if (n := int((both[1:] == both[:-1]).sum())) >= need:
                    out.append((p, q, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "overlap"])

    left, right = (sets.select(F.col("node").alias(k), F.col("tokens").alias(f"tokens_{k}")) for k in "ab")
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "tokens_a", "tokens_b")
    return both.mapInArrow(run, "a long, b long, overlap long")


#: Lists of so many nodes at most are compared whole in round 1; longer ones have about 16**k pivots in round k.
SMALL_LIST = 32


def linked_nodes(spark: SparkSession, docs: DataFrame, counts: DataFrame, scratch: common.Scratch, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame | None, DataFrame | None]:
    """(node, comp) of every node with a link, and the verified links (a, b, overlap); None where no pair is a candidate."""
    keys = common.partition_keys(spark, common.n_partitions(spark))
    key = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "th")
    sizes = counts.where("n > 0").groupBy("node").agg(F.min(key).alias("key"), F.max("n").alias("n")).select("node", "n", "key.*")
    alive = scratch.save(_survivors(docs, sizes, width, percent, keys), "alive")

    def tokens(batches):
        seen = set()  # equal rows meet in one task, and one of them is enough
        for b in batches:
            for lo, sets in _sets(b, 1, width):
                here = []
                for node, s in zip(b.column(0).slice(lo, len(sets)).to_pylist(), sets, strict=True):
                    if node not in seen and _name(s) == node:
                        seen.add(node)
                        here.append((node, len(s), s.tobytes()))
                if here:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*here, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["node", "n", "tokens"])

    rows = _texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "th", "text")
    texts = rows.join(alive.select("doc", "th", "node").hint("merge"), ["doc", "th"]).select("node", "text")
    sets = scratch.save(texts.mapInArrow(tokens, "node long, n long, tokens binary"), "sets")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    lists = scratch.save(_prefixes(sets, percent, keys).withColumn("band", band), "lists_0")
    sets = sets.select("node", "tokens")
    comps, links, stars, tried, k = None, None, None, None, 0
    while True:
        if k == 0:
            live = lists.withColumn("comp", F.col("node"))
            pivots = live.groupBy("h", "band").agg(F.min(F.struct("node", "n", "pos", "comp")).alias("p")).select("h", "band", "p.*")
        else:
            named = lists.withColumn("comp", F.col("node")) if comps is None else lists.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            open_lists = named.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
            if k == 1:  # two nodes of one list have met in round 0
                open_lists = open_lists.where("size > 2")
            live = scratch.save(named.join(open_lists.select("h", "size"), "h"), f"live_{k}")
            scratch.drop("lists_0" if k == 1 else f"live_{k - 1}")
            # by one order of all nodes, so that lists with much the same nodes have the same pivots
            turn = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
            chosen = (F.col("size") <= SMALL_LIST) | (turn * F.col("size") < 16.0**k * (1 << 30))
            pivots = live.where(chosen).select("h", "band", "node", "n", "pos", "comp")
            # pivots have met all others of their list
            lists = live.where(~chosen).select("h", "node", "n", "pos", "band")
        near = pivots.select("h", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), *(F.col(c).alias(f"p_{c}") for c in ("node", "n", "pos", "comp")))
        need = F.expr(f"({percent} * (n + p_n) + {99 + percent}) div {100 + percent}")
        meets = (
            (F.col("comp") != F.col("p_comp"))
            & (100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n"))
            & (F.least(F.col("n") - F.col("pos"), F.col("p_n") - F.col("p_pos")) >= need)
        )
        found = live.join(near, ["h", "band"]).where(meets).select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
        if tried is not None:
            found = found.join(tried, ["a", "b"], "left_anti")
        found = scratch.save(found, f"pairs_{k}")
        new = scratch.save(_verify(found, sets, percent), f"links_{k}")
        tried = found if tried is None else tried.unionByName(found)
        any_new = not new.isEmpty()
        links = new if links is None else links.unionByName(new)
        more = not lists.isEmpty()
        if any_new:
            stars = new.select("a", "b") if stars is None else stars.unionByName(new.select("a", "b"))
        if k == 0 and any_new:
            # the least of a node and its neighbours is in its component; that is enough to leave out most pairs of round 1
            ends = new.select(F.col("a").alias("node"), F.col("a").alias("comp")).unionByName(new.select(F.col("b").alias("node"), F.col("a").alias("comp")))
            comps = scratch.save(ends.groupBy("node").agg(F.min("comp").alias("comp")), "comps_0")
        elif any_new:
            stars, comps = common.star_step(scratch, stars, f"stars_{k}")
            stars, comps = stars.select(F.col("u").alias("a"), F.col("v").alias("b")), comps.select("node", "comp")
        if not more:
            break
        k += 1
    if k:
        scratch.drop(f"live_{k}")
    return stars if stars is None else common.components(scratch, stars, "comps"), links


def row_components(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, carry: tuple[str, ...] = (), scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, th, the columns in carry, n, node and comp (name of its component; rows without shingles have none) of every row."""
    scratch = scratch or common.Scratch(spark)
    counts = scratch.save(shingle_counts(docs, width, carry), "counts")
    comps, _ = linked_nodes(spark, docs, counts, scratch, width, percent)
    if comps is None:
        return counts.withColumn("comp", F.when(F.col("n") > 0, F.col("node")))
    return counts.join(comps, "node", "left").withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "node")))


def link_components(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach, the row's own included) of every row."""
    scratch = common.Scratch(spark)
    own = row_components(spark, docs, width, percent, scratch=scratch)
    # minima combine before the exchange. Both are written, so that a node or component with a third of the rows meets a plain
    # table and its rows can be split over tasks
    nodes = scratch.save(own.where("n > 0").groupBy("node", "comp").agg(F.min("doc_id").alias("first")), "nodes")
    least = scratch.save(nodes.groupBy("comp").agg(F.min("first").alias("component_id")), "least")
    ids = scratch.save(nodes.join(least, "comp").select("node", "component_id"), "ids")
    counts = spark.read.parquet(scratch.path("counts")).select("doc_id", "n", "node")
    out = counts.where("n > 0").join(ids, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    # without shingles there is no set to share: such a row is its own component
    return out.unionByName(counts.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
