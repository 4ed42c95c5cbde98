"""Substring dedup, exact clusters and importance resampling against brute-force versions."""

import hashlib
import math
import random
from zlib import crc32

import numpy as np
import pytest

from loopwatch.llm import lloyd, resampling, substrings

DOCS = "doc_id long, text string, row string, lo int, rank string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def texts(seed=3):
    """Copies, shared passages at several places, periodic texts, characters of several bytes, nulls and repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(20, 90)) for _ in range(8)]
    shared = prose(rng, 25)
    out = []
    for i in range(40):
        t = rng.choice(base)
        if i % 3 == 0:
            at = rng.randrange(len(t))
            t = t[:at] + shared[: rng.randrange(95, len(shared))] + t[at:]
        if i % 4 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        out.append((i, t))
    out += [(50, None), (51, ""), (52, "short"), (53, "a" * 99), (54, "a" * 100), (55, "a" * 250), (56, "ab" * 300), (57, "abc " * 100), (58, "ä" * 120), (59, "ä" * 49 + "b"), (60, "日本語" * 40)]
    out += [(61, base[0]), (61, base[0]), (61, base[1]), (None, base[2]), (None, base[2]), (None, None), (62, shared[:99]), (63, shared[:100]), (64, shared + shared), (-5, base[3])]
    return out


def rows_of(spark, pairs, n=5):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in pairs], DOCS).repartition(n)


def removed(pairs, length):
    """For each distinct (doc_id, text): the runs of bytes that strings which start earlier cover."""
    seen, out = set(), {}
    for key in sorted(set(pairs), key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        data = (key[1] or "").encode()
        later = [i for i in range(len(data) - length + 1) if data[i : i + length] in seen or seen.add(data[i : i + length])]
        spans = []
        for i in later:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + length
            else:
                spans.append([i, i + length])
        out[key] = spans
    return out


@pytest.mark.parametrize(("length", "q", "n"), [(100, 32, 5), (100, 32, 1), (20, 8, 3), (9, 9, 2), (12, 3, 4)])
def test_substrings(spark, length, q, n):
    # rows with one doc_id and several texts are ordered by the texts' hashes, which the brute force doesn't know
    pairs = [p for p in texts() if p != (61, dict(enumerate(texts())).get(52, (0, ""))[1])]
    pairs = [p for k, p in enumerate(pairs) if not (p[0] in (61, None) and any(o[0] == p[0] and o[1] != p[1] for o in pairs[:k]))]
    want = removed(pairs, length)
    out = substrings.dedup(spark, rows_of(spark, pairs, n), length, q)
    assert out.columns == ["doc_id", "text", "row", "lo", "rank", "n_bytes", "spans", "kept"]
    got = out.collect()
    assert len(got) == len(pairs)
    for r in got:
        data, spans = (r.text or "").encode(), want[r.doc_id, r.text]
        assert [[s.start, s.end] for s in r.spans] == spans, (r.doc_id, spans)
        kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(a for a, _ in spans), len(data)], strict=True))
        assert bytes(r.kept) == kept and r.n_bytes == len(data) and (r.row, r.lo, r.rank) == ("x", 1, "y")


def test_substrings_of_one_id(spark):
    """Rows of one doc_id and other texts are other documents: exactly one copy of what they share stays."""
    t = prose(random.Random(5), 40)
    got = substrings.dedup(spark, rows_of(spark, [(1, t), (1, t + " end"), (1, t)])).collect()
    assert len(got) == 3
    left = {r.text: len(r.kept) for r in got}
    assert sorted(left.values()) in ([0, len(t) + 4], sorted([len(t), 4 if len(t + " end") - len(t) == 4 else 0]))
    assert len({bytes(r.kept) for r in got if r.text == t}) == 1


def test_substrings_empty(spark):
    assert substrings.dedup(spark, rows_of(spark, [(1, "x")]).where("false")).collect() == []


def test_substrings_large_group(spark):
    """A passage in very many texts and many copies of one text."""
    rng = random.Random(9)
    shared = prose(rng, 30)
    pairs = [(i, prose(rng, 12) + " " + shared + " " + prose(rng, 12)) for i in range(300)] + [(1000 + i, prose(random.Random(2), 60)) for i in range(200)]
    want = removed(pairs, 100)
    for r in substrings.dedup(spark, rows_of(spark, pairs)).collect():
        assert [[s.start, s.end] for s in r.spans] == want[r.doc_id, r.text]


def lloyd_plain(rows, k, rounds, seed):
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(r[1]) for r in rows[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            cents[j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in rows), cents


@pytest.mark.parametrize(("dim", "k", "n"), [(3, 7, 400), (8, 1, 50), (16, 40, 600), (2, 40, 25)])
def test_clusters(spark, dim, k, n):
    rng = np.random.default_rng(dim)
    v = (rng.normal(size=(n, dim)) + rng.integers(-2, 3, size=(n, 1))).astype(np.float32)
    v[n // 2 : n // 2 + n // 4] = v[0]  # a large group of equal vectors, and ties
    v = np.round(v * 4) / 4 if dim == 3 else v
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[0][1]), (900, None), (901, []), (902, rows[0][1][:-1]), (903, [None] + rows[0][1][1:]), (904, [float("nan")] + rows[0][1][1:]), (905, [float("-inf")] + rows[0][1][1:])]
    df = spark.createDataFrame([(i, x, "other") for i, x in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    got = lloyd.cluster(spark, df, k=k, dim=dim, seed=2).collect()
    kept = [(i, tuple(math.floor(256 * float(c)) for c in np.array(x, np.float32))) for i, x in rows if i is not None and x and len(x) == dim and all(c is not None and math.isfinite(c) for c in x)]
    want, cents = lloyd_plain(kept, k, 5, 2)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == want
    total = {}
    for _, c, d in want:
        total[c] = total.get(c, 0) + d
    assert all(r.cluster_inertia == total[r.cluster] and r.inertia == sum(total.values()) and r.centroid == cents[r.cluster] for r in got)


def test_clusters_empty(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert lloyd.cluster(spark, df, dim=64).collect() == []
    assert lloyd.cluster(spark, df.where("false"), dim=1).collect() == []


def test_large_components(spark):
    far = [(1, [float(1 << 30)] * 2), (2, [float(-(1 << 15))] * 2)]
    got = lloyd.cluster(spark, spark.createDataFrame(far[1:] + [(3, [3e6, -3e6])], "vec_id long, embedding array<double>"), k=1, dim=2, rounds=1).collect()
    rows = [(2, (-(1 << 23),) * 2), (3, (768_000_000, -768_000_000))]
    with pytest.raises(Exception, match="64 bits"):
        lloyd.cluster(spark, spark.createDataFrame(far, "vec_id long, embedding array<double>"), k=2, dim=2, scale=65536.0).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == lloyd_plain(rows, 1, 1, 2)[0]


def test_trees_prune_and_cover():
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(1000, 8)) * 5 + rng.integers(-9, 10, size=(1, 8)) + 200 * rng.integers(0, 6, size=(1000, 1))).astype(np.int64)
    order, tree = lloyd.cover_tree(rows)
    rows = rows[order]
    assert sorted(order) == list(range(1000)) and len(tree.centre) > 6
    for i in range(len(tree.centre)):
        assert lloyd.distances(rows[tree.lo[i] : tree.hi[i]], rows[tree.centre[i]]).max() <= tree.radius[i] + 1e-9
        kids = range(tree.child[i], tree.child[i] + tree.n_children[i])
        assert not kids or sorted((tree.lo[c], tree.hi[c]) for c in kids)[0][0] == tree.lo[i] and sum(tree.hi[c] - tree.lo[c] for c in kids) == tree.hi[i] - tree.lo[i]
    cents = rows[rng.choice(1000, 40, replace=False)]
    c_order, over = lloyd.cover_tree(cents, 2, 1)
    cluster, dist, n_exact = lloyd.assign(rows, tree, cents, c_order, over)
    full = lloyd.squared(rows, cents)
    assert (cluster == full.argmin(1)).all() and (dist == full.min(1)).all() and n_exact < full.size / 2


def resample_plain(docs, target, buckets, orders, seed, percent, least):
    def features(t):
        w = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (t or "")).encode().lower().split(b" ")
        w = [x for x in w if x]
        return w, [crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, x in docs:
        for b in features(x)[1]:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log(float((t[b] + 1) * (sum(s) + buckets)) / float((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        w, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(w)])
    fit = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("orders", [2, 1, 3, 5])
def test_resampling(spark, orders):
    docs = [(i, (t or "").upper() + " É1 x-y" if i and i % 2 else t) for i, t in texts()] + [(70, "word " * 3000), (71, "x" * 500 + " y " + "x" * 500), (72, "z"), (73, "-- z .."), (74, "")]
    target = [prose(random.Random(8), 50), None, "", "changed ab", dict(texts())[3]]
    want = resample_plain(docs, target, 500, orders, 7, 40, 10)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    run = resampling.resample(spark, rows_of(spark, docs), bench, ("doc_id", "row", "rank"), buckets=500, orders=orders, percent=40, min_words=10)
    assert run.columns == ["doc_id", "row", "n_words", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = run.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_pieces_and_long_words():
    import pyarrow as pa

    rng = random.Random(4)
    rows = [None, "", "  ", "a b a b a", prose(rng, 200), "q" * 300 + " b " + "q" * 47 + " " + "q" * 48 + " " + "q" * 49, "end", "A\u00c9 b"]
    w = resampling.words(pa.array([None if r is None else r.encode() for r in rows], pa.binary()))
    plain = [bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or bytes([c]).isalnum() else 32 for c in (r or "").encode()).split() for r in rows]
    assert [bytes(w.bytes[a:b]) for a, b in zip(w.starts, w.ends, strict=True)] == [x for p in plain for x in p]
    assert np.diff(w.first).tolist() == [len(p) for p in plain]
    for depth, (at, node, crc) in enumerate(resampling.trie(w, 3), 1):
        want = [crc32(b" ".join(p[i : i + depth])) for p in plain for i in range(len(p) - depth + 1)]
        assert crc[node].tolist() == want and len(crc) == len({tuple(p[i : i + depth]) for p in plain for i in range(len(p) - depth + 1)}) and len(at) == len(want)


def test_resampling_empty(spark):
    docs = rows_of(spark, [(1, "one two"), (2, None)])
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(spark, docs.where("false"), none).collect() == []
    got = resampling.resample(spark, docs, none).collect()
    assert sorted((r.doc_id, r.n_features, r.rank) for r in got) == [(1, 3, None), (2, 0, None)]
    assert all(r.weight == 0 or r.doc_id == 1 for r in got)
