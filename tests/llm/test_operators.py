"""The corpus operators against brute-force versions on small tables with nulls, empty texts, repeats and extra columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loopwatch.llm import common, langid, licenses, line_runs, mixing, ngram_join, passages, quality, topk, warc
from loopwatch.llm import sentencepiece_codec as spc

DOCS = "doc_id long, text string, lang string, source string, node string, n long"


def word(rng):
    return "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 6)))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [" ".join(word(rng) for _ in range(rng.randrange(30, 120))) for _ in range(12)]
    out = []
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = word(rng)
        out.append((i, " ".join(w)))
    out += [(60, ""), (61, None), (62, " \n\t"), (63, "one two"), (64, "One  TWO"), (65, base[0].upper()), (66, base[0]), (66, base[0]), (67, "x " * 3000), (68, "É é"), (None, base[1])]
    return [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}" if i != 5 else None, "clash", 7) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_join_components(spark, docs):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    want = Counter((d, len(s), min((x for x in ids[find(i)] if x is not None), default=None)) for i, (d, s) in enumerate(rows))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_components(spark, docs).collect())
    assert got == want
    assert len({c for *_, c in want}) < 60  # some link


def test_join_links_through_rows_without_id(spark):
    w = [f"q{i}" for i in range(60)]
    rows = [(1, " ".join(w[:54])), (None, " ".join(w[3:57])), (2, " ".join(w[6:]))]
    got = ngram_join.link_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (2, 1)]


def test_components_end_with_stars(spark):
    rng = random.Random(4)
    scratch, saved = common.Scratch(spark), []
    save = scratch.save
    scratch.save = lambda df, name: saved.append(name) or save(df, name)
    star = [(i, 7) for i in range(8, 90)] + [(7, 3), (3, 3)]
    got = common.components(scratch, spark.createDataFrame(star, "a long, b long"), "star").collect()
    assert sorted(map(tuple, got)) == [(i, 3) for i in [3, *range(7, 90)]]
    assert len(saved) <= 2  # one round, its edges and its nodes: no further one that changes nothing
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert sorted(map(tuple, common.components(scratch, spark.createDataFrame(edges, "a long, b long"), "mixed").collect())) == sorted(least.items())


def test_join_empty(spark, docs):
    assert ngram_join.link_components(spark, docs.limit(0)).count() == 0
    assert ngram_join.link_components(spark, docs.where("text is null")).collect()[0].n_shingles == 0


def test_passages_found(spark):
    rng = random.Random(5)
    text = lambda n: [word(rng) + word(rng) for _ in range(n)]
    shared, near = text(60), text(80)
    changed = [*near[:40], "other", *near[41:]]
    rows = [(1, text(100) + shared + text(50)), (2, shared + text(30)), (3, text(200)), (4, text(20) + near), (5, changed + text(70)), (6, text(10) + shared)]
    df = spark.createDataFrame([(i, " ".join(w), 1) for i, w in rows] + [(7, None, 1), (8, "", 1), (None, " ".join(shared), 1)], "doc_id long, text string, tokens int")
    spans = passages.near_repeats(spark, df)
    got = {(r.doc_id, r.ref_id): (r.first_word, r.last_word, r.ref_first) for r in spans.collect()}
    assert got[2, 1] == (0, 59, 100) and (6, 1) in got and (5, 4) in got
    assert got[5, 4][0] <= 2 and got[5, 4][1] >= 77
    assert not {3, 7, 8} & {d for d, _ in got}
    assert {r.doc_id for r in passages.repeated_words(spans).collect()} == {2, 5, 6}
    assert passages.near_repeats(spark, df.limit(0)).count() == 0


def window_minima(words):
    """For each hash function the places of the shingles that stand for a window, and their values."""
    shingles, doc = passages._text_shingles(pa.array([" ".join(words).encode()]))
    out = []
    for j in range(passages.HASHES):
        values = passages.mix(shingles + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1))
        at = passages.compact_windows(values, doc, 46)[1]
        out.append({int(values[c]): int(c) for c in at})
    return out


def test_passages_meet_behind_a_common_leader(spark):
    rng = random.Random(11)
    text = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n)]
    while True:
        shared = text(50)
        own = window_minima(shared)
        leader = text(30)
        for m in own:
            (c,) = m.values()
            leader += shared[c : c + 5] + text(30)
        if all(set(m) <= set(x) for m, x in zip(own, window_minima(leader), strict=True)):
            break
    rows = [(i, " ".join(w)) for i, w in ((1, leader), (2, shared), (3, shared))]
    got = passages.near_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.ref_id, r.first_word, r.last_word) for r in got] == [(3, 2, 0, 49)]


def test_passages_link_classes_whose_windows_are_covered(spark):
    """Two texts share a passage, all of which lies in passages that each shares with texts of its own. Behind a leader that holds the
    passage's minima and not the passage, they must still meet."""
    rng = random.Random(23)
    text = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n)]
    shared = text(50)
    a, b = (text(40) + shared + text(40) for _ in range(2))
    common = [[set(x) & set(y), x] for x, y in zip(window_minima(a), window_minima(b), strict=True)]
    while True:
        leader = text(30)
        for keys, at in common:
            for k in keys:
                leader += a[at[k] : at[k] + 5] + text(30)
        if all(keys <= set(x) for (keys, _), x in zip(common, window_minima(leader), strict=True)):
            break
    parts = [leader, a[:70], a[60:], a, b[:70], b[60:], b]
    got = passages.near_repeats(spark, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(parts, 1)], "doc_id long, text string")).collect()
    pairs = {(r.doc_id, r.ref_id) for r in got}
    assert {(4, 2), (4, 3), (7, 5), (7, 6)} <= pairs
    assert pairs & {(7, 2), (7, 3), (7, 4), (5, 2), (5, 4), (6, 3), (6, 4)} == {(7, 4)}
    assert [(r.first_word, r.last_word, r.ref_first, r.ref_last) for r in got if (r.doc_id, r.ref_id) == (7, 4)] == [(40, 89, 40, 89)]


def test_passage_with_one_common_function(spark):
    rng = random.Random(21)
    text = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n)]
    while True:
        old = text(50)
        new = [*old[:25], *text(1), *old[26:]]  # Jaccard 41 / 51
        if sum(set(a) == set(b) for a, b in zip(window_minima(old), window_minima(new), strict=True)) == 1:
            break
    got = passages.near_repeats(spark, spark.createDataFrame([(1, " ".join(old)), (2, " ".join(new))], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.ref_id, r.first_word, r.last_word, r.similarity) for r in got] == [(2, 1, 0, 49, 41 / 51)]


def test_passage_spans_an_insertion():
    old, put = list(range(1, 96)), list(range(901, 914))
    x, y = (np.array([hash(tuple(w[i : i + 5])) & 0xFFFFFFFF for i in range(len(w) - 4)], np.uint32) for w in (old, old[:47] + put + old[47:]))
    windows = np.array([[0, 10, 90, 0, 10, 103, 0], [0, 60, 90, 0, 73, 103, 1]])
    ((*span, similarity),) = passages.verified(1, 2, x, y, windows)
    assert span == [2, 0, 107, 1, 0, 94] and similarity == 87 / 108


def test_passage_on_one_of_many_diagonals():
    rng = random.Random(3)
    base = [rng.randrange(1 << 32) for _ in range(60)]
    near = [rng.randrange(1 << 32) if i in (12, 25, 38, 51) else v for i, v in enumerate(base)]
    x = np.array([v for k in range(7) for v in (*(rng.randrange(1 << 32) for _ in range(40)), *base)], np.uint32)
    y = np.array(near, np.uint32)
    windows = np.array([[100 * k + 40, 100 * k + 40 + c, 100 * k + 99, 0, c, 59, j] for j, c in ((0, 5), (1, 30)) for k in range(7)])
    found = passages.verified(1, 2, x, y, windows)
    assert [(r[1], r[2]) for r in found] == [(0, 63)] and found[0][6] == 56 / 64


def test_passages_recall_and_partitions(spark):
    """Planted near copies among texts that all share one line: found, whatever the partitions, and nothing else is."""
    rng = random.Random(17)
    text = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]
    line = text(14)
    rows, planted = [], []
    for i in range(40):
        old = text(rng.randrange(50, 80))
        new = list(old)
        new[rng.randrange(10, 40)] = "changed"
        a = {tuple(old[k : k + 5]) for k in range(len(old) - 4)}
        b = {tuple(new[k : k + 5]) for k in range(len(new) - 4)}
        assert len(a & b) / len(a | b) >= 0.8
        for d, p in ((2 * i, old), (2 * i + 1, new)):
            w = text(rng.randrange(5, 60)) + p + text(rng.randrange(5, 30)) + line + text(rng.randrange(5, 30))
            rows.append((d, " ".join(w)))
        planted.append((2 * i + 1, 2 * i))
    rows += [(100 + i, " ".join(text(40) + line + text(40))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(tuple(r) for r in passages.near_repeats(spark, df.repartition(n)).collect()) for n in (1, 5)]
    assert found[0] == found[1]
    pairs = {(r[0], r[3]) for r in found[0]}
    assert len(pairs & set(planted)) >= 0.95 * len(planted) and not pairs - set(planted)


def test_sentencepiece_matches_library(spark):
    import sentencepiece

    sp, m = sentencepiece.SentencePieceProcessor(model_file=spc.DEFAULT_MODEL), spc.Model(spc.read_model())
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab eéñ\n\t 中文🙂theing  .,<0x>") for _ in range(rng.randrange(0, 90))) for _ in range(400)]
    texts += ["".join(rng.choice("thinger") for _ in range(3000)), " ", "", "  a  b "]
    for t in texts:
        assert m.encode(t).tolist() == sp.encode(t)
        assert m.decode(m.encode(t)) == t
    df = spark.createDataFrame([(1, "Hello world", 3), (2, None, 3), (3, "", 3), (4, "a▁b", 3)], "doc_id long, text string, ids int")
    out = {r.doc_id: r for r in spc.encode(spark, df).collect()}
    assert out[1].ids == sp.encode("Hello world") and out[2].ids is None and out[3].n_tokens == 0 and not out[4].exact
    back = {r.doc_id: r.decoded for r in spc.decode(spark, spc.encode(spark, df)).collect()}
    assert back == {1: "Hello world", 2: None, 3: "", 4: "a b"}


def test_sentencepiece_words_share_the_search_of_their_beginning():
    import sentencepiece

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return dict.get(self, *a)

    sp, m = sentencepiece.SentencePieceProcessor(model_file=spc.DEFAULT_MODEL), spc.Model(spc.read_model())
    m.sizes = Counted(m.sizes)
    rng = random.Random(6)
    stems = ["".join(rng.choice("thingeraoslé") for _ in range(12)) for _ in range(20)]
    texts = [" ".join(rng.choice(stems) + rng.choice("sdnrt") for _ in range(30)) for _ in range(40)] + ["", "a", "ab" * 400]
    assert [x.tolist() for x in m.encode_all(texts)] == [sp.encode(t) for t in texts]
    words = {w for t in texts[:40] for w in t.split()}
    assert Counted.asked < 6 * len(words)  # a word and its space are 14 characters
    assert [x.tolist() for x in m.encode_all(texts[::-1])] == [sp.encode(t) for t in texts[::-1]]


def as_unigram(data):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    out = b""
    for number, value in spc._fields(data):
        if number == 2:
            value = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_search_is_optimal():
    import sentencepiece

    data = as_unigram(spc.read_model())
    m, sp = spc.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(3)
    worth = lambda ids: sum(m.pieces[i][1] for i in ids)
    for _ in range(60):
        t = " ".join("".join(rng.choice("thinger") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6)))
        ids = m.encode(t).tolist()
        assert worth(ids) >= worth(sp.encode(t)) and m.decode(m.encode(t)) == t


def test_warc_round_trip(spark):
    big = "é漢<p>" * 9000
    rows = [(1, "http://a", "x" * 200, 0), (2, None, "x" * 200, 0), (3, "http://b", None, 0), (4, "u", "", 0), (5, "u", big, 0), (6, "u", big, 0), (7, "u", "tiny", 0), (8, "u", "tiny", 0), (9, "u", "a\r\n\r\nWARC/1.1\r\n" * 20, 0)]
    out = {r.page_id: r for r in warc.archive_and_read(spark, spark.createDataFrame(rows, "page_id long, url string, html string, digest int")).collect()}
    assert len(out) == len(rows)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: out[i].refers_to for i in out if out[i].record_type == "revisit"} == {2: 1, 6: 5}
    assert warc.archive_and_read(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_checks_segments(spark, tmp_path):
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError, match="cut short"):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    part = b"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Record-ID: <b>\r\nWARC-Segment-Origin-ID: <a>\r\nWARC-Segment-Number: 2\r\nWARC-Segment-Total-Length: 9\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "part-0.warc").write_bytes(part)
    with pytest.raises(Exception, match="segments"):
        warc.read(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_runs(spark, least):
    rng = random.Random(9)
    lines = [f"line {i}" for i in range(6)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for i in range(30)] + [(30, None), (31, ""), (32, "alone")]
    seen, want = set(), {}
    for i, t in rows:
        parts = (t or "").split("\n")
        real = [k for k, p in enumerate(parts) if p.split()]
        dead = set()
        for s in range(len(real) - least + 1):
            gram = tuple(parts[k] for k in real[s : s + least])
            if gram in seen:
                dead |= set(real[s : s + least])
            seen.add(gram)
        left = t if not dead else "" if len(dead) == len(real) else "\n".join(p for k, p in enumerate(parts) if k not in dead)
        want[i] = (left, len(real), len(dead))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_lines int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in line_runs.dedup(spark, df, least).collect()}
    assert got == want
    assert line_runs.dedup(spark, df.limit(0), least).count() == 0


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.0]) for _ in range(6)]) for i in range(130)] + [(200, None), (201, [float("nan")] * 6), (202, [None] * 6), (None, [0.1] * 6), (250, [9.0] * 6), (203, []), (204, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    use = {i: [int(256 * x // 1) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and x == x for x in v)}
    want = []
    for q in use:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(use[q], use[c])), c) for c in use if c != q)[:5]
            want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(s)]
    got = [tuple(r) for r in topk.search(spark, df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert topk.search(spark, df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_license_scan(spark, docs):
    rows = [(1, "MIT License, mit-license and Apache\nLicense"), (2, None), (3, ""), (4, "cc by cc by"), (5, "...GNU General Public LICENSE!"), (6, "mit éLicense"), (6, "mit license"), (6, "mit license"), (None, "apache license"), (7, "Licensed under the Apache License, Version 2.0")]
    got = [tuple(r)[:6] for r in licenses.scan(spark, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")).collect()]
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
        at = [(k, x) for p, x in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert Counter(got) == Counter(want)
    last = {r.doc_id: r for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert last[7].labels == "apache,apache-2.0" and last[7].score == 1.0 and last[3].score == 0.0
    assert licenses.scan(spark, docs.limit(0)).count() == 0


def test_mixing_meets_budget(spark):
    rows = [(i, "w " * (5 + i % 7), "big" if i % 10 else "small", 1) for i in range(3000)] + [(9999, None, None, 1), (9998, "a b", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight int")
    out = mixing.plan(spark, df, entropy=0.95, blocks=64)
    got = out.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.first("weight").alias("w"), F.sum(F.col("n_tokens") * F.col("copies")).alias("read"), F.max("copies").alias("c")).collect()
    total = sum(r.n for r in got)
    assert abs(sum(r.w for r in got) - 1) < 1e-9 and out.count() == len(rows)
    for r in got:
        assert r.read / max(r.n, 1) <= mixing.MOST_REPEATS + 1 and -1 <= r.read - r.w * total <= 12
    assert {r.source: r.w * total / r.n for r in got}["small"] > 1
    assert mixing.realise(out, df.columns).agg(F.count(F.lit(1))).first()[0] == out.agg(F.sum("copies")).first()[0]
    assert mixing.plan(spark, df.limit(0)).count() == 0


def test_mixing_against_brute_force(spark):
    """Budgets of two sources by hand, names that could clash, texts without words, and an order that reads block after block."""
    rows = [(i, "w " * (1 + i % 4), "a" if i < 90 else "b", 1, 2, 3) for i in range(120)] + [(500, None, "a", 1, 2, 3), (501, "", "c", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, passes int, extra int, block int")
    planned = mixing.plan(spark, df, entropy=1.0, most_repeats=4.0, blocks=8).collect()
    tokens = {s: sum(len((t or "").split()) for _, t, x, *_ in rows if x == s) for s in "abc"}
    total = sum(tokens.values())
    for s in "ab":
        own = [r for r in planned if r.source == s]
        budget, read = int(total * own[0].weight), sum(r.copies * r.n_tokens for r in own)
        assert abs(own[0].weight - 0.5) < 1e-3 and budget <= read < budget + 4 and {r.copies for r in own if r.n_tokens} <= {budget // tokens[s], budget // tokens[s] + 1}
    assert {r.doc_id: r.copies for r in planned if r.doc_id >= 500} == {500: int(total * 0.5) // tokens["a"], 501: 1}
    out = mixing.realise(mixing.plan(spark, df, entropy=1.0, most_repeats=4.0, blocks=8), df.columns, ordered=True).where("source = 'b'").collect()
    assert len(out) == sum(r.copies for r in planned if r.source == "b")
    first = sorted((r.order["block"], r.order["row"], r.doc_id) for r in out if r.order["pass"] == 0)
    assert sorted(d for *_, d in first) == list(range(90, 120)) and [d for *_, d in first] != sorted(d for *_, d in first)


def test_line_runs_with_clashing_names(spark):
    rows = [(1, "a b\nc d\ne", 1, 2, "x"), (2, "z\na b\nc d\nq", 1, 2, "x"), (3, "b\nb\nb", 1, 2, "x"), (4, "a\na", 1, 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc int, starts int, _t string")
    out = {r.doc_id: (r.text, r.doc, r.starts, r._t) for r in line_runs.dedup(spark, df).collect()}
    assert out == {1: ("a b\nc d\ne", 1, 2, "x"), 2: ("z\nq", 1, 2, "x"), 3: ("b", 1, 2, "x"), 4: ("a\na", 1, 2, "x")}


def test_warc_revisit_without_response(spark, tmp_path):
    head = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <b>\r\nWARC-Refers-To: <gone>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "part-0.warc").write_bytes(head)
    with pytest.raises(Exception, match="no response"):
        warc.read(spark, str(tmp_path)).collect()


def test_quality_counts(spark, docs):
    extra = spark.createDataFrame([(100, "a b\n\na b\n x\n" + "the quick brown fox jumps over it now " * 3, "en", "s1", "", 0), (101, "# é&x " * 30, "en", "s1", "", 0)], DOCS)
    out = quality.apply(spark, docs.unionByName(extra))
    texts = Counter()
    for r in docs.unionByName(extra).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        texts[r.doc_id, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)] += 1
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    assert got == texts
    assert out.where("base_failed and kept").count() == 0
    assert quality.apply(spark, docs.limit(0)).count() == 0


def test_quantiles_are_near_and_merge(spark):
    df = spark.range(1000).select(F.lit("en").alias("lang"), (F.col("id") % 2).cast("string").alias("source"), *((F.col("id") + 1.0).alias(m) for m in quality.FENCES))
    q = {r.metric: r for r in quality.quartiles(quality.sketches(df), ["lang"]).collect()}["word_length"]
    assert abs(q.q25 / 250 - 1) < 0.02 and abs(q.q75 / 750 - 1) < 0.02


def test_language_id(spark):
    rng = random.Random(8)
    parts = {"aa": ["tha", "ing", "ou", "er"], "bb": ["éi", "eau", "ç", "oi"]}
    text = lambda k: " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(30))
    rows = [(i, text(k), k) for i, k in enumerate(["aa", "bb"] * 60)] + [(900, None, "aa"), (901, "", None), (902, "123 --", "bb"), (903, text("bb"), None), (None, text("aa"), "aa"), (904, "x" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(spark, df)
    out = {r.doc_id: r for r in langid.predict(spark, df, net).collect()}
    held = [(out[i].lang_pred, k) for i, _, k in rows[:120] if out[i].held_out]
    assert held and sum(a == b for a, b in held) / len(held) >= 0.95
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[903].lang_pred == "bb" and all(0 <= r.score <= 1 for r in out.values())
    none = langid.predict(spark, df, langid.train(spark, df.where("lang is null")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
