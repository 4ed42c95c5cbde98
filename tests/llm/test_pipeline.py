"""The pipeline's stages on a small corpus."""

from collections import Counter

import pytest

pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    import corpus_pipeline as cp

    line = lambda k: " ".join(f"w{k}x{i}" for i in range(25))
    rows = [(1, line(1) + "\n" + line(2)), (2, line(1) + "\n" + line(2) + "\n" + line(3)), (3, line(4)), (4, line(4) + " more"), (5, "short"), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    one = cp.quality_rules(spark, docs, "")
    assert sorted(r.doc_id for r in one.collect()) == [1, 2, 3, 4] and one.columns == cp.COLUMNS
    two = {r.doc_id: r.text for r in cp.line_dedup(spark, one, "").collect()}
    assert two == {1: rows[0][1], 2: line(3), 3: line(4), 4: line(4) + " more"}
    three = cp.near_duplicates(spark, one.where("doc_id > 2"), "")
    assert [r.doc_id for r in three.collect()] == [3]
    four = cp.mix_sources(spark, one, "")
    assert four.columns == cp.COLUMNS and four.count() == 4
    assert all(r.exact for r in cp.encode(spark, four, "").collect())


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k, n=50):
    return " ".join(f"v{k}y{i}" for i in range(n))


def test_quality_judges_each_row(spark):
    import corpus_pipeline as cp

    texts = [(None, prose(1)), (None, "junk"), (None, None), (7, prose(2)), (7, "short"), (8, prose(3)), (8, prose(3))]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in texts], FIELDS)
    got = Counter((r.doc_id, r.text, r.n_chars) for r in cp.quality_rules(spark, docs, "").collect())
    assert got == Counter((i, t, len(t)) for i, t in texts if t and len(t) > 10)


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline as cp

    chain = prose(9, 60).split()
    a, b, c = (" ".join(chain[k : k + 54]) for k in (0, 3, 6))  # a - b and b - c link, a - c doesn't
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(2)), (3, prose(3)), (3, prose(3)), (4, prose(4)), (4, prose(3)), (5, prose(4)), (6, a), (None, b), (7, c), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], FIELDS)
    got = Counter((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect())
    assert got == Counter([(None, prose(1)), (None, prose(2)), (3, prose(3)), (4, prose(4)), (6, a)])


def test_long_single_lines_go(spark):
    import corpus_pipeline as cp

    long = prose(5, 50)
    rows = [(1, "a b\n" + long + "\nc d"), (2, "e f\n" + long + "\n\ng h"), (3, long), (4, "a b\n" + prose(6, 49)), (5, prose(6, 49) + "\na b"), (6, "x y\n" + long + "\nc d")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], FIELDS)
    got = {r.doc_id: r.text for r in cp.line_dedup(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "e f\n\ng h", 4: rows[3][1], 5: rows[4][1], 6: "x y"}
