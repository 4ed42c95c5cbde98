"""Steps whose rows are summed, or taken once, before they are repeated, ranked or scanned."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loopwatch.functions import asof as af
from loopwatch.functions import scans
from loopwatch.operators import datasets as ds
from loopwatch.operators import metrics as m
from loopwatch.operators import stream_rules as st


def above(plan: str, upper: str, lower: str) -> bool:
    """Whether the first line with `upper` stands above one with `lower`."""
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if upper in x)
    return any(lower in x for x in lines[at:])


def test_spearman_counts_values_before_it_ranks(spark):
    rng = random.Random(3)
    rows = [(d, float(rng.randrange(9)), rng.choice([None, 1.5, 2.5, 7.0])) for d in (1, 2) for _ in range(300)] + [(3, 1.0, 2.0), (3, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "device_id long, a double, b double")
    mean_rank = lambda c: F.rank().over(Window.partitionBy("device_id").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("device_id", c)) - 1) / 2
    used = df.where("a is not null and b is not null").select("device_id", mean_rank("a").alias("x"), mean_rank("b").alias("y"))
    want = {r.device_id: r.rho for r in used.where("device_id < 3").groupBy("device_id").agg(F.corr("x", "y").alias("rho")).collect()}
    out = m.spearman(df, "device_id", "a", "b")
    got = {r.device_id: r.rho for r in out.collect()}
    assert got.keys() == {1, 2, 3} and got[3] is None  # equal values have no correlation
    assert all(abs(got[d] - want[d]) < 1e-12 for d in want)
    assert above(out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1], "Window", "Aggregate")


def test_transition_windows_sum_slots_before_they_are_repeated(spark):
    rng = random.Random(4)
    rows = [(1, t, "b" if t // 37 % 3 == 0 else rng.choice(["a", None]) if t > 200 else "a") for t in range(400) if t != 211]
    df = spark.createDataFrame(rows, "device_id long, t long, operating_condition string")
    out = ds.transition_windows(df, 60, 20, 20, 30)
    by_t = {t: c or "" for _, t, c in rows}
    want = [s for s in range(20, 400, 20) if all(t in by_t for t in range(s, s + 60)) and len({by_t[t] for t in range(s + 30, s + 60)}) > 1]
    assert sorted(r.start for r in out.collect()) == want and want
    assert above(out._jdf.queryExecution().optimizedPlan().toString(), "Generate", "Aggregate")


def test_asof_scans_each_asked_time_once(spark, monkeypatch):
    left = spark.createDataFrame([(i, 1 + i % 2, i % 5) for i in range(200)], "case_id long, device_id long, t long")
    right = spark.createDataFrame([(d, t, t * 10) for d in range(1, 8) for t in (1, 3)], "device_id long, t long, v long")
    seen = []
    scan = af.nearest_valid
    monkeypatch.setattr(af, "nearest_valid", lambda df, *a, **k: seen.append(df.count()) or scan(df, *a, **k))
    got = {r.case_id: r.found.v if r.found else None for r in af.asof(left, right, ["device_id"]).collect()}
    assert got == {i: [None, 10, 10, 30, 30][i % 5] for i in range(200)}
    assert seen == [10 + 4]  # ten times of two devices, and their readings


def test_watched_numbers_readings_once(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(d, t, rng.choice(["a", "b", None, ""]) if 2000 < t < 2100 else "a", rng.choice([200.0, 400.0, None])) for d in (1, 2) for t in range(0, 9000, d)]
    df = spark.createDataFrame(rows, "device_id long, t long, operating_condition string, pressure double")
    high = F.col("pressure") > 300
    want = {(r.device_id, r.t): (r.locked, r.sustained) for r in st.sustained(st.transition_lock(df), high).collect()}
    tables = []
    write = scans.written
    monkeypatch.setattr(scans, "written", lambda x: tables.append(x.columns) or write(x))
    assert {(r.device_id, r.t): (r.locked, r.sustained) for r in st.watched(df, high).collect()} == want
    assert len(tables) == 2 and len({v for v in want.values()}) > 2
