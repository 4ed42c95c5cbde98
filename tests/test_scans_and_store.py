"""Block scans, as-of joins, the written store, manifests, sessions, resampling and backtests, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopwatch.functions.asof import asof
from loopwatch.functions.dims import fixed, small
from loopwatch.functions.features import halo_blocks
from loopwatch.functions.scans import in_frames, nearest_valid, spaced
from loopwatch.operators import context as cx
from loopwatch.operators import evaluation as ev
from loopwatch.operators import graph as g
from loopwatch.operators import metrics as m
from loopwatch.operators import orders as od
from loopwatch.operators import scoring as sc
from loopwatch.operators import stream_rules as st
from loopwatch.operators import text as tx
from loopwatch.sources import session, store


def series(seed=1, n=300):
    rng = random.Random(seed)
    return [(d, t, rng.choice([None, None, t * 10 + (d or 0)]), rng.random() < 0.3) for d in (1, 2, None) for t in sorted(rng.sample(range(1000), n))]


@pytest.mark.parametrize("block", [7, 64, 5000])
@pytest.mark.parametrize("own", [True, False])
def test_nearest_valid(spark, block, own):
    rows = series()
    df = spark.createDataFrame(rows, "device_id long, t long, v long, hit boolean")
    got = {(r.device_id, r.t): (r.prev_x, r.next_x) for r in nearest_valid(df, {"x": F.col("v")}, ["device_id"], own, block).collect()}
    assert len(got) == len(rows)
    for d, t, v, _ in rows:
        back = [(s, x) for e, s, x, _ in rows if e == d and x is not None and (s < t or own and s == t)]
        ahead = [(s, x) for e, s, x, _ in rows if e == d and x is not None and (s > t or own and s == t)]
        assert got[d, t] == (max(back)[1] if back else None, min(ahead)[1] if ahead else None), (d, t, v)


@pytest.mark.parametrize(("gap", "block"), [(10, 16), (10, 4096), (1, 8), (16, 16), (37, 64)])
def test_spaced(spark, gap, block):
    rows = [(d, t) for d, t, _, hit in series(gap, 400) if hit and d]
    want, free = [], {}
    for d, t in sorted(rows):
        if t >= free.get(d, 0):
            want.append((d, t))
            free[d] = t + gap
    df = spark.createDataFrame(rows, "device_id long, t long")
    assert sorted(map(tuple, spaced(df, gap, block).collect())) == want
    if (gap, block) == (10, 4096):  # a fault that lasts forty seconds is diagnosed every ten
        long = spark.range(0, 45).select(F.lit(1).alias("device_id"), F.col("id").alias("t"), F.col("id").between(0, 39).alias("fault"))
        assert sorted(r.t for r in st.diagnosed(long).collect()) == [0, 10, 20, 30]


def test_frames_count_readings_not_seconds(spark):
    rows = [(1, t, 1) for t in [*range(5), 900, 901, 5000, 5001]]
    out = in_frames(spark.createDataFrame(rows, "device_id long, t long, v long"), 3, lambda w: {"s": F.sum("v").over(w.rowsBetween(-2, 0))}, block=4)
    assert [r.s for r in sorted(out.collect(), key=lambda r: r.t)] == [1, 2] + [3] * 7


def test_more_tasks_than_devices(spark):
    df = spark.range(0, 40_000).select(F.lit(1).alias("device_id"), F.col("id").alias("t"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    plan = nearest_valid(df, {"v": F.col("v")}, ["device_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert all("_b" in line for line in plan.split("\n") if "Window [" in line)  # each window is over blocks, of readings or of sums


def test_asof(spark):
    left = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (2, 1, 5), (3, 1, 0), (4, 2, 50), (5, None, 5), (6, 1, None), (7, 9, 5), (8, 1, 9000)], "case_id long, device_id long, t long")
    right = spark.createDataFrame([(1, 1, "a", 1), (1, 5, "b", 2), (1, 5, "c", 3), (1, 6, "d", 4), (2, 49, None, 5), (None, 5, "x", 6), (1, None, "y", 7)], "device_id long, t long, v string, n long")
    got = sorted(((r.case_id, r.found.v if r.found else "none", r.found.n if r.found else None) for r in asof(left, right, ["device_id"], "n", 4).collect()), key=str)
    # at one time the greatest n stands; a null value is a row all the same
    assert got == sorted([(1, "c", 3), (2, "c", 3), (2, "c", 3), (3, "none", None), (4, None, 5), (5, "none", None), (6, "none", None), (7, "none", None), (8, "d", 4)], key=str)


def test_store_inserts_once_and_prunes(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda a, b, v: spark.range(a, b).select(F.lit(1).cast("long").alias("device_id"), F.col("id").alias("t"), F.col("id").alias("arrival_seq"), F.lit(v).alias("v"))
    store.insert(spark, path, rows(0, 8000, "first"), ["device_id", "t"])
    before = {p.name for p in (tmp_path / "s" / "bucket=0").iterdir()}
    store.insert(spark, path, rows(7000, 9000, "second").unionByName(rows(7000, 9000, "again").withColumn("arrival_seq", F.col("arrival_seq") + 1)), ["device_id", "t"])
    assert {p.name for p in (tmp_path / "s" / "bucket=0").iterdir()} == before  # other buckets are left alone
    once = sorted(map(tuple, store.sizes(spark, path).select("bucket", "n_rows").collect()))
    store.insert(spark, path, rows(7000, 9000, "third"), ["device_id", "t"])
    assert sorted(map(tuple, store.sizes(spark, path).select("bucket", "n_rows").collect())) == once == [(0, 3600), (1, 3600), (2, 1800)]
    on_disk = sum(p.stat().st_size for p in (tmp_path / "s").rglob("*.parquet"))
    assert sum(r.bytes for r in store.sizes(spark, path).collect()) == on_disk
    assert {r.v: r.n for r in spark.read.parquet(path).groupBy("v").agg(F.count("*").alias("n")).collect()} == {"first": 8000, "second": 1000}
    scan = store.range_scan(store.read_store(spark, path), 3500, 3700, None, ["t"])
    assert scan.count() == 201
    assert "PartitionFilters: [isnotnull(bucket" in scan._jdf.queryExecution().executedPlan().toString()


def test_a_load_without_new_keys_writes_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "s"), spark.createDataFrame([(1, 5, 0), (1, 4000, 1), (1, None, 2)], "device_id long, t long, arrival_seq long")
    store.insert(spark, path, rows.where("t is not null"), ["device_id", "t"])
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    store.insert(spark, path, rows.where("t is not null").withColumn("arrival_seq", F.col("arrival_seq") + 9), ["device_id", "t"])
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")} == files
    for _ in range(2):  # a row without a time is held once, too
        store.insert(spark, path, rows, ["device_id", "t"])
        assert sorted(r.arrival_seq for r in spark.read.parquet(path).collect()) == [0, 1, 2]


def test_store_with_many_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_BUCKETS", 2)
    rows = spark.range(0, 20_000, 100).select(F.lit(1).cast("long").alias("device_id"), F.col("id").alias("t"), F.col("id").alias("arrival_seq"))
    for part in (rows.where("t % 300 = 0"), rows, rows):
        store.insert(spark, str(tmp_path / "s"), part, ["device_id", "t"])
    assert store.sizes(spark, str(tmp_path / "s")).agg(F.sum("n_rows")).first()[0] == 200


def test_manifest(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i % 7}", None if i % 5 else 0.5) for i in range(100)], "k long, v string, x double")
    mark = lambda d: sorted(map(tuple, store.manifest(d, ["v"]).collect()))
    assert mark(df) == mark(df.orderBy(F.desc("k")).repartition(7).select("x", "v", "k"))
    for other in (df.where("k <> 3"), df.unionByName(df.where("k = 3")), df.withColumn("x", F.when(F.col("k") == 3, 0.25).otherwise(F.col("x"))), df.withColumn("k", F.when(F.col("k") < 2, 1 - F.col("k")).otherwise(F.col("k")))):
        assert mark(df) != mark(other)
    path = str(tmp_path / "m")
    store.write_with_manifest(df.repartition(3), path, ["v"])
    assert store.read_verified(spark, path, ["v"]).count() == 100
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/data")  # the same rows in another file
    assert store.read_verified(spark, path, ["v"], files=False).count() == 100
    with pytest.raises(ValueError, match="manifest"):
        store.read_verified(spark, path, ["v"])
    store.write_with_manifest(df.coalesce(1), path)
    (file,) = (tmp_path / "m" / "data").glob("part-*.parquet")
    data = bytearray(file.read_bytes())
    data[10] ^= 1
    file.write_bytes(data)
    for crc in (tmp_path / "m" / "data").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="manifest"):
        store.read_verified(spark, path)


def test_session_is_one_scan_until_it_expires(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    now, built = [0.0], []

    def load():
        built.append(1)
        return spark.read.parquet(str(tmp_path / "t")).withColumn("v", F.col("id") * 2)

    held = session.Sessions(ttl=10, most=2, clock=lambda: now[0])
    a, b = held.open("x", load), held.open("x", load)
    both = a.groupBy().agg(F.sum("v")).unionByName(b.groupBy().agg(F.max("v").alias("sum(v)")))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert a is b and len(built) == 1 and "InMemoryTableScan" in plan and sorted(r[0] for r in both.collect()) == [198, 9900]
    now[0] = 9
    held.open("x", load)
    now[0] = 18
    assert held.open("x", load) is a  # used since
    now[0] = 30
    assert held.open("x", load) is not a and len(built) == 2 and not a.is_cached
    held.open("y", load), held.open("x", load), held.open("z", load)
    assert held.names() == ["x", "z"]  # y was the longest unused
    for n in held.names():
        held.close(n)


def test_paired_bootstrap(spark):
    rng = random.Random(3)
    rows = [(c, int(rng.random() < 0.9), int(rng.random() < 0.7)) for c in range(50) for _ in range(rng.randrange(1, 9))] + [(None, 0, 0), (3, None, 1)]
    df = spark.createDataFrame(rows, "c long, a int, b int").repartition(3)
    got = {r.method: r for r in m.paired_bootstrap(df, "c", ["a", "b"], draws=400, seed=11).collect()}
    used = [r for r in rows if r[0] is not None]
    ids = np.array(sorted({r[0] for r in used}))
    sums = np.array([[sum(r[k] or 0 for r in used if r[0] == c) for c in ids] for k in (1, 2)] + [[sum(r[0] == c for r in used) for c in ids]], float)
    drawn = sums @ m.draw_counts(ids, np.arange(400), 11)
    a, b = drawn[0] / drawn[2], drawn[1] / drawn[2]
    for name, x, point in (("a", a, sums[0].sum() / sums[2].sum()), ("b", b, sums[1].sum() / sums[2].sum()), ("b-a", b - a, (sums[1].sum() - sums[0].sum()) / sums[2].sum())):
        assert got[name].mean == pytest.approx(point) and got[name].lo == pytest.approx(np.quantile(x, 0.025)) and got[name].hi == pytest.approx(np.quantile(x, 0.975))
    counts = m.draw_counts(np.arange(3000), np.arange(200), 5)
    share = np.bincount(counts.ravel()) / counts.size
    assert abs(counts.mean() - 1) < 0.01 and np.allclose(share[:4], [0.3679, 0.3679, 0.1839, 0.0613], atol=0.005)
    assert abs(np.corrcoef(counts[:, 0], counts[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(counts[0], counts[1])[0, 1]) < 0.25


def test_backtest(spark):
    rows = [(d, t, float(d * 100 + t * (0.5 if d == 1 else -0.25))) for d in (1, 2) for t in range(200) if not (d == 2 and t == 60)] + [(3, t, 1.0) for t in range(25)] + [(4, t, None if t == 85 else 5.0) for t in range(100)]
    df = spark.createDataFrame(rows, "device_id long, t long, v double")
    got = sc.backtest(df, "v", sc.Trend(30, 10), 10).collect()
    value = {(d, t): v for d, t, v in rows}
    assert {(r.device_id, r.origin) for r in got} == {(1, 200 - 10 * k) for k in range(1, 11)} | {(2, 200 - 10 * k) for k in range(1, 11)} | {(4, 100 - 10 * k) for k in range(2, 8)}
    for r in got:
        assert r.actual == value[r.device_id, r.origin + r.step]
        assert r.forecast == pytest.approx(r.actual if r.actual is not None else 5.0)  # all series are lines
        assert (r.error is None) == (r.actual is None)
    hold = sc.errors_by_step(df, "v", {"hold": sc.HoldLast(30, 10)}, 2).where("device_id = 1 and step = 9").first()
    assert hold.n == 2 and hold.mape == pytest.approx(np.mean([5 / value[1, o + 9] for o in (180, 190)]))


def test_window_scores(spark, monkeypatch):
    monkeypatch.setattr(sc, "halo_blocks", lambda df, k, before: halo_blocks(df, k, before, 0, 16))
    rows = [(d, t, None if t == 40 else float(t * d), 1.0) for d, n in ((1, 100), (2, 59), (3, 60)) for t in range(n)]
    got = {(r.device_id, r.t): r.score for r in sc.WindowEnergy().scores(spark.createDataFrame(rows, "device_id long, t long, a double, b double"), ["a", "b"]).collect()}
    assert set(got) == {(1, t) for t in range(59, 100)} | {(3, 59)}
    for (d, t), v in got.items():
        x = np.array([r[2:] for r in rows if r[0] == d and t - 60 < r[1] <= t], float)
        assert v is None if t - 60 < 40 <= t else v == pytest.approx(np.sqrt((x * x).mean()))


def test_null_groups_and_ranks(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, rng.randrange(50), rng.random() * 1e6])) for k in ("a", "b", None) for _ in range(200)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        want = {}
        for key in ("a", "b", None, "c"):
            own = sorted(float(v) for k, v in rows if k == key and v is not None)
            want[key] = own[round(share * (len(own) - 1))]
        assert {r.k: r.value for r in m.nearest_rank(df, ["k"], "v", share, 8).collect()} == want
    out = {r.k: r for r in ev.describe(df, "k", "v").collect()}
    assert set(out) == {"a", "b", None, "c", "d"} and out["d"].p50 is None and out[None].p95 is not None
    none = spark.createDataFrame([(False, 1.0)], "json_ok boolean, latency double")
    assert ev.latency(none).collect()[0].asDict() == {"mean": None, "max": None, "p50": None, "p95": None}


def test_order_numbers_beyond_four_digits(spark):
    day = spark.range(10_001).select("id", F.to_date(F.lit("2026-07-25")).alias("day"))
    ids = {r.order_id for r in od.numbered(day, "day", "id").collect()}
    assert len(ids) == 10_001 and {"WO-20260725-0001", "WO-20260725-9999", "WO-20260725-10001"} <= ids


def test_points_stay_repeated(spark):
    points = spark.createDataFrame([(5,), (5,), (10,), (99,)], "t long")
    phases = spark.createDataFrame([(0, 10, "a"), (10, 20, "b")], "start long, end long, phase string")
    out = g.interval_lookup(points, phases, "t")
    assert sorted((r.t, r.phase) for r in out.collect() if r.phase) == [(5, "a"), (5, "a"), (10, "a")] and out.count() == 4
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_json_with_escapes(spark):
    lines = [r'{"k": "say \"NaN\" now"}', r'{"k": "back\\"}', '{"k": NaN}', r'{"k": "a\\", "v": Infinity}', '{"k": "Infinity"}']
    got = {r.k for r in store.strict_json(spark.createDataFrame([(x,) for x in lines], "value string"), "k string").collect()}
    assert got == {'say "NaN" now', "back\\", "Infinity"}


def test_topics(spark):
    asked = {"Sop在哪": "procedure", "压力现场\n大概有多少": "current", "大概有多少\n的压力": "current", "SENSOR list": "sensors", "监测了哪些\n项": "unknown", "监测了哪些项": "sensors", "多少度会\n报警": "unknown", "多少度会报警": "thresholds"}
    df = spark.createDataFrame([(q,) for q in asked], "q string").select("q", cx.route(F.col("q"), F.lit(None)).alias("topic"))
    assert {r.q: r.topic for r in df.collect()} == asked


def test_names_are_no_patterns(spark):
    df = spark.createDataFrame([(["T(x mean 5.0"], [("T(x", 5.0, 0.0, 0.0)])], "e array<string>, o array<struct<name: string, mean: double, deviation: double, slope: double>>")
    assert df.select(tx.traceable(F.col("e"), F.col("o"), F.lit(""), ["T(x", "y+"])).first()[0] is True


def test_reference_tables_have_a_size(spark):
    with pytest.raises(ValueError, match="the aliases has more"):
        fixed(spark.range(20), "the aliases", 10)
    assert fixed(spark.range(10), most=10).count() == 10
    big = spark.range(50).join(small(spark.range(20), 10), "id").select("id")
    assert "ResolvedHint" not in big._jdf.queryExecution().optimizedPlan().toString() and big.count() == 20
