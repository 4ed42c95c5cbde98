"""Hand-computable cases of features, rules, quality, decisions and metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopwatch import contract
from loopwatch.functions import features as f
from loopwatch.operators import graph as g
from loopwatch.operators import metrics as m
from loopwatch.operators import quality as q
from loopwatch.operators import rules as r
from loopwatch.operators import scoring as sc
from loopwatch.operators import stream_rules as st
from loopwatch.operators import text as tx
from loopwatch.sources import store


@pytest.mark.parametrize(("t", "rh", "want"), [(30, 50, 18.4), (25, 60, 16.7), (20, 80, 16.4), (35, 40, 19.4)])
def test_dew_point(spark, t, rh, want):
    got = spark.range(1).select(f.dew_point(F.lit(float(t)), F.lit(float(rh)))).first()[0]
    assert abs(got - want) < 0.5


def test_contract_turns_nan_and_text_to_null(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), ("x",), (None,)], "v string")
    assert [x[0] for x in df.select(contract.finite("v")).collect()] == [1.5, None, None, None, None]


def test_contract_missing_column(spark):
    with pytest.raises(ValueError, match="missing columns"):
        contract.validate(spark.range(1))
    assert contract.fill_contract(spark.range(1).select(F.lit("2026-01-01 00:00:00").alias("timestamp"))).count() == 1


def series(spark, rows):
    cols = "device_id int, arrival_seq long, t long, outlet_temp double, operating_condition string, fault_label string"
    return spark.createDataFrame(rows, cols)


def test_dedup_grid_and_order(spark):
    df = series(spark, [(1, 0, 0, 1.0, "a", "none"), (1, 1, 3, 2.0, None, "none"), (1, 2, 1, 3.0, "b", "none"), (1, 3, 3, 9.0, "b", "none")])
    assert q.out_of_order(df).first().n_out_of_order == 1
    grid = q.fill_labels(q.to_grid(q.dedup_keep_first(df))).orderBy("t").collect()
    assert [(x.t, x.outlet_temp, x.operating_condition) for x in grid] == [(0, 1.0, "a"), (1, 3.0, "b"), (2, None, "b"), (3, 2.0, "b")]


def test_condition_fill_weights_by_distance(spark):
    df = series(spark, [(1, 0, 0, 10.0, "a", ""), (1, 1, 1, None, "a", ""), (1, 2, 2, 99.0, "b", ""), (1, 3, 4, 40.0, "a", "")])
    got = {x.t: x.filled for x in q.condition_fill(df, "outlet_temp").collect()}
    assert got[1] == pytest.approx((10 * 1 + 40 / 3) / (1 + 1 / 3))


def test_null_readings_fire_no_rule(spark):
    row = {c: None for c in contract.CHANNELS}
    df = spark.createDataFrame([(1, 0, *row.values())], "device_id int, t long, " + ", ".join(f"{c} double" for c in row))
    assert r.row_alerts(df).count() == 0


def test_router_truth_table(spark):
    rows = [(0.0, 1, 600, "fast"), (0.0, 4, 600, "precise"), (0.0, 1, 1800, "precise"), (0.9, 1, 600, "precise")]
    df = spark.createDataFrame(rows, "s double, n int, h int, want string").select(sc.route(F.col("s"), F.col("n"), F.col("h")).alias("got"), "want")
    assert all(x.got == x.want for x in df.collect())


def test_gates(spark):
    df = spark.createDataFrame([(0.95,), (0.8,), (0.5,)], "c double")
    assert [x[0] for x in df.select(g.confidence_gate(F.col("c"))).collect()] == ["direct", "candidates", "manual"]


def test_candidates_prefer_most_hits(spark):
    ind = spark.createDataFrame(g.numbered(g.INDICATES), "ord int, fault string, sensor string")
    cases = spark.createDataFrame([(1, "压力"), (1, "水箱液位"), (1, "湿度")], "case_id int, sensor string")
    top = g.candidates(cases, ind).where("rank = 1").first()
    assert (top.fault, top.hits) == ("管道泄漏", 3)


def test_fan_out_counts(spark):
    push = spark.createDataFrame(g.PUSH, "level string, channels array<string>, receivers array<string>")
    got = {x.level: x["count"] for x in g.fan_out(spark.createDataFrame([(1, "red"), (2, "orange"), (3, "odd")], "order_id int, level string"), push).groupBy("level").count().collect()}
    assert got == {"red": 9, "orange": 4, "odd": 1}


def test_calibration_by_hand(spark):
    df = spark.createDataFrame([("a", 0.8, True), ("a", 0.8, False)], "kind string, conf double, correct boolean")
    got = m.calibration(df, ["kind"]).first()
    assert got.brier == pytest.approx(0.34) and got.ece == pytest.approx(0.3)


def test_bootstrap_of_equal_clusters_is_a_point(spark):
    df = spark.createDataFrame([(i, 1) for i in range(5)], "c int, v int")
    got = m.bootstrap(df, "c", "v", 20).first()
    assert (got.lo, got.hi) == (1.0, 1.0)


def test_lock_lasts_as_long_as_stated(spark):
    # each reading whose last thirty name two conditions sets the lock anew: a change at 100 locks 100 to 727
    rows = [(1, t, "a" if t < 100 else "b") for t in range(900)]
    df = spark.createDataFrame(rows, "device_id int, t long, operating_condition string")
    locked = [x.t for x in st.transition_lock(df).where("locked").orderBy("t").collect()]
    assert locked == list(range(100, 728))


def test_unknown_conditions_hide_no_change(spark):
    known = {0: "a", 1: "a", 2: "a", 9: "b", 10: "b"}
    df = spark.createDataFrame([(1, t, known.get(t, None if t % 2 else "")) for t in range(60)], "device_id int, t long, operating_condition string")
    out = df.withColumn("changing", st.in_transition())
    assert [x.t for x in out.where("changing").orderBy("t").collect()] == list(range(10, 30))  # five are known from 10 on


def test_oscillation_counts_read_pressures(spark):
    rng = np.random.default_rng(1)
    v = [None if t % 7 == 3 else float(250 + 0.1 * t + 5 * rng.standard_normal()) for t in range(9000)]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(v)], "device_id int, t long, pressure double")
    got = {x.t: x.osc for x in f.rolling_detrended_std(df, "pressure").collect()}
    held = []
    for t, x in enumerate(v):
        if x is None:
            assert t not in got
            continue
        held = [*held, x][-60:]
        if len(held) < 10:
            assert got[t] is None
        elif t % 17 == 0 or t > 8990 or 4700 < t < 4900:
            k = np.arange(len(held))
            assert abs(got[t] - np.std(np.array(held) - np.polyval(np.polyfit(k, held, 1), k))) < 1e-6


def test_fallback_and_gates_with_nulls(spark):
    row = "select cast(null as double) hum, cast(null as double) dh, 200e0 p, cast(null as double) ps, 5e0 q, cast(null as double) dt"
    df = spark.sql(row).select(g.fallback(*(F.col(c) for c in ("hum", "dh", "p", "ps", "q", "dt")), F.lit(None).cast("string")).alias("cause"))
    assert df.first().cause == "过滤器堵塞"
    gate = lambda c: spark.sql("select 1 x").select(g.cascade_gate(F.lit(True), F.lit(True), F.lit(True), F.lit("a"), F.expr(c)).alias("r")).first().r
    assert gate("cast(array() as array<string>)") is None and gate("cast(null as array<string>)") is None and gate("array('b')") == "candidate"
    arb = spark.sql("select '管道泄漏' model, 0.9D conf, array('管道泄漏') candidates, cast(array() as array<string>) extras, cast(null as double) hum, cast(null as double) dh, cast(null as double) ps, cast(null as double) pq")
    assert g.arbitrate(arb).first().confidence == 0.75  # a missing humidity counts as 50, which is dry


def test_only_channels_with_gaps_are_rounded(spark):
    rows = [(1, t, t, *(10.123 + 0.001 * t if c != "pressure" else (None if t == 5 else 200.123) for c in q.CHANNELS), "melting", "none") for t in range(20)]
    df = spark.createDataFrame(rows, "device_id int, t long, arrival_seq long, " + ", ".join(f"{c} double" for c in q.CHANNELS) + ", operating_condition string, fault_label string")
    out = {x.t: x for x in q.clean(df).collect()}
    assert out[3].inlet_temp == 10.126 and out[5].pressure == 200.1 and out[6].pressure == 200.1


def test_first_arrival_wins_and_malformed_lines_go(spark):
    new = spark.createDataFrame([(1, 5, 2, "late"), (1, 5, 1, "first"), (1, 6, 3, "held")], "device_id int, t long, arrival_seq long, v string")
    held = spark.createDataFrame([(1, 6)], "device_id int, t long")
    assert [x.v for x in store.insert_ignore(held, new, ["device_id", "t"]).collect()] == ["first"]
    lines = spark.createDataFrame([('{"a": }',), ('{"a": 1, oops}',), ('{"a": 1}',), ("",), ('{"b": "NaN"}',), ('{"a": NaN}',)], "value string")
    assert sorted(x.a or 0 for x in store.parse_jsonl(lines.limit(5), "a double").collect()) == [0, 1]
    assert sorted(x.a or 0 for x in store.strict_json(lines, "a double").collect()) == [0, 1]


def test_windows_that_end_with_the_series_are_left_out(spark):
    rows = lambda n: spark.createDataFrame([(1, t, 35.0, 55.0 + 30 * t / 1800) for t in range(n)], "device_id int, t long, cabinet_temp double, cabinet_humidity double")
    assert max(x.t for x in r.dew_predict(rows(1201)).collect()) == 1199
    assert max((x.t for x in r.dew_predict(rows(1200)).collect()), default=0) < 1199


def test_evidence_is_traced_by_sensor(spark):
    seen = [("湿度", 71.25, 0.5, 0.1), ("压力", 240.0, 3.21, -1.5)]
    df = spark.createDataFrame([(seen,)], "observed array<struct<name:string,mean:double,deviation:double,slope:double>>")
    ok = lambda *items, lacking="": df.select(tx.traceable(F.array(*map(F.lit, items)) if items else F.expr("cast(array() as array<string>)"), F.col("observed"), F.lit(lacking), ["湿度", "压力"]).alias("x")).first().x
    assert ok("湿度均值71.3，压力标准差3.21") and ok("湿度71.25", "缺失通道：流量", lacking="流量")
    assert ok("湿度71.3") and ok("湿度71.25") and not ok("湿度71.4")
    half = df.select(F.array(F.struct(F.lit("湿度").alias("name"), *(F.lit(x).alias(n) for n, x in (("mean", 0.15), ("deviation", 3.0), ("slope", 0.0))))).alias("observed"))
    assert half.select(tx.traceable(F.array(F.lit("湿度0.2")), F.col("observed"), F.lit(""), ["湿度"]).alias("x")).first().x  # half a unit away
    assert not ok("湿度240") and not ok("压力") and not ok() and not ok("缺失通道：流量", lacking="流量") and not ok("共3项，湿度71.3")


def test_corruptions_change_what_they_name(spark):
    text = '分析 {"root_cause": "管道泄漏", "confidence": 0.8, "evidence": ["湿度 71.2"], "sop": ["查漏"]} 完'
    df = spark.createDataFrame([(1, text, "管道泄漏", k) for k in tx.CORRUPTIONS] + [(2, "没有", "管道泄漏", "broken_json")], "id long, text string, gold string, kind string")
    out = {(x.id, x.kind): x.bad for x in tx.corrupted(df, "kind", "text", "gold", "id", ["管道泄漏", "线圈结垢"]).collect()}
    assert "线圈结垢" in out[1, "wrong_root_cause"] and "0.95" in out[1, "overconfident_wrong"] and out[1, "wrong_root_cause"].endswith(" 完")
    assert "71.2" not in out[1, "fabricated_evidence"] and '"sop"' not in out[1, "broken_json"] and out[2, "broken_json"] is None


def test_store_round_trip_prunes(spark, tmp_path):
    df = spark.range(0, 8000, 10).select(F.lit(1).alias("device_id"), F.col("id").alias("t"), F.lit("melting").alias("operating_condition"))
    store.append(df, str(tmp_path / "s"))
    out = store.range_scan(spark.read.parquet(str(tmp_path / "s")), 100, 200)
    assert out.count() == 11 and "PartitionFilters: [isnotnull(bucket" in out._jdf.queryExecution().toString()
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\nbad\n{"a": 2}\n')
    assert sorted(x.a for x in store.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int").collect()) == [1, 2]


def test_a_window_that_broke_off_has_a_mean(spark):
    from loopwatch.operators import audit

    df = spark.range(0, 700).select(F.lit(1).alias("device_id"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    rows = {(held, r.window_id): r.mean for held in (False, True) for r in audit.window_statistics(df, ["x"], held=held).collect()}
    assert rows == {(False, 0): 539.5, (True, 0): 539.5, (False, 1): None, (True, 1): 649.5}  # its last reading is at 699


def test_a_reading_at_the_seasons_limit_does_not_exceed_it(spark):
    """Seven readings of a and one of a + 8: the mean is a + 1, and the limit a + 8, give or take the last bits of its sums."""
    channels = "outlet_temp pressure flow_rate conductivity cabinet_temp cabinet_humidity furnace_temp electric_power".split()
    inlet = F.when(F.col("id") % 8 == 7, 38.1).otherwise(30.1)
    df = spark.range(0, 4000).select(F.lit(1).alias("device_id"), F.col("id").alias("t"), inlet.alias("inlet_temp"), F.lit("idle").alias("operating_condition"), *(F.lit(1.0).alias(c) for c in channels))
    assert not r.all_alerts(df, 8, 8).where("rule_id = 'INLET_TEMP_HIGH'").count()
