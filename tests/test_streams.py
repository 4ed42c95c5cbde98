"""Streams: the live path against batch windows, restarts, preloads, timers, late rows and a sink that is written to twice."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loopwatch.operators import stream_rules as st
from loopwatch.streaming import event_time, processor, sessions, sinks

READING = "device_id long, t long, operating_condition string, pressure double, margin double, n_rules int, raw double, exceeds boolean, answers boolean"


def reading(d, t, good=False):
    """A condition that changes now and then, missing values, and a margin that falls."""
    return (d, t, [None, "", "a", "b"][(t // 97 + d) % 4] if t % 5 else "a", None if t % 11 == 3 else 200.0 + (t * 37 % 19) * (1 + t % 3), None if t % 13 == 0 else 20.0 - (t % 700) / 45, int(t % 50 == 0), 0.9 if t % 400 > 150 else 0.2, t % 90 == 0, good)


def run(spark, base, rows, files, initial=None, name="out"):
    """Rows by device and time, in `files` steps."""
    size = -(-(max(r[1] for r in rows) + 1) // files)
    df = spark.createDataFrame(rows, READING)
    processor.in_order(spark, df, f"{base}/in", F.floor(F.col("t") / size), ("device_id",))
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    return processor.run_available(spark, processor.live(stream, initial), base, name)


def test_live_equals_batch(spark, tmp_path):
    rows = [reading(d, t) for d in (1, 2) for t in range(1500)]
    got = {(r.device_id, r.t): r for r in run(spark, str(tmp_path), rows, 4).collect()}
    assert len(got) == len(rows)
    df = spark.createDataFrame(rows, READING)
    taken = F.floor((F.col("t") + 1) / 10)
    w = st.ordered()
    score = F.when(F.col("t") < 99, 0.0).otherwise(F.first("raw").over(w.partitionBy("device_id", taken)))
    batch = st.sustained(st.transition_lock(df.withColumn("score", score)), F.col("score") > 0.6)
    from loopwatch.functions.features import rolling_detrended_std

    osc = {(r.device_id, r.t): r.osc for r in rolling_detrended_std(df, "pressure").collect()}
    for r in batch.collect():
        g = got[r.device_id, r.t]
        assert (g.locked, g.sustained, g.score) == (r.locked, r.sustained, r.score), r
        o = osc.get((r.device_id, r.t))
        assert g.osc == pytest.approx(o, abs=1e-9) if o is not None else g.osc is None or np.isnan(g.osc)
        assert g.fault == ((g.n_rules > 0 or r.exceeds or (not g.locked and g.sustained)) and r.t >= 599)
    assert not any(g.ordered for g in got.values())
    for d in (1, 2):  # no diagnosis succeeds: starts are as far apart as the longer of gap and duration, each the first fault from there
        faults, want, free = sorted(t for (k, t), g in got.items() if k == d and g.fault), [], 0
        for t in faults:
            if t >= free:
                want.append(t)
                free = t + max(processor.GAP, processor.TAKES)
        assert sorted(t for (k, t), g in got.items() if k == d and g.started) == want and len(want) > 5
    # the dew margin's line, by hand, at a minute's end
    e = [g for g in got.values() if g.eta is not None and not np.isnan(g.eta)]
    assert e
    for g in e[:5]:
        x, y = zip(*[(r[1], r[4]) for r in rows if r[0] == g.device_id and g.t - 119 <= r[1] <= g.t and r[4] is not None], strict=True)
        slope = np.polyfit(x, y, 1)[0]
        assert g.eta == pytest.approx((g.margin - 3) / -slope, rel=1e-6) and (g.t + 1) % 60 == 0 and g.t >= 599


def test_restart_orders_once(spark, tmp_path):
    """The query stops after the diagnosis has started, and again after the order: it goes on and issues none again."""
    first, then, last = ([reading(7, t, good=True) for t in range(a, b)] for a, b in ((0, 605), (605, 700), (700, 900)))
    for part in (first, then, last):
        spark.createDataFrame(part, READING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(READING).parquet(f"{tmp_path}/in")
        out = processor.run_available(spark, processor.live(stream), str(tmp_path))
    rows = sorted(out.collect(), key=lambda r: r.t)
    assert [r.t for r in rows] == list(range(900))
    started = [r.t for r in rows if r.started]
    assert len(started) == 1 and [r.t for r in rows if r.ordered] == [started[0] + processor.TAKES] and sum(r.fault for r in rows) > 5


def test_preload_is_state_only(spark, tmp_path):
    rows = [reading(1, t) for t in range(1400)] + [reading(2, t) for t in range(300)] + [reading(3, t) for t in range(500, 1400)]
    seed = spark.createDataFrame([r for r in rows if r[1] < 500], READING)
    cut = {(r.device_id, r.t): r for r in run(spark, f"{tmp_path}/a", [r for r in rows if r[1] >= 500], 3, seed).collect()}
    whole = {(r.device_id, r.t): r for r in run(spark, f"{tmp_path}/b", rows, 3).collect()}
    assert set(cut) == {k for k in whole if k[1] >= 500}
    for k, r in cut.items():
        assert (r.locked, r.sustained, r.score, r.n_rules) == (whole[k].locked, whole[k].sustained, whole[k].score, whole[k].n_rules)
        assert not r.fault or k[1] >= 1099  # the warm-up counts from the seed's end


def test_rows_without_device_take_no_part(spark):
    df = spark.createDataFrame([(None, 1, "a", 1.0, 2.0)], "device_id long, t long, operating_condition string, cabinet_temp double, cabinet_humidity double")
    missing = [c for c in ("inlet_temp", "outlet_temp", "pressure", "flow_rate", "conductivity") if c not in df.columns]
    assert processor.prepared(df.withColumns({c: F.lit(None).cast("double") for c in missing}), F.lit(0.0)).count() == 0


def events(spark, base, steps):
    """A file for each step: rows (key, seconds, id)."""
    for rows in steps:
        df = spark.createDataFrame(rows, "user_id long, s long, event_id long").select("user_id", F.timestamp_seconds(F.col("s") + 86400).alias("ts"), "event_id", F.lit(1.0).alias("value"))
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema("user_id long, ts timestamp, event_id long, value double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def test_sessions_go_stale_once(spark, tmp_path):
    steps = [[(1, 0, 0), (1, 10, 1), (2, 5, 2), (None, 5, 3)], [(1, 35, 4), (2, 36, 5)], [(3, 66, 6)], [(3, 100, 7), (2, 131, 8)]]
    out = processor.run_available(spark, sessions.stale_sessions(events(spark, tmp_path, steps), "user_id", "ts", 30), str(tmp_path))
    got = sorted((r.key, r.first_ts.timestamp() % 86400, r.last_ts.timestamp() % 86400, r.n) for r in out.collect())
    # device 2 is heard of 31 seconds later: stale at 35. Device 1 ends at 35, and at 131 the third ends with 100 by the watermark
    assert got == [(1, 0, 35, 3), (2, 5, 5, 1), (2, 36, 36, 1), (3, 66, 66, 1), (3, 100, 100, 1)]
    last = spark.createDataFrame([(1, 35), (3, 100), (2, 131)], "device_id long, t long")
    fresh = {r.device_id: r.fresh for r in st.freshness(last, F.lit(131)).collect()}
    assert fresh == {1: False, 2: True, 3: False}  # as the stream has it at the last event's time


def test_keys_of_a_group_go_stale_each_at_its_time(spark, tmp_path):
    """Keys beside one another, far apart and negative: some go on, some end by a later row, some by the watermark; few groups hold them."""
    rng = random.Random(7)
    keys = [*range(-3, 40), 255, 256, 257, (1 << 62) + 1, -(1 << 62)]
    steps = [sorted({(k, 200 * b + rng.randrange(200)) for k in keys for _ in range(rng.randrange(6))}, key=lambda r: r[1]) for b in range(4)]
    rows = [[(k, s, i) for i, (k, s) in enumerate(step)] for step in steps]
    stream = sessions.stale_sessions(events(spark, tmp_path, rows), "user_id", "ts", 30)
    with processor.rocksdb(spark):
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r.key, int(r.first_ts.timestamp()) - 86400, int(r.last_ts.timestamp()) - 86400, r.n) for r in spark.read.schema(sessions.STALE).parquet(f"{tmp_path}/out").collect())
    end, expected = max(s for step in steps for _, s in step), []
    for k in keys:
        run = []
        for s in [*(s for step in steps for x, s in step if x == k), None]:
            if run and (s is None or s - run[-1] > 30):
                if s is not None or run[-1] + 30 <= end:
                    expected.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(s)
    assert got == sorted(expected)
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) < len(keys)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    steps = [[(1, 1000, 1), (1, 1010, 2)], [(1, 1300, 3), (1, 1010, 2)], [(1, 1310, 4), (1, 1005, 5)], [(1, 905, 6), (1, 1700, 7)], [(1, 2500, 8)]]
    stream = event_time.once(events(spark, tmp_path, steps), "ts", "event_id", "100 seconds")
    out = event_time.windowed(stream, "ts", "user_id", "100 seconds")
    with processor.rocksdb(spark):
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((int(r.start.timestamp()) - 86400, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # 5 comes when the watermark of two batches before stands at 910, so it counts; 6 is before 1200
    assert got == [(1000, 3), (1300, 2), (1700, 1)]
    assert event_time.dropped(query) == 1


def test_sink_survives_failure_and_replay(spark, tmp_path, monkeypatch):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select(F.lit(1).cast("long").alias("device_id"), F.col("id").alias("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "device_id long, t long"
    calls = []

    def fails_once(batch, batch_id):
        calls.append(batch_id)
        if calls == [0, 1]:  # the data of the batch is written, its entry is not
            batch.write.mode("overwrite").parquet(f"{tmp_path}/sink/data/batch_id=1")
            raise RuntimeError("lost")
        write(batch, batch_id)

    write = sinks.persist_batches(f"{tmp_path}/sink")

    def go(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(fails_once).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        go("c")
    assert sinks.persisted(spark, f"{tmp_path}/sink", schema).count() == 10  # the broken batch doesn't count
    go("c")
    go("d")  # all batches again
    assert sorted(r.t for r in sinks.persisted(spark, f"{tmp_path}/sink", schema).collect()) == list(range(30))
    assert calls.count(1) == 3


def test_a_part_without_spread_is_one_file(spark, tmp_path):
    """However many splits it is read in: a stream that takes one file at a time gives it one batch."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1000")
        processor.in_order(spark, spark.range(0, 6000).withColumnRenamed("id", "t"), str(tmp_path / "in"), F.floor(F.col("t") / 2000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 3 and spark.read.parquet(str(tmp_path / "in")).count() == 6000


def test_history_and_stream_are_worked_out_once(spark):
    """Rows before the seed's end fill the state and give no frames; the rows are worked out once for both."""
    rows = [reading(d, t) for d in (1, 2) for t in range(900)]
    worked = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            worked.add(len(frame))
            yield frame

    df = spark.createDataFrame(rows, READING).repartition(3, "device_id").mapInPandas(count, READING)
    out = processor.over_files(spark, df, processor.live, F.floor(F.col("t") / 300), dealt=True, before=F.col("t") < 250)
    got = {(r.device_id, r.t): (r.score, r.locked, r.sustained) for r in out.collect()}
    assert worked.value == len(rows)
    assert set(got) == {(d, t) for d in (1, 2) for t in range(250, 900)}
    whole = processor.over_files(spark, spark.createDataFrame(rows, READING), processor.live, F.floor(F.col("t") / 300))
    assert got == {(r.device_id, r.t): (r.score, r.locked, r.sustained) for r in whole.where("t >= 250").collect()}


def test_live_step_takes_no_python_step_for_each_reading():
    """A device's readings of a batch are worked off in arrays: calls don't grow with the readings."""
    import cProfile
    import pstats

    class Held:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value or []

        def put(self, value):
            self.value = value

        update = put

    class Handle:
        getListState = getValueState = lambda self, *_: Held()

    def calls(n):
        p = processor.LiveProcessor()
        p.init(Handle())
        df = pd.DataFrame([reading(1, t) for t in range(n)], columns=[c.split()[0] for c in READING.split(", ")])
        profile = cProfile.Profile()
        profile.runcall(p._step, (1,), df, True)
        return pstats.Stats(profile).total_calls

    assert calls(8000) < calls(2000) + 4000
