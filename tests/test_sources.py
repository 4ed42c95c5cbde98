"""Files in and out: contracts, uploads, replays, digests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loopwatch import contract
from loopwatch.sources import store

HEAD = ",".join(contract.REQUIRED)


def line(ts, value):
    return ",".join([ts, *[value] * 12, "melting", "none"])


def test_csv_scan_coerces(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEAD, line("2026-08-20 00:00:00", "1.5"), line("bad", "NaN")]))
    rows = store.read_csv(spark, str(tmp_path / "a.csv")).orderBy(F.col("timestamp").asc_nulls_last()).collect()
    assert rows[0].pressure == 1.5 and rows[1].timestamp is None and rows[1].pressure is None
    (tmp_path / "b.csv").write_text("timestamp,pressure\n2026-08-20 00:00:00,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        store.read_csv(spark, str(tmp_path / "b.csv"))


def test_uploads_fill_the_contract(spark, tmp_path):
    (tmp_path / "u.json").write_text('[{"timestamp": "2026-08-20 00:00:01", "pressure": 3}, {"pressure": 4}]')
    (tmp_path / "u.jsonl").write_text('{"timestamp": "2026-08-20 00:00:01", "flow_rate": 2}\n{"timestamp": "2026-08-20 00:00:02"}\n')
    (tmp_path / "u.csv").write_text("timestamp,pressure\n2026-08-20 00:00:00,5\n")
    (tmp_path / "e.csv").write_text("timestamp,pressure\nbad,5\n")
    one = store.read_upload(spark, str(tmp_path / "u.json")).collect()
    assert [r.pressure for r in one] == [3.0] and one[0].flow_rate is None
    assert store.read_upload(spark, str(tmp_path / "u.jsonl")).count() == 2 and store.read_upload(spark, str(tmp_path / "u.csv")).first().pressure == 5.0
    with pytest.raises(ValueError, match="no readable rows"):
        store.read_upload(spark, str(tmp_path / "e.csv"))


def test_records(spark):
    out = contract.records(spark, [{"timestamp": "2026-08-20 00:00:00", "pressure": float("nan")}, {"timestamp": "2026-08-20 00:00:01", "pressure": 2, "extra": 1}, {"pressure": 3}]).orderBy("timestamp").collect()
    assert [r.pressure for r in out] == [None, 2.0] and out[0].asDict().keys() == set(contract.REQUIRED)


def test_replay_streams_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.csv").write_text("\n".join([HEAD, line(f"2026-08-20 00:00:0{i}", str(i))]))
    query = store.replay(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.pressure for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0.0, 1.0, 2.0]
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3


def test_digests(spark, tmp_path):
    store.write_jsonl(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1), str(tmp_path / "j"))
    (path,) = (tmp_path / "j").glob("part-*.json")
    rows = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in store.digests(spark, str(tmp_path / "j")).collect()}
    assert rows[path.name] == hashlib.sha256(path.read_bytes()).hexdigest()
    assert store.read_jsonl(spark, str(tmp_path / "j"), "k int, v string", strict=True).count() == 2
