"""Quality control by blocks of time: long holes, edges of blocks, and rows that travel once."""

import math
import random

import pytest

from loopwatch.contract import CHANNELS, LABELS
from loopwatch.functions.features import BLOCK
from loopwatch.operators import quality as q


def readings(spark, channels=("pressure", "flow_rate")):
    """Two devices with repeated and late times, missing values and labels, and a hole of more than two blocks."""
    rng = random.Random(5)
    rows = []
    for d, start in ((1, 50), (2, BLOCK - 3)):
        times = [*range(start, start + 300, 2), *range(BLOCK - 150, BLOCK + 150), *range(3 * BLOCK + 500, 3 * BLOCK + 520)]
        times = sorted({t for t in times if rng.random() < 0.9 and t >= start}) + [start + 4, BLOCK + 1]
        for i, t in enumerate(times):
            value = lambda lo, hi: None if rng.random() < 0.2 else float("nan") if rng.random() < 0.02 else round(rng.uniform(lo, hi) + (rng.random() < 0.05) * 100, 2)  # noqa: B023, E731
            rows.append((d, t, i, value(250, 260), value(5, 6), rng.choice([None, "a", "b"]), None if d == 2 else rng.choice([None, "x"])))
    return spark.createDataFrame(rows, f"device_id long, t long, arrival_seq long, {channels[0]} double, {channels[1]} double, operating_condition string, fault_label string"), list(channels)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-9))


def test_grid_of_blocks_equals_the_joined_one(spark):
    raw, channels = readings(spark)
    want = {(r.device_id, r.t): r for r in q.fill_labels(q.to_grid(q.dedup_keep_first(raw))).collect()}
    got = {(r.device_id, r.t): r for r in q.on_grid(raw, labels=True).collect()}
    assert got.keys() == want.keys() and len(got) > 4 * BLOCK
    for k, w in want.items():
        assert all(same(got[k][c], w[c]) for c in ("arrival_seq", *channels, *LABELS)), k


def test_flags_equal_one_series(spark):
    raw, channels = readings(spark)
    series = {}
    for r in q.on_grid(raw).orderBy("t").collect():
        series.setdefault(r.device_id, []).append(r)
    flags = {(r.device_id, r.t): r for r in q.hampel_flags(raw, channels).collect()}
    jumps = {(r.device_id, r.t): r for r in q.rate_flags(raw, channels).collect()}
    middle = lambda x: (sorted(x)[(len(x) - 1) // 2] + sorted(x)[len(x) // 2]) / 2 if x else None
    checked = 0
    for d, rows in series.items():
        for c in channels:
            lo, hi = q.BOUNDS[c]
            y = [r[c] if r[c] is not None and lo <= r[c] <= hi else None for r in rows]
            level = middle([abs(v) for v in y if v is not None and abs(v) > 1e-6])
            near = lambda x, i: [v for v in x[max(0, i - 60) : i + 61] if v is not None]
            med = [middle(near(y, i)) if len(near(y, i)) >= 5 else None for i in range(len(y))]
            off = [abs(v - m) if v is not None and m is not None else None for v, m in zip(y, med, strict=True)]
            jump = [i > 0 and y[i] is not None and y[i - 1] is not None and abs(y[i] - y[i - 1]) > q.RATES[c] for i in range(len(y))]
            for i, r in enumerate(rows):
                sigma = max(1.4826 * middle(near(off, i)), 0.2, 0.02 * level) if len(near(off, i)) >= 5 else None
                f = flags[d, r.t]
                assert same(f[f"med_{c}"], med[i]) and same(f[f"sigma_{c}"], sigma), (d, c, r.t)
                assert f[f"is_outlier_{c}"] == (off[i] is not None and sigma is not None and off[i] > 5 * sigma)
                assert jumps[d, r.t][f"is_jump_{c}"] == (jump[i] or (i + 1 < len(y) and jump[i + 1]))
                checked += f[f"is_outlier_{c}"]
    assert checked


@pytest.mark.parametrize("by", ["line", "condition"])
def test_fills_reach_over_blocks(spark, by):
    raw, channels = readings(spark)
    grid = q.on_grid(raw, labels=True)
    got = {(r.device_id, r.t): r for r in (q.linear_fill if by == "line" else q.condition_fill)(grid, channels).collect()}
    rows = grid.orderBy("t").collect()
    for c in channels:
        seen = {}
        have = lambda r: r[c] is not None and not math.isnan(r[c])  # noqa: B023, E731
        for r in rows:
            seen.setdefault((r.device_id, by == "line" or r.operating_condition), []).append(r)
        for group in seen.values():
            before, after = [None] * len(group), [None] * len(group)
            for at, steps in ((before, range(len(group))), (after, range(len(group) - 1, -1, -1))):
                last = None
                for i in steps:
                    at[i] = last
                    last = group[i] if have(group[i]) else last
            for r, p, n in zip(group, before, after, strict=True):
                if have(r) or not (p and n):
                    want = r[c] if have(r) else p[c] if p else n[c] if n else None
                elif by == "line":
                    want = p[c] + (r.t - p.t) / (n.t - p.t) * (n[c] - p[c])
                else:
                    wp, wn = 1 / (r.t - p.t), 1 / (n.t - r.t)
                    want = (wp * p[c] + wn * n[c]) / (wp + wn)
                assert same(got[r.device_id, r.t][c], want), (c, r)


def test_a_condition_without_readings_takes_the_line_between_filled_ones(spark):
    rows = [(1, t, t, None if t % 4 == 3 else 250.0 + t % 2, "b" if t % 4 == 3 else "a", "x") for t in range(40)] + [(2, t, t, 250.0, "b", "x") for t in range(5)]
    raw = spark.createDataFrame(rows, "device_id long, t long, arrival_seq long, pressure double, operating_condition string, fault_label string")
    out = {(r.device_id, r.t): r.pressure for r in q.clean(raw, ["pressure"]).collect()}
    assert out[1, 3] == 250.0 and out[1, 39] == 250.0 and out[2, 4] == 250.0 and len(out) == 45


def test_fills_write_no_table_and_read_one_exchange(spark, monkeypatch):
    raw, channels = readings(spark)
    monkeypatch.setattr(q, "written", lambda df: pytest.fail("written"))
    monkeypatch.setattr("loopwatch.functions.scans.written", lambda df: pytest.fail("written"))
    for filled in (q.linear_fill(q.on_grid(raw), channels), q.condition_fill(q.on_grid(raw, labels=True), channels)):
        filled.write.format("noop").mode("overwrite").save()
        filled.collect()
        plan = filled._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan
    assert set(channels) <= set(CHANNELS)


def test_readings_without_device_or_time_take_no_part(spark):
    rows = [(1, 0, 0, 1.0), (1, 2, 1, None), (None, 5, 2, 1.0), (1, None, 3, 1.0)]
    raw = spark.createDataFrame(rows, "device_id long, t long, arrival_seq long, pressure double")
    assert sorted((r.device_id, r.t, r.pressure) for r in q.linear_fill(q.on_grid(raw), ["pressure"]).collect()) == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)]
