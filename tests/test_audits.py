"""Audits of samples and sets: each check by hand, nulls included."""

from pyspark.sql import functions as F

from loopwatch.operators import audit as au

NAMES = {"pump": "P", "filter": "F"}
STAT = [("pressure", 1.0, 0.5, 0.0)]


def sample(i, **other):
    base = {
        "sample_id": i, "split": "train", "version": au.VERSION, "roles": au.ROLES, "prompt": "p", "observed": STAT, "reference": STAT, "hidden": [], "unavailable": "", "support": {"pump": 1.0, "filter": 0.2},
        "gold_causes": ["P"], "gold": "P", "gold_more": False, "root_causes": ["P"], "root_cause": "P", "more": False, "confidence": 0.9, "evidence": ["pressure均值 1.0，去趋势标准差 0.5，每分钟变化 0.0"], "sop": ["x"],
        "input": f"i{i}", "seed": i, "episode_id": f"e{i // 2}", "equipment_id": f"m{i}", "window_end": 1200 if i % 2 == 0 else 1800,
    }
    row = base | other
    return tuple(row[f.split()[0]] for f in ("sample_id split version roles prompt observed reference hidden unavailable support gold_causes gold gold_more root_causes root_cause more confidence evidence sop input seed episode_id equipment_id window_end").split())


CASES = {
    0: ({}, set()),
    1: ({"split": "test"}, {"split"}),
    2: ({"version": None}, {"version"}),
    3: ({"roles": ["user"]}, {"roles"}),
    4: ({"prompt": "its episode_id"}, {"secret"}),
    5: ({"reference": [("flow", 1.0, 0.5, 0.0)]}, {"reference_channels"}),
    6: ({"hidden": ["pressure"], "unavailable": "压力"}, {"hidden_exposed"}),
    7: ({"observed": [("pressure", float("nan"), 0.5, 0.0)]}, {"finite", "evidence"}),
    8: ({"reference": [("pressure", 1.0, -0.5, 0.0)]}, {"deviation"}),
    9: ({"support": {"pump": 1.0, "filter": float("inf")}}, {"support", "causes", "text"}),
    10: ({"root_causes": ["F"]}, {"causes"}),
    11: ({"more": None}, {"flag", "flag_match"}),
    12: ({"more": True}, {"flag_match"}),
    13: ({"root_cause": "F"}, {"text"}),
    14: ({"confidence": 1.01}, {"confidence"}),
    15: ({"confidence": None}, {"confidence"}),
    16: ({"evidence": []}, {"evidence"}),
    17: ({"evidence": ["pressure均值 1.1"]}, {"evidence"}),
    18: ({"sop": ["x", " "]}, {"sop"}),
    19: ({"hidden": ["flow"], "unavailable": "流量", "evidence": ["缺失通道：流量"]}, set()),
    20: ({"support": {"pump": 0.1, "filter": 0.2}, "gold_causes": [], "root_causes": [], "gold": au.NORMAL, "root_cause": au.NORMAL}, set()),
    21: ({"support": {"pump": 2.0, "filter": 1.0}, "gold_causes": ["F", "P"], "root_causes": ["F", "P"], "gold": "F + P", "root_cause": "F + P"}, set()),
}


def test_each_check(spark):
    df = spark.createDataFrame([sample(i, **o) for i, (o, _) in CASES.items()], au.SAMPLE)
    got: dict = {}
    for r in au.audit_rows(df, NAMES).collect():
        got.setdefault(r.sample_id, set()).add(r.failed)
    assert got == {i: want for i, (_, want) in CASES.items() if want}


def test_sets(spark):
    rows = [sample(i) for i in range(4)] + [sample(4, split="val", episode_id="e0", seed=1), sample(5, split="val", input="i4", seed=9), sample(6, split="eval", equipment_id="m1")]
    df = spark.createDataFrame(rows, au.SAMPLE)
    history = spark.createDataFrame([("i3", 77), (None, 9), ("zz", None)], "input string, seed long")
    assert {(r.check, r.split): r.n for r in au.audit_sets(df, history).collect()} == {("duplicate_input", "val"): 1, ("episode_windows", "val"): 2, ("episode_windows", "eval"): 1, ("historical_input", "train"): 1, ("historical_seed", "val"): 1}
    shared = {(r.identity, r.check): r.n for r in au.identity_overlaps(df).collect() if r.n}
    assert shared == {("seed", "train_vs_val"): 1, ("episode_id", "train_vs_val"): 1, ("equipment_id", "train_vs_eval"): 1}
    assert au.audit_sets(df.where("false")).collect() == []
    leaks = {r.check: r.n for r in au.leak_checks(df.where("sample_id < 3"), df.where("sample_id in (3, 4)"), df, df).collect()}
    assert leaks == {"prompts_vs_sft_eval": 0, "stress_vs_sft_eval": 0, "stress_vs_prompts": 0, "prompts_vs_sft_train_val": 3, "pool_seeds_vs_sft_seeds": 6, "stress_seeds_vs_sft_seeds": 2, "stress_seeds_vs_pool_seeds": 2}


def test_tables_and_cases(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), (None, "z")], "gold string, pred string")
    assert {r.gold: (r.pred_a, r.pred_b, r.pred_other) for r in au.confusion_table(df, ["a", "b"]).collect()} == {"a": (1, 1, 0), "b": (0, 0, 1), None: (0, 0, 1)}
    feedback = spark.createDataFrame([(1, "p", None, "x", True), (2, "", "o", "x", True), (3, "p", "o", None, True), (4, "p", "o", "x", None)], "order_id long, prompt string, output string, actual string, is_true_fault boolean")
    seeds = spark.createDataFrame([(9, k, "g", "p", "a") for k in ("boundary", "clear", None)], "doc_id long, kind string, gold string, prompt string, answer string")
    assert sorted((r.case_id, r.source, r.answer) for r in au.regression_cases(feedback, seeds).collect()) == [(1, "feedback", ""), (9, "curated_eval", "a")]
    pool = au.split_pool(spark.createDataFrame([(i, "f", i * 1.0 if i else None) for i in range(6)], "case_id long, fault string, v double"), F.col("v") > 2, 4)
    assert sorted((r.case_id, r.kind) for r in pool.collect()) == [(0, "clear"), (1, "clear"), (2, "clear"), (3, "boundary")]
