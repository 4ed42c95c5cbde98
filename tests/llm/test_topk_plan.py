"""The exact search sends no table through the driver."""

from pyspark.sql import functions as F

from loopwatch.llm import topk


def test_search_broadcasts_nothing(spark):
    rows = [(i, [((i * 37 + j * 11) % 19) / 19 - 0.5 for j in range(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.search(spark, df, F.col("vec_id") % 50 == 0)
    got = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(got) == 30 and "SortMergeJoin" in plan and "Broadcast" not in plan
