"""op2: near-duplicate passages."""

from pyspark.sql import DataFrame, SparkSession

from loopwatch.llm import passages
from loopwatch.llm.common import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
