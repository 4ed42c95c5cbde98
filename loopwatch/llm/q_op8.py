"""op8: sources mixed to target weights."""

from pyspark.sql import DataFrame, SparkSession

from loopwatch.llm import mixing
from loopwatch.llm.common import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(spark, table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "weight", "copies")
