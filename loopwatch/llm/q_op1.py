"""op1: links of near-duplicate documents, by word shingles."""

from pyspark.sql import DataFrame, SparkSession

from loopwatch.llm.common import table
from loopwatch.llm.ngram_join import link_components


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark, table(spark, sf_dir, "documents"))
