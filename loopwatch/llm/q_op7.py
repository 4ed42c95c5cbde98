"""op7: license scans by diagonal voting."""

from pyspark.sql import DataFrame, SparkSession

from loopwatch.llm import licenses
from loopwatch.llm.common import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents"))
