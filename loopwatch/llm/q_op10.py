"""op10: languages of all documents."""

from pyspark.sql import DataFrame, SparkSession

from loopwatch.llm import langid
from loopwatch.llm.common import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(spark, docs, langid.train(spark, docs))
