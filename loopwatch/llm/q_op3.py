"""op3: SentencePiece ids of every document, with a check of the round trip."""

from pyspark.sql import DataFrame, SparkSession

from loopwatch.llm import sentencepiece_codec
from loopwatch.llm.common import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(spark, docs).select("doc_id", "n_tokens", "exact", "ids")
