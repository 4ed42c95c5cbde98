"""op9: quality rules with adaptive cutoffs."""

from pyspark.sql import DataFrame, SparkSession

from loopwatch.llm import quality
from loopwatch.llm.common import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
