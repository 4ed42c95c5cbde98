"""A corpus pipeline of five stages over `documents`; each works on all that its predecessor kept.

Every stage but the last returns the columns of documents. Stages are written as Parquet in the shared folder and read again
by the next, so a lost executor costs a reread of one stage. Rows that a stage keeps may have new texts (line dedup) or be
read more than once (mixing, which repeats rows of small sources and leaves out part of large ones).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwatch.llm import common, line_runs, mixing, ngram_join, quality, sentencepiece_codec

#: A single line of so many words counts as a repeated run.
LONG_WORDS = 50
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive cutoffs. Each row carries its own verdict."""
    scratch = common.Scratch(spark)
    measured = quality.metrics(scratch.save(quality.text_features(docs, ("text", "n_chars")), "features"))
    verdicts = quality.judge(measured, quality.cutoffs(quality.sketches(measured)))
    return verdicts.where("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs and of long lines; one that loses every line goes."""
    out = line_runs.dedup(spark, docs, long_words=LONG_WORDS)
    left = out.where(~((F.col("n_deleted") > 0) & (F.col("n_deleted") == F.col("n_lines"))))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: the one with the smallest id, or without any if none has one.

    Rows are numbered and written first, so that repeated rows are told apart when they are read again."""
    scratch = common.Scratch(spark)
    docs = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("mark"), F.monotonically_increasing_id().alias("row"))
    docs = scratch.save(docs, "numbered")
    links = ngram_join.row_components(spark, docs, carry=("mark", "row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "row"))
    kept = links.where("n > 0").groupBy("comp").agg(first.alias("first")).select("first.row")
    kept = kept.unionByName(links.where("n = 0").select("row"))
    return docs.join(kept, "row", "left_semi").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources reads them."""
    return mixing.realise(mixing.plan(spark, docs), COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix."""
    return sentencepiece_codec.encode(spark, docs.select("doc_id", "text")).select("doc_id", "n_tokens", "exact", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]
#: The third and fifth stages can't be stated in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark)
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage_{k}")
            scratch.drop(f"stage_{k - 1}")
    return docs
