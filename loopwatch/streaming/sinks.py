"""Sinks that a restarted query may write to again: a batch that was written before changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def persist_batches(path: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: writes what keep leaves of a batch to path/data/batch_id=N, then an entry of the ledger
    path/ledger/batch_id=N. A batch whose entry stands is passed over; one that broke off before it is written anew over its own
    folder, so nothing is held twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entry = f"{path}/ledger/batch_id={batch_id}"
        if _exists(spark, f"{entry}/_SUCCESS"):
            return
        data = f"{path}/data/batch_id={batch_id}"
        (keep(batch) if keep else batch).write.mode("overwrite").parquet(data)
        counted = spark.read.schema(batch.schema).parquet(data).agg(F.count(F.lit(1)).alias("n_rows"))
        counted.coalesce(1).write.mode("overwrite").parquet(entry)

    return write


def persisted(spark: SparkSession, path: str, schema) -> DataFrame:
    """What has been persisted: only batches with an entry in the ledger count."""
    done = spark.read.parquet(f"{path}/ledger").select("batch_id")
    rows = spark.read.schema(schema.add("batch_id", "long") if hasattr(schema, "add") else f"{schema}, batch_id long").parquet(f"{path}/data")
    # one row for each batch
    return rows.join(F.broadcast(done), "batch_id", "left_semi")
