"""A time-series store of Parquet files partitioned by a time bucket: scans that prune, latest rows, stats, inserts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopwatch.contract import REQUIRED, fill_contract, validate

BUCKET = 3600
#: Buckets that a filter lists.
MOST_BUCKETS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where the session names none, one process may take a
    new temporary folder; a cluster may not."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = getattr(shared_folder, "own", None) or f"file://{tempfile.mkdtemp(prefix='loopwatch-')}"
        shared_folder.own = root
    return f"{root.rstrip('/')}/loopwatch"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: what several branches of a plan go on from, and what a lost executor costs no
    more than a reread."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.withColumn("bucket", F.floor(F.col("t") / BUCKET).cast("bigint")).write.mode("append").partitionBy("bucket").parquet(path)


def range_scan(df: DataFrame, start: int, end: int, condition: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Readings from start to end, both included; the bucket filter prunes partitions where the store has them."""
    out = df.where(F.col("t").between(start, end))
    if "bucket" in df.columns:
        out = out.where(F.col("bucket").between(start // BUCKET, end // BUCKET))
    if condition:
        out = out.where(F.col("operating_condition") == condition)
    return out.select(*columns) if columns else out


def latest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("t"), "device_id").limit(n)


def insert_ignore(stored: DataFrame, new: DataFrame, key: list[str], arrival: str = "arrival_seq") -> DataFrame:
    """The new rows whose key the store doesn't hold; of rows with one key the first by `arrival`."""
    first = new.groupBy(*key).agg(F.min_by(F.struct(*(c for c in new.columns if c not in key)), arrival).alias("_r")).select(*key, "_r.*")
    return first.select(*new.columns).join(stored.select(*key), key, "left_anti")


def insert(spark: SparkSession, path: str, new: DataFrame, key: list[str], arrival: str = "arrival_seq", files: int = 4) -> None:
    """Writes the new rows whose key the store at path doesn't hold yet. Only the buckets that gain rows are read whole, and they are
    written anew, each in a few files, by overwriting those partitions alone; doing it again changes nothing. One writer at
    a time. A bucket's readings are dealt by key, so a full one is no task of its own."""
    new = new.withColumn("bucket", F.floor(F.col("t") / BUCKET).cast("bigint"))
    stored = _existing(spark, path, new.schema)
    rows = new.withColumn("_new", F.lit(1))
    if stored is not None:
        # keys alone tell which buckets gain a row; those that gain none stay as they are
        gains = new.select(*key, "bucket").join(stored.select(*key), key, "left_anti").select("bucket").distinct()
        gains = [r["bucket"] for r in gains.orderBy("bucket").limit(MOST_BUCKETS + 1).collect()]
        if not gains:
            return
        if len(gains) <= MOST_BUCKETS:
            inside = F.col("bucket").isin(gains)
        else:  # more buckets than a filter should list: the span that the new rows cover
            inside = F.col("bucket").between(*new.agg(F.min("bucket"), F.max("bucket")).first())
        if None in gains:  # rows without a time have a bucket of their own, which no comparison finds
            inside = inside.eqNullSafe(True) | F.col("bucket").isNull()
        rows = rows.where(inside).unionByName(stored.where(inside).select(*new.columns).withColumn("_new", F.lit(0)))
    # one exchange by bucket and a share of its keys serves the choice of each key's row and the writing
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(*key), F.lit(files))).repartition("bucket", "_share")
    each = Window.partitionBy("bucket", "_share", *key).orderBy("_new", arrival)
    kept = dealt.withColumn("_k", F.row_number().over(each)).where((F.col("_k") == 1) | (F.col("_new") == 0)).drop("_k", "_new", "_share")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _existing(spark: SparkSession, path: str, schema) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(schema).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store, its bucket as a column that filters prune by."""
    return spark.read.parquet(path).withColumn("bucket", F.col("bucket").cast("bigint"))


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """bucket, n_rows, n_files and bytes of each partition of a store, from the files' own metadata; no column is read."""
    files = spark.read.parquet(path).select(F.col("bucket").cast("bigint").alias("bucket"), "_metadata.file_path", "_metadata.file_size")
    each = files.groupBy("bucket", "file_path", "file_size").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("bucket").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.sum("file_size").alias("bytes"))


def partition_stats(df: DataFrame) -> DataFrame:
    return df.groupBy(F.floor(F.col("t") / BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines. Blank and malformed lines are passed over, or raise if strict."""
    return parse_jsonl(spark.read.text(path), schema, strict)


def parse_jsonl(lines: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    lines = lines.where(F.trim("value") != "")
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select(F.from_json("value", schema if strict else f"{schema}, _bad string", options).alias("r"))
    return parsed.select("r.*") if strict else parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def strict_json(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON lines; one with a bare NaN or Infinity, which Spark would read, counts as malformed and goes."""
    bare = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*"', '""').rlike(r"NaN|Infinity")
    return parse_jsonl(lines.where(~bare), schema)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of the contract: all columns must be there, what can't be read becomes null."""
    return validate(spark.read.option("header", True).csv(path))


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded file, JSON by its ending, else CSV: missing columns are null, rows without a timestamp go, an empty one raises."""
    lines = path.rstrip("/").endswith(".jsonl")
    raw = spark.read.option("multiLine", not lines).json(path) if lines or path.rstrip("/").endswith(".json") else spark.read.option("header", True).csv(path)
    out = fill_contract(raw)
    if out.isEmpty():
        raise ValueError(f"no readable rows in {path}")
    return out


def replay(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over a folder of CSV files in the order they came, `files` for each batch."""
    schema = ", ".join(f"{c} string" for c in REQUIRED)
    return fill_contract(spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files).csv(path))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of each file of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, n_rows and mark: an order-free digest of a table's rows, whole or by part. Rows in other files, partitions or order give
    the same; a changed, missing or repeated row gives another. A row's mark is the hash of its columns in the order of their names;
    sums of two independent hashes stand for the set."""
    by = by or []
    columns = [F.col(c) for c in sorted(df.columns)]
    part = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    digest = F.md5(text)
    low, high = (F.conv(F.substring(digest, k, 15), 16, 10).cast("bigint") for k in (1, 17))
    marked = df.select(*by, low.alias("_low"), high.alias("_high"))
    return marked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", part(F.col("_low")), part(F.col("_high"))).alias("mark"))


def write_with_manifest(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Writes rows to path/data, then what was written, read again: path/manifest with the rows' digests, path/files with the files'."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/data")
    manifest(spark.read.schema(df.schema).parquet(f"{path}/data"), by).write.mode("overwrite").parquet(f"{path}/manifest")
    digests(spark, f"{path}/data").withColumn("path", F.element_at(F.split("path", "/"), -1)).write.mode("overwrite").parquet(f"{path}/files")


def read_verified(spark: SparkSession, path: str, by: list[str] | None = None, files: bool = True) -> DataFrame:
    """The rows of write_with_manifest; raises ValueError where the rows' digests, or the files' unless `files` is false (rows that
    were moved to other files), aren't those of the manifest."""
    rows = spark.read.parquet(f"{path}/data")
    checks = [(manifest(rows, by), spark.read.parquet(f"{path}/manifest"))]
    if files:
        now = digests(spark, f"{path}/data").withColumn("path", F.element_at(F.split("path", "/"), -1))
        checks.insert(0, (now, spark.read.parquet(f"{path}/files")))
    for now, then in checks:
        off = now.exceptAll(then.select(*now.columns)).unionByName(then.select(*now.columns).exceptAll(now))
        if bad := off.limit(3).collect():
            raise ValueError(f"{path} is not what its manifest says: {bad}")
    return rows


def latest_series(df: DataFrame, channels: list[str], n: int = 600) -> DataFrame:
    """Per device its last n readings as one array for each channel, in time order."""
    w = Window.partitionBy("device_id").orderBy(F.desc("t"))
    last = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    held = F.array_sort(F.collect_list(F.struct("t", *channels)))
    return last.groupBy("device_id").agg(held.alias("s")).select("device_id", *(F.col(f"s.{c}").alias(c) for c in ("t", *channels)))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
