"""What several operators of this subpackage need: staged tables in the shared folder, heavy keys, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as heavy from this share of the rows on; so at most 1 / HEAVY_SHARE keys are heavy, whatever the input.
HEAVY_SHARE = 0.001
#: Keys with fewer rows than this are never heavy: one task copes with them at any share.
HEAVY_LEAST = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a session that is one process (tests) gets a folder of
    its own; a cluster gets an error, as its machines wouldn't see each other's local folders."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='ledgerflow-')}"
        spark.sparkContext.setCheckpointDir(at)
        drop_at_end(spark, at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/ledgerflow-{uuid.uuid4().hex[:12]}-{what}"


def drop_at_end(spark: SparkSession, at: str) -> None:
    """A folder that is there goes when the application ends: until then, DataFrames that read it can run again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def drop_now(spark: SparkSession, at: str) -> None:
    """A folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and lost executors cost no recomputation of it."""
    spark, at = df.sparkSession, new_folder(df.sparkSession, what)
    df.write.parquet(at)
    drop_at_end(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(counts: DataFrame, rows: int, n: str = "n") -> DataFrame:
    """Of one row per key with its number of rows `n`: those with at least HEAVY_SHARE of all `rows` (and HEAVY_LEAST), so at most 1 / HEAVY_SHARE rows, which can be broadcast."""
    return counts.filter(F.col(n) >= max(HEAVY_LEAST, int(rows * HEAVY_SHARE)))


def spread(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", rows_per_task: int = HEAVY_LEAST, counts: DataFrame | None = None, total: int | None = None, n: str = "n", hashed: bool = False) -> DataFrame:
    """left join right on `key`, where right has one row per key and a few keys may hold most of left.

    A heavy key of left is dealt over ceil(rows / rows_per_task) salts (from `by`), and right's row is repeated once for each of them: at most
    rows(left) / rows_per_task rows more. The list of heavy keys is bounded by HEAVY_SHARE. counts(key, n) and total may be given where they are known.
    hashed: right is narrow beside left, so its share of a partition is the hashed side and left isn't sorted.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n")) if counts is None else counts.select(key, F.col(n).alias("_n"))
    total = left.count() if total is None else total
    heavy = F.broadcast(heavy_keys(counts, total, "_n").select(F.col(key).alias("_key"), F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts")))
    salted = left.join(heavy, F.col(key) == F.col("_key"), "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"))).drop("_key", "_salts")
    copies = right.join(heavy, F.col(key) == F.col("_key"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_key", "_salts")
    return salted.join(copies.hint("shuffle_hash") if hashed else copies, [key, "_salt"], how).drop("_salt")


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null: ''."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the texts of one have about most_bytes at most (one text may have more): a few very long texts don't add up in memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)))
        at = 0
        while at < batch.num_rows:
            start = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, start + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
