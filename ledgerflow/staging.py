"""Lineage ends at checkpoints in the folder that the session's machines share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that a task lays pages out from: a row becomes a dozen words and rules, which go through as many sorts.
DEALT_ROWS = 50_000


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to spark.checkpoint.dir: what follows doesn't compute it again, nor does a lost executor's work. Where no folder is set, a
    session that is one process (tests) gets one of its own; a cluster gets an error, as its machines don't see each other's local folders."""
    _folder(df.sparkSession)
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(at or f"file://{tempfile.mkdtemp(prefix='ledgerflow-')}")
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df as cut() keeps it, but as compressed columns: for tables with a row or more for each input row. The files go when the application ends."""
    spark = df.sparkSession
    at = f"{_folder(spark)}/ledgerflow-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def dealt(table: DataFrame, *keys: str, each: int = DEALT_ROWS) -> DataFrame:
    """table dealt by its keys over parts() of it: windows and groups by these keys and others stay where the rows are, and what a task sorts is bounded by
    `each`, not by the table. A key with more rows than that is still one task's."""
    return table.repartition(parts(table, each), *keys)


def parts(table: DataFrame, each: int = 250_000) -> int:
    """Partitions of about `each` rows of a table, but no fewer than the session has: what a task holds doesn't grow with the table. The rows are counted; of
    files that is reading footers."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(table.count() / each))
