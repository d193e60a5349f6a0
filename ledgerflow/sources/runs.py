"""Folders of runs: one folder for each run, its files as they are, and the record that says how it ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a run's record says of it.
RECORD = (
    "run_id string, scope string, job struct<job_id:string,filing_id:string,input_sha256:string,entity:string,filing_type:string,reporting_period:string>, "
    "status string, error_type string, error string, pages string, selected_pages array<int>, workbook string, workbook_sha256 string, process_exit_code int"
)


def inside(path: Column) -> Column:
    """Whether a relative path stays within its folder: not absolute, no drive, no step up."""
    plain = F.translate(path, "\\", "/")
    steps = F.split(plain, "/")
    return ~plain.rlike(r"^(?:/|[A-Za-z]:)") & ~F.exists(steps, lambda s: s.isin("..", "")) & (F.length(plain) > 0)


def load(spark: SparkSession, root: str, levels: int = 1) -> DataFrame:
    """run_id, path, length, content of every file under root: the first `levels` folders name the run, the rest is the path in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = root.removeprefix("file://").rstrip("/")
    below = F.split(F.substr("path", F.locate(plain, F.col("path")) + len(plain) + 1), "/")
    named = files.withColumn("_parts", below).filter(F.size("_parts") > levels)
    join = lambda start, n: F.array_join(F.slice("_parts", start, n), "/")
    return named.select(join(F.lit(1), F.lit(levels)).alias("run_id"), join(F.lit(levels + 1), F.size("_parts")).alias("path"), "length", "content")


def digests(files: DataFrame, *keep: str) -> DataFrame:
    """files with sha256 in place of their content."""
    return files.select("run_id", *keep, "path", F.sha2("content", 256).alias("sha256"))


def records(files: DataFrame, name: str = "result.json") -> DataFrame:
    """The record of each run; one that can't be read is a run of status `unreadable`."""
    read = files.filter(F.col("path") == name).select("run_id", F.from_json(F.decode("content", "UTF-8"), RECORD).alias("r"))
    fields = [c.split()[0] for c in ("scope", "error_type", "error", "pages", "selected_pages", "workbook", "workbook_sha256", "process_exit_code", "job")]
    return read.select("run_id", F.coalesce("r.status", F.lit("unreadable")).alias("status"), *[F.col(f"r.{f}").alias(f) for f in fields])
