"""Filings as they arrive: an extension beyond batch extraction, which it calls for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow import api


def watch_html(spark: SparkSession, folder: str, output: str, checkpoint: str, available_now: bool = True):
    """A streaming query that appends values and checks of each new HTML filing. Batches are written under their number, so that a repeated batch replaces itself."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        result = api.extract_html(batch.filter(F.lower("path").rlike(r"\.x?html?$")).select(F.col("path").alias("doc_id"), "content"))
        result.values.write.mode("overwrite").parquet(f"{output}/values/batch={number}")
        result.checks.write.mode("overwrite").parquet(f"{output}/checks/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
