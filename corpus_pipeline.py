"""A corpus from raw documents in five stages: quality classifier, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.decontamination import without_leaks
from ledgerflow.llm.line_dedup import drop_repeated_lines
from ledgerflow.llm.near_dup import first_of_each
from ledgerflow.llm.packing import pack
from ledgerflow.llm.quality_classifier import accepted
from ledgerflow.llm.shared import drop_at_end, drop_now, new_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of documents that are still there, doesn't reject. Null and empty texts, null ids and repeated rows are judged like others; without labels all stay."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has; one that loses every line has an empty text, and near_duplicates() keeps one such."""
    return drop_repeated_lines(docs.select(*COLUMNS)).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    return first_of_each(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item. Null and empty texts stay; each row is judged by its own text."""
    return without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of 4096. Null and empty texts are the end id alone; repeated rows are packed each; an empty table gives no rows."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("packed", packed)]

#: Training, shingle signatures and tokenizers have no SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again as the next one's input. A stage's folder goes when the
    next one is written, the last one's at the end of the application."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        drop_at_end(spark, folder)
        if before:
            drop_now(spark, before)
        before = folder
    return docs
