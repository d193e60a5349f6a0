"""Text sources: pasted text, and pages of text that other readers captured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.text import normalize


def pasted(spark: SparkSession, texts: dict[str, str] | DataFrame) -> DataFrame:
    """texts(doc_id, text) as lines."""
    frame = texts if isinstance(texts, DataFrame) else spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    return exploded(frame, F.lit(None).cast("int")).withColumn("page_status", F.lit("PASTED_TEXT"))


def exploded(frame: DataFrame, page) -> DataFrame:
    """doc_id, source_page, line_no, raw_text, normalized_text of each line of a text column; lines end at \\n, \\r\\n or \\r."""
    cut = frame.select("doc_id", page.alias("source_page"), F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?:\r\n|\r|\n)$", ""), r"\r\n|\r|\n", -1)).alias("_n", "raw_text"))
    return cut.select("doc_id", "source_page", (F.col("_n") + 1).alias("line_no"), "raw_text", normalize(F.col("raw_text")).alias("normalized_text"), F.lit(True).alias("machine_readable"))


def page_lines(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text, n_images, n_curves) as lines with page_status. An empty page with images or many curves must be read optically; other empty ones are blank; each is one line."""
    graphics = (F.coalesce("n_images", F.lit(0)) > 0) | (F.coalesce("n_curves", F.lit(0)) > 10) if {"n_images", "n_curves"} <= set(pages.columns) else F.lit(False)
    status = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", "TEXT_EXTRACTED").when(graphics, "OCR_REQUIRED").otherwise("BLANK")
    marked = pages.select("doc_id", F.col("page").alias("_page"), "text", status.alias("page_status"))
    cut = exploded(marked.withColumn("doc_id", F.struct("doc_id", "page_status")), F.col("_page"))
    return cut.select("doc_id.doc_id", "source_page", "line_no", "raw_text", "normalized_text", (F.col("doc_id.page_status") == "TEXT_EXTRACTED").alias("machine_readable"), "doc_id.page_status")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page").alias("page_count"))
