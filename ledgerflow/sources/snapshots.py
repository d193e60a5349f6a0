"""Captured pages of PDF filings: text, words, rules and candidate tables as one JSON or Parquet row for each page. The reader that captured them is outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = (
    "doc_id string, number int, width double, height double, text string, n_images int, n_curves int, words array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>, "
    "tables array<struct<bbox:array<double>,cells:array<array<double>>,rows:array<array<array<double>>>,extracted:array<array<string>>>>, "
    "candidates array<struct<flavor:string,rows:array<array<string>>,accuracy:double,whitespace:double,ord:int,row_bounds:array<array<double>>,column_bounds:array<array<double>>>>, "
    "edges array<struct<x0:double,x1:double,top:double,bottom:double>>"
)


def load(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.format(format).schema(PAGE).load(path)


def pages(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("doc_id", F.col("number").alias("page"), "text", "n_images", "n_curves")


def words(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("doc_id", F.col("number").alias("page"), F.posexplode("words").alias("word", "w")).select("doc_id", "page", "word", "w.*")


def edges(snapshots: DataFrame) -> DataFrame:
    """Rules and boxes as they were captured: doc_id, source_page, x0, x1, top, bottom."""
    return snapshots.select("doc_id", F.col("number").alias("source_page"), F.explode("edges").alias("e")).select("doc_id", "source_page", "e.*")


def ruled_cells(snapshots: DataFrame) -> DataFrame:
    """Cells of the tables that rules on the page bound."""
    tables = snapshots.select("doc_id", F.col("number").alias("source_page"), F.posexplode("tables").alias("_t", "t"))
    rows = tables.select("doc_id", "source_page", F.format_string("P%04d_T%02d", "source_page", F.col("_t") + 1).alias("table_id"), F.posexplode("t.extracted").alias("row_index", "_row"))
    return rows.select("*", F.posexplode("_row").alias("column_index", "raw_text")).drop("_row").withColumn("flavor", F.lit("ruled"))


def candidate_tables(snapshots: DataFrame) -> DataFrame:
    each = snapshots.select("doc_id", F.col("number").alias("source_page"), F.posexplode("candidates").alias("_c", "c"))
    return each.select("doc_id", "source_page", F.concat(F.format_string("P%04d_", "source_page"), F.col("c.flavor"), F.format_string("_%02d", F.col("_c") + 1)).alias("table_id"), "c.*")
