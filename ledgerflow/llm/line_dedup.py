"""Line deduplication over a whole collection, in DataFrame operations alone: what is shuffled are hashes and places of lines, what comes back are bitmaps."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.shared import heavy_keys, partitions, spread, staged

BLANKS = " \t\n\x0b\x0c\r"
#: The id that stands for a null one inside the operator: null ids are one document, after all others.
NULL_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A to Z in lower case. A text of single bytes takes the faster way."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def text_lines(text: Column) -> Column:
    """Null and empty texts: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, least_chars: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each document that loses lines: its id, the hash of its text, the number of lines that go, and the bitmap of these.

    A line goes if its key (see line_key) has at least least_chars code points and stands in a document with a smaller id too. The bitmap is sparse: words
    of 64 lines by their number, and words without a dropped line aren't there. Two seeds of a 64-bit hash stand for a key (128 bits).

    Hashes are range-partitioned and sorted by document and position, and a running first value tells each line's first document. A hash with more than
    a thousandth of all lines would fill a task; there are a thousand of these at most, their first documents come from a sum with partial aggregates, and
    their lines meet those in a broadcast join.
    """
    lines = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_column).alias("text_hash"), F.posexplode(text_lines(F.col(text_column))).alias("pos", "line"))
    key = line_key(F.col("line"))
    found = lines.withColumn("key", key).filter(F.char_length("key") >= least_chars).select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    found = staged(found, "lines")
    heavy = F.broadcast(heavy_keys(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first")), found.count()).select("h1", "h2", "first"))
    marked = found.join(heavy, ["h1", "h2"], "left")
    n = partitions(docs.sparkSession)
    rest = marked.filter(F.col("first").isNull()).drop("first").repartitionByRange(n, "h1", "h2").sortWithinPartitions("h1", "h2", "id", "pos")
    stream = Window.partitionBy("h1", "h2").orderBy("id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = rest.withColumn("first", F.first("id").over(stream))
    gone = marked.filter(F.col("first").isNotNull()).unionByName(rest).filter(F.col("id") > F.col("first"))
    words = gone.groupBy("id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(pos % 64))")).alias("bits"))
    return words.groupBy("id", "text_hash").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with kept_text, n_lines and n_dropped. Texts aren't sorted: the bitmaps, which are small, are the hashed side of the join. A row that is repeated
    very often (null ids and texts, above all) is dealt over salts; rows are counted by id and hash of the text before texts are shuffled."""
    others = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    row = F.struct(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_column).alias("text_hash"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("doc"), F.col(text_column).alias("text"), row.alias("row"), F.monotonically_increasing_id().alias("at"))
    joined = spread(own, bitmaps.select(F.struct("id", "text_hash").alias("row"), "n_dropped", "dropped"), "row", "at", "left", hashed=True)
    lines = text_lines(F.col("text"))
    kept = F.filter(lines, lambda line, i: F.coalesce(F.getbit(F.try_element_at(F.col("dropped"), F.floor(i / 64).cast("int")), F.pmod(i, F.lit(64))), F.lit(0)) == 0)
    text = F.when(F.col("n_dropped").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return joined.select("doc.*", text.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with kept_text, n_lines and n_dropped: see repeated_lines.

    Null and empty texts have one empty line, which stays; a repeated row (same id and text) is treated like its twin, as lines leave a document only for
    one with a smaller id; null ids count as one document after all others; an empty table gives no rows; other columns pass through unless they have the
    names of the three new ones.
    """
    return keep_lines(docs, repeated_lines(docs, least_chars, id_column, text_column), id_column, text_column)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op9_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT k.doc_id, pos, line, coalesce(k.doc_id > first, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
