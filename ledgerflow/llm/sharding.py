"""Sharding: proportional stratified interleaving, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.shared import partitions, staged

#: Rows that one window group holds on average, and window groups at most (their first ranks are broadcast); beyond, groups grow.
GROUP_ROWS, MOST_GROUPS = 1000, 1 << 22


def seeded(seed: int, *columns: Column) -> Column:
    """60 bits of an MD5 over the seed and the columns, as a long: the shuffle key."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int, seed: int = 7, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", group_rows: int = GROUP_ROWS, most_groups: int = MOST_GROUPS) -> DataFrame:
    """Deal rows to shards so that each shard has the sources' mixture.

    Within each source, rows are ranked in a seeded shuffle; rank / size of the source is a row's place between 0 and 1; all rows are ordered by that
    place, and the order is cut in `shards` runs whose counts differ by one at most. Returns id, source, size (UTF-8 bytes and 8), text_crc32, shard, slot
    (from 0, gapless in each shard).

    Both ranks are split: rows fall in even groups by their shuffle key (or place), a group's first rank is the number of rows in earlier groups, and only
    the rest is a window. So a source with a third of all rows is no larger a task than others, and only narrow rows are shuffled. Rows that are equal in id,
    source, size and CRC are one counted row until they are ranked, so that repeats don't fill a group, and then take as many ranks in a row; they become
    rows again in pieces of group_rows at most, each in some task.

    Null texts count no bytes and have the CRC of an empty text; null sources are a source of their own; null and repeated ids are ranked like others, apart
    by CRC and size (rows that are equal in all three are interchangeable). Empty input gives no rows; other columns aren't read.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    alike = staged(narrow.groupBy("id", "source", "size", "text_crc32").agg(F.count("*").alias("n")), "narrow")
    rows = alike.agg(F.sum("n")).first()[0] or 0
    groups = min(most_groups, max(1, -(-rows // group_rows)))
    step = ((1 << 60) // groups) + 1
    order = [F.col(c) for c in ("key", "id", "text_crc32", "size")]
    keyed = alike.withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))).withColumn("key", seeded(seed, *[F.col(c) for c in ("source_key", "id", "text_crc32", "size")])).withColumn("group", F.floor(F.col("key") / step).cast("int"))

    counts = keyed.groupBy("source_key", "group").agg(F.sum("n").alias("in_group"))
    by_source = Window.partitionBy("source_key")
    before = counts.select("source_key", "group", (F.sum("in_group").over(by_source.orderBy("group")) - F.col("in_group")).alias("before"), F.sum("in_group").over(by_source).alias("of"))
    within = F.sum("n").over(Window.partitionBy("source_key", "group").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ranked = (
        keyed.withColumn("within", within)
        .join(before, ["source_key", "group"])
        .withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {group_rows}L)")))
        .repartition(partitions(docs.sparkSession), "key", "id", "text_crc32", "piece")
        .withColumn("nth", F.explode(F.expr(f"sequence(piece * {group_rows}L, least(n, (piece + 1) * {group_rows}L) - 1)")))
        .withColumn("place", (F.col("before") + F.col("within") + F.col("nth") + 0.5) / F.col("of"))
        .withColumn("run", F.least(F.lit(groups - 1), F.floor(F.col("place") * groups)).cast("int"))
    )
    ranked = staged(ranked.select("id", "source", "size", "text_crc32", "source_key", "key", "place", "run"), "ranked")

    runs = ranked.groupBy("run").agg(F.count("*").alias("n"))
    first = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("first"))
    whole = Window.partitionBy("run").orderBy("place", "source_key", *order)
    placed = ranked.withColumn("at", F.row_number().over(whole)).join(F.broadcast(first), "run").withColumn("at", F.col("first") + F.col("at") - 1)  # at most most_groups rows
    shard = F.expr(f"int((at * {shards}L) div {max(rows, 1)}L)")
    return placed.withColumn("shard", shard).select("id", "source", "size", "text_crc32", "shard", F.expr(f"at - (shard * {max(rows, 1)}L + {shards - 1}L) div {shards}L").alias("slot"))


def op1_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return dealt.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
        table.append(byte)
    return table


ORACLE_SQL = {
    "op1_interleaved_shards": f"""
WITH bytes AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS hex FROM documents
), crc AS (
  SELECT doc_id, source, n + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ('0x' || hex[2 * i + 1:2 * i + 2])::BIGINT)),
      lambda a, b: xor(a >> 8, list_extract({_crc_table()}, (xor(a, b) & 255) + 1))), 4294967295::BIGINT) AS text_crc32
  FROM bytes
), keyed AS (
  SELECT *, coalesce('=' || source, '-') AS source_key, ('0x' || md5('7:' || coalesce('=' || source, '-') || ':' || coalesce(doc_id::VARCHAR, '-') || ':' || text_crc32::VARCHAR || ':' || size::VARCHAR)[1:15])::BIGINT AS key FROM crc
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source_key ORDER BY key, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source_key) AS place FROM keyed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY place, source_key, key, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM ranked
), cut AS (
  SELECT *, (pos * 24) // total AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (pos - (shard * total + 23) // 24)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard, source FROM cut
"""
}
