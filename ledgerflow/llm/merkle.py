"""A Merkle tree over a whole table: a leaf for each row, a tree for each group, a tree of the groups, and for each row the siblings that prove it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.sharding import _crc_table
from ledgerflow.llm.shared import partitions, staged

#: A leaf's fields in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block: 2 ** LEVELS consecutive nodes of a group are walked as one.
LEVELS = 10
#: A node without a sibling, in paths.
LONE = ""


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields: each is its number of bytes in UTF-8, a colon and the value, or - for null."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def height(n: int) -> int:
    """Levels over n nodes until one is left."""
    return max(n - 1, 0).bit_length()


def postorder(nodes: list[str], levels: int) -> tuple[str, list[list[str]]]:
    """The digest over the nodes after so many levels, and for each node its siblings on the way there, LONE where it has none.

    A subtree is walked left part first, then right part; while that unwinds, each part's digest is appended to the paths of the nodes in the other one."""
    paths: list[list[str]] = [[] for _ in nodes]

    def walk(at: int, level: int) -> str:
        if not level:
            return nodes[at]
        middle, end = at + (1 << level - 1), min(at + (1 << level), len(nodes))
        left = walk(at, level - 1)
        right = walk(middle, level - 1) if middle < end else LONE
        for path in paths[at : min(middle, end)]:
            path.append(right)
        for path in paths[middle:end]:
            path.append(left)
        return digest(left + right)

    return walk(0, levels), paths


def folded(node: str, at: int, siblings: list[str]) -> str:
    """The digest that a node at this place leads to with these siblings."""
    for sibling in siblings:
        node = digest(sibling + node if at & 1 else node + sibling)
        at >>= 1
    return node


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows (few bytes each) with `rank`: the number of rows of its group that come before in ascending order, nulls first; rows that are equal in all of
    these columns stand in any order.

    Rows are range-partitioned by group and order, so that a group of any size is spread over tasks; how many rows of a group stand in earlier ranges is a
    running sum over one row for each group and range. A row's place in its input is the last part of the key, so equal rows may be parted too.
    """
    named = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ordered = named.repartitionByRange(partitions(rows.sparkSession), *keys, F.xxhash64("_row")).sortWithinPartitions(*keys).drop("_row")
    held = staged(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_range", F.shiftright("_at", 33))
    runs = held.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "_range", (before - F.col("_first")).alias("_shift"))
    return held.join(runs, [group, "_range"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _levels(block: int, n: int, levels: int) -> int:
    """Only the first block of a group can be all of it: then its walk ends at one node; others go on to the block's height."""
    return height(n) if block == 0 else levels


_LEVEL = "grp string, rank long, parent long, path array<string>, digest string"


def _climbed(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (grp, rank, digest) with their block's number as `parent`, `path` (siblings within the block) and the block's digest."""

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        grp, block = key[0].as_py(), key[1].as_py()
        top, paths = postorder(table.column("digest").to_pylist(), _levels(block, table.num_rows, levels))
        n = table.num_rows
        return pa.table({"grp": [grp] * n, "rank": table.column("rank"), "parent": pa.array([block] * n, pa.int64()), "path": pa.array(paths, pa.list_(pa.string())), "digest": [top] * n})

    return nodes.groupBy("grp", F.shiftright("rank", levels).alias("parent")).applyInArrow(walk, _LEVEL)


def climbed(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of blocks above these nodes, lowest first, until each group is one node; and these: grp, digest."""
    found = []
    while nodes.filter(F.col("rank") > 0).limit(1).count():
        found.append(staged(_climbed(nodes, levels), "level"))
        nodes = found[-1].filter(F.col("rank").bitwiseAND((1 << levels) - 1) == 0).select("grp", F.col("parent").alias("rank"), "digest")
    return found, nodes.select("grp", "digest")


def descended(levels: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """From tops (grp, up: what follows their own path, and the carried columns) down to the lowest level's nodes: grp, rank, up, carried columns."""
    found = tops.withColumn("rank", F.lit(0).cast("long"))
    for level in reversed(levels):
        above = found.select("grp", F.col("rank").alias("parent"), "up", *carried)
        found = level.join(above, ["grp", "parent"]).select("grp", "rank", F.concat("path", "up").alias("up"), *carried)
    return found


_BLOCKS = "grp string, rank long, digest string, leaves array<string>, tampered array<string>"
_PROOFS = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """A row for each row of docs: its key, leaf, subroot (of its group's tree), root (of the tree of subroots), proof_sha256 (digest of its siblings in the
    order of levels up to the root), folded_root (what its leaf, or `tampered`, a leaf's digest, where that isn't null, leads to with these siblings) and
    verified (whether that is the root).

    In a group leaves ascend by key, null keys first, and leaves of one key by digest; groups ascend bytewise, the null group first. While nodes are left,
    two consecutive ones (the last alone, if need be) become their digest; a lone leaf is its own subroot. Repeated rows have leaves of their own. Null and
    empty texts differ. An empty table gives no rows. Columns that are neither fields, group nor key aren't read.

    Texts are hashed where they are read; what is sorted and shuffled are keys and digests. A group of any size is cut in aligned blocks of 2 ** levels
    leaves, and a block is walked in one task. The blocks' digests are the nodes of the next walk, and so on: each has a thousandth of the nodes of the one
    before. The siblings above a block are then joined to it and its leaves' proofs made by walking it again, so that they are nowhere stored.
    """
    of_key = docs.schema[key].dataType
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    changed = F.lit(None).cast("string") if tampered is None else tampered
    leaves = staged(docs.select(grp.alias("grp"), F.col(key).alias("id"), F.unhex(leaf(*map(F.col, fields))).alias("leaf"), F.unhex(changed).alias("tampered")), "leaves")
    ranked = placed(leaves, "grp", ["id", "leaf", "tampered"])

    def walk(name: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        grp, block = name[0].as_py(), name[1].as_py()
        own = [x.hex() for x in table.column("leaf").to_pylist()]
        other = [x and x.hex() for x in table.column("tampered").to_pylist()]
        top, _ = postorder(own, _levels(block, len(own), levels))
        strings = pa.list_(pa.string())
        return pa.table({"grp": [grp], "rank": pa.array([block], pa.int64()), "digest": [top], "leaves": pa.array([own], strings), "tampered": pa.array([other], strings), "ids": pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type))})

    blocks = ranked.groupBy("grp", F.shiftright("rank", levels).alias("block")).applyInArrow(walk, f"{_BLOCKS}, ids array<{of_key.simpleString()}>")
    blocks = staged(blocks, "blocks")
    within_groups, tops = climbed(blocks.select("grp", "rank", "digest"), levels)

    # The tree of subroots, whose leaves are the groups' tops.
    named = placed(tops.select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest"), "all", ["name"])
    nodes = staged(named.select(F.col("all").alias("grp"), "rank", "digest", "name"), "groups")
    over, root = climbed(nodes.select("grp", "rank", "digest"), levels)
    ups = descended(over, root.select("grp", F.array().cast("array<string>").alias("up"), F.col("digest").alias("root")), ["root"])
    tops = nodes.join(ups, ["grp", "rank"]).select(F.col("name").alias("grp"), F.col("rank").alias("place"), F.col("digest").alias("subroot"), "up", "root")

    # A block's siblings within its group and then above it; they part where the group's tree ends, as places are counted anew there.
    tops = tops.select("grp", F.array().cast("array<string>").alias("up"), "place", "subroot", "root", F.col("up").alias("above"))
    paths = descended(within_groups, tops, ["place", "subroot", "root", "above"])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                block, own, other, up, place, subroot, root, above = (row.column(i)[0].as_py() for i in range(1, 9))
                _, within = postorder(own, _levels(block, len(own), levels))
                proofs, ends = [], []
                for at, (node, instead, path) in enumerate(zip(own, other, within, strict=True)):
                    top = folded(folded(instead or node, at, path), block, up)
                    ends.append(folded(top, place, above))
                    proofs.append(digest("".join([*path, *up, *above])))
                n = len(own)
                ids = pa.array(row.column(0)[0].values)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(ends), pa.array([e == root for e in ends])], names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    whole = blocks.join(paths, ["grp", "rank"]).select("ids", "rank", "leaves", "tampered", "up", "place", "subroot", "root", "above")
    return whole.mapInArrow(prove, f"id {of_key.simpleString()}, {_PROOFS}").withColumnRenamed("id", key)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = leaf(*(F.try_add(F.col(c).cast("long"), F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, tampered=F.when(chosen, changed))


def _field(name: str) -> str:
    return f"coalesce(strlen(({name})::VARCHAR)::VARCHAR || ':' || ({name})::VARCHAR, '-')"


ORACLE_SQL = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE hashed AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256({" || ".join(map(_field, FIELDS))}) AS leaf, sha256({" || ".join(_field(f"{c} + 1" if c == "n_chars" else c) for c in FIELDS)}) AS changed,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii((doc_id::VARCHAR)[i + 1])::BIGINT)),
      lambda a, b: xor(a >> 8, list_extract({_crc_table()}, (xor(a, b) & 255) + 1))), 4294967295::BIGINT) % 7 = 0, false) AS chosen
  FROM documents
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed
), tree AS (
  SELECT grp, 0 AS lvl, place, leaf AS digest FROM leaves
  UNION ALL
  SELECT grp, lvl + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM tree) WHERE n > 1 GROUP BY grp, lvl, place // 2
), nodes AS MATERIALIZED (SELECT * FROM tree
), subroots AS MATERIALIZED (
  SELECT grp, lvl AS height, digest AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS place FROM (SELECT *, max(lvl) OVER (PARTITION BY grp) AS top FROM nodes) WHERE lvl = top
), over AS (
  SELECT 0 AS lvl, place, subroot AS digest FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER () AS n FROM over) WHERE n > 1 GROUP BY lvl, place // 2
), above AS MATERIALIZED (SELECT *, max(lvl) OVER () AS top FROM over
), folds AS (
  SELECT l.grp, l.place AS leaf_place, 0 AS lvl, l.place, CASE WHEN chosen THEN changed ELSE leaf END AS node, '' AS proof, false AS over FROM leaves l
  UNION ALL
  SELECT f.grp, leaf_place, CASE WHEN step THEN 0 ELSE f.lvl + 1 END, CASE WHEN step THEN s.place ELSE f.place // 2 END,
    CASE WHEN step THEN node WHEN f.place % 2 = 1 THEN sha256(other || node) ELSE sha256(node || other) END, CASE WHEN step THEN proof ELSE proof || other END, f.over OR step
  FROM (SELECT f.*, NOT f.over AND f.lvl = s.height AS step, coalesce(CASE WHEN f.over THEN a.digest ELSE n.digest END, '') AS other
    FROM folds f JOIN subroots s ON s.grp = f.grp
    LEFT JOIN nodes n ON NOT f.over AND n.grp = f.grp AND n.lvl = f.lvl AND n.place = xor(f.place, 1)
    LEFT JOIN above a ON f.over AND a.lvl = f.lvl AND a.place = xor(f.place, 1)
    WHERE NOT f.over OR f.lvl < (SELECT max(top) FROM above)) f JOIN subroots s ON s.grp = f.grp
)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.digest AS verified
FROM leaves l JOIN subroots s ON s.grp = l.grp JOIN (SELECT digest FROM above WHERE lvl = top) r ON true
JOIN folds f ON f.grp = l.grp AND f.leaf_place = l.place AND f.over AND f.lvl = (SELECT max(top) FROM above)
"""
}
