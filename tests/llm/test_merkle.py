from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from helpers import DOCS, ODD, by_sql, rows_of, table, written

from ledgerflow.llm import merkle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def whole_tree(nodes):
    """The root, and for each node its path of (sibling, whether it stands left), by whole levels."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            p.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else "", i & 1))
        nodes, at = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return (nodes or [""])[0], paths


def by_loops(rows):
    def leaf(r, more=0):
        fields = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    groups = {}
    for r in rows:
        groups.setdefault(b"" if r[2] is None else b"=" + r[2].encode(), []).append(r)
    names = sorted(groups)
    trees = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = own, *whole_tree([leaf(r) for r in own])
    root, above = whole_tree([trees[g][1] for g in names])
    out = []
    for g, over in zip(names, above, strict=True):
        own, subroot, paths = trees[g]
        for r, path in zip(own, paths, strict=True):
            node = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for sibling, left in [*path, *over]:
                node = sha(sibling + node if left else node + sibling)
            out.append((r[0], leaf(r), subroot, root, sha("".join(s for s, _ in [*path, *over])), node, node == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def changed():
    """The query's choice, over any manifest."""
    leaf = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.try_add(F.col("n_chars"), F.lit(1)), F.col("text"))
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf)


def matches(got, rows):
    return sorted(map(str, ([r[c] for c in COLUMNS] for r in got))) == sorted(map(str, map(list, by_loops(rows))))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 1024, 1025])
def test_postorder_by_whole_levels(n):
    nodes = [sha(str(i)) for i in range(n)]
    top, paths = merkle.postorder(nodes, merkle.height(n))
    root, want = whole_tree(nodes)
    assert top == root and paths == [[s for s, _ in p] for p in want]
    assert all(merkle.folded(x, i, p) == root for i, (x, p) in enumerate(zip(nodes, paths, strict=True)))


def test_query_matches_its_sql(spark, sf):
    got = merkle.op12_merkle_manifest(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert rows_of(got) == rows_of(by_sql(merkle.ORACLE_SQL["op12_merkle_manifest"], documents=docs))
    assert 0 < (~got["verified"]).sum() < len(got) / 3


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("shape", ["hot", "many", "one"])
def test_trees_of_many_levels_by_loops(spark, levels, shape):
    lang = {"hot": lambda i: "en" if i % 3 else ("de", "ä", None, "", "zz")[i // 3 % 5], "many": lambda i: f"l{i}", "one": lambda i: None}[shape]
    rows = [(i * 7 % 101, f"text {i}", lang(i), f"s{i % 3}", i if i % 4 else None) for i in range(90)]
    assert matches(merkle.manifest(table(spark, rows, DOCS), tampered=changed(), levels=levels).collect(), rows)


def test_odd_rows_by_loops(spark, tmp_path):
    rows = [(*r, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", len(r[1] or "") if i % 5 else None) for i, r in enumerate(ODD)]
    rows += [(7, "same", "de", "s", 4)] * 40 + [(None, None, None, None, None)] * 40 + [(-5, "negative", "de", "s", 1)]
    docs = table(spark, rows, DOCS).selectExpr("*", "'x' AS id", "1 AS leaf", "2 AS rank", "3 AS grp", "4 AS root")
    got = merkle.op12_merkle_manifest(spark, written(spark, tmp_path, documents=docs)).collect()
    assert matches(got, rows)
    assert matches(merkle.manifest(docs, tampered=changed(), levels=2).collect(), rows)


@pytest.mark.parametrize("rows", [[], [(3, "one row", "en", "s", 7)], [(3, "one row", "en", "s", 7), (4, None, None, None, None)]])
def test_tables_of_few_rows(spark, rows):
    got = merkle.manifest(table(spark, rows, DOCS), tampered=changed())
    assert got.columns == COLUMNS and matches(got.collect(), rows)


def test_without_tampering_all_is_verified_and_equal_leaves_are_dealt_out(spark):
    rows = [(1, "same", "en", "s", 4)] * 3000
    docs = table(spark, rows, DOCS)
    assert all(r["verified"] for r in merkle.manifest(docs, levels=6).collect())
    ranked = merkle.placed(docs.select("lang", "doc_id"), "lang", ["doc_id"])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(3000))
