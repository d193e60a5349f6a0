"""Digest trees of folders: equal folders are told by one digest, so two states of many files are compared from their roots down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.sources.runs import inside
from ledgerflow.staging import cut, kept

#: Hex digits of a name's digest by which a folder's entries are dealt before they meet: a folder of any number of files is no group of its own.
DEALT = 2


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def tree(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, depth, folder (whether it is one), digest, n_files: the files(keys, path, sha256) and all folders over them; a root's path is empty.

    A folder's digest is made of its entries' names, kinds and digests, in the order of their names' digests. Files of one path twice count twice. Null
    digests are empty ones. Folders are made level by level, deepest first, and kept; files are read again for each level, not copied.
    """
    own = files.filter(F.col("path").isNotNull()).select(*keys, "path", F.size(F.split("path", "/")).alias("depth"), F.lit(False).alias("folder"), F.coalesce("sha256", F.lit("")).alias("digest"), F.lit(1).cast("long").alias("n_files"))
    deepest = own.agg(F.max("depth")).first()[0] or 0
    found, levels = [own], None
    for depth in range(deepest, 0, -1):
        level = own.filter(F.col("depth") == depth)
        entries = level if levels is None else level.unionByName(levels)
        name = F.sha2(F.element_at(F.split("path", "/"), -1), 256)
        entry = F.struct(F.element_at(F.split("path", "/"), -1).alias("name"), "folder", "digest")  # names are shorter than their digests, which are made where entries meet
        named = lambda e: F.struct(F.sha2(e["name"], 256).alias("name"), e["folder"].alias("folder"), e["digest"].alias("digest"))
        line = lambda e: F.concat_ws(":", e["name"], e["folder"].cast("string"), e["digest"])
        digest = lambda entries: F.sha2(F.array_join(F.transform(F.array_sort(F.transform(entries, named)), line), "\n"), 256)
        part = entries.groupBy(*keys, _parent(F.col("path")).alias("path"), F.substring(name, 1, DEALT).alias("_part")).agg(digest(F.collect_list(entry)).alias("_digest"), F.sum("n_files").alias("n_files"))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("_part", "_digest"))), lambda p: F.concat(p["_part"], F.lit(":"), p["_digest"]))
        made = part.groupBy(*keys, "path").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("digest"), F.sum("n_files").alias("n_files"))
        levels = kept(made.select(*keys, "path", F.lit(depth - 1).alias("depth"), F.lit(True).alias("folder"), "digest", "n_files"))
        found.append(levels)
    return reduce(DataFrame.unionByName, found)


def roots(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.filter("depth = 0").select(*keys, F.col("digest").alias("root"), "n_files")


def differences(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, depth, folder, code of the nodes of two trees that were compared and differ: ADDED, REMOVED, CHANGED.

    Roots are compared first, and below that only what stands in folders that differ; the rest of either tree is never joined.
    """
    side = lambda nodes, name: nodes.select(*keys, "path", "depth", "folder", F.col("digest").alias(name))
    deepest = max(frame.agg(F.max("depth")).first()[0] or 0 for frame in (before, after))
    found, open_ = [], None
    for depth in range(deepest + 1):
        level = lambda nodes: nodes.filter(F.col("depth") == depth)  # noqa: B023, E731
        b, a = side(level(before), "b"), side(level(after), "a")
        if open_ is not None:
            within = open_.filter("folder").select(*keys, F.col("path").alias("_in"))
            b, a = (frame.withColumn("_in", _parent(F.col("path"))).join(within, [*keys, "_in"], "left_semi") for frame in (b, a))
        # Grouped, not joined: both sides already lie by the folder that they stand in. A path that is there twice meets each of the other side's, as in a join.
        near = [*keys, *(["_in"] if open_ is not None else []), "path", "depth", "folder"]
        met = b.unionByName(a, allowMissingColumns=True).groupBy(*near).agg(F.collect_list("b").alias("b"), F.collect_list("a").alias("a"))
        both = met.withColumn("b", F.explode_outer("b")).withColumn("a", F.explode_outer("a")).filter(~F.col("a").eqNullSafe(F.col("b")))
        code = F.when(F.col("b").isNull(), "ADDED").when(F.col("a").isNull(), "REMOVED").otherwise("CHANGED")
        open_ = cut(both.select(*keys, "path", "depth", "folder", code.alias("code"), "b", "a"))
        found.append(open_)
    return reduce(DataFrame.unionByName, found)


def changed_files(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, code (ADDED, REMOVED, CHANGED, MOVED), moved_from: the files in which two trees differ.

    A file that is gone and one that came with the same digest are one that moved; of several the first by path to the first by path.
    """
    files = differences(before, after, keys).filter("NOT folder")
    nth = F.row_number().over(Window.partitionBy(*keys, "digest").orderBy("path"))
    side = lambda code, digest: files.filter(F.col("code") == code).select(*keys, "path", F.col(digest).alias("digest")).withColumn("_n", nth)
    gone, come = side("REMOVED", "b").withColumnRenamed("path", "moved_from"), side("ADDED", "a")
    moves = gone.join(come, [*keys, "digest", "_n"], "full_outer")
    code = F.when(F.col("path").isNull(), "REMOVED").when(F.col("moved_from").isNull(), "ADDED").otherwise("MOVED")
    moved = moves.select(*keys, F.coalesce("path", "moved_from").alias("path"), code.alias("code"), F.when(code == "MOVED", F.col("moved_from")).alias("moved_from"))
    return files.filter("code = 'CHANGED'").select(*keys, "path", "code", F.lit(None).cast("string").alias("moved_from")).unionByName(moved)


def verified_receipts(receipts: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, receipt (of receipts(keys, receipt)), root, state: VERIFIED where a receipt is the root of its files, ALTERED where it isn't, LOST where there are
    no files, and UNFINISHED for files without a receipt or with a null one."""
    both = receipts.select(*keys, "receipt").join(roots(nodes, keys).select(*keys, "root"), keys, "full_outer")
    state = F.when(F.col("receipt").isNull(), "UNFINISHED").when(F.col("root").isNull(), "LOST").when(F.col("receipt") == F.col("root"), "VERIFIED").otherwise("ALTERED")
    return both.select(*keys, "receipt", "root", state.alias("state"))


def finished_attempts(receipts: DataFrame, nodes: DataFrame, run: str = "run_id", attempt: str = "attempt") -> DataFrame:
    """Of each run its last attempt, if that is verified: a newer one that isn't masks older ones."""
    states = verified_receipts(receipts, nodes, [run, attempt])
    last = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(attempt)))
    return states.withColumn("_n", last).filter("_n = 1 AND state = 'VERIFIED'").drop("_n")


def evidence(files: DataFrame, manifest: DataFrame, required: tuple[str, ...], keys: list[str]) -> DataFrame:
    """keys, path, problem of folders of evidence; a folder without a row is whole.

    files(keys, path, sha256) are what is there, manifest(keys, path, sha256) what must be. OUTSIDE: a path that leaves its folder; LOST: registered and not
    there; ALTERED: there with another digest; UNREGISTERED: there and not registered; REQUIRED: a required path that isn't registered.
    """
    found = files.select(*keys, "path", F.lower("sha256").alias("found"))
    listed = manifest.select(*keys, "path", F.lower("sha256").alias("listed"), F.lit(True).alias("_listed"))
    both = found.withColumn("_found", F.lit(True)).join(listed, [*keys, "path"], "full_outer")
    problem = F.when(~inside(F.col("path")), "OUTSIDE").when(F.col("_found").isNull(), "LOST").when(F.col("_listed").isNull(), "UNREGISTERED").when(~F.col("found").eqNullSafe(F.col("listed")), "ALTERED")
    wanted = listed.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, required)).cast("array<string>")).alias("path"))
    missing = wanted.join(listed, [*keys, "path"], "left_anti").select(*keys, "path", F.lit("REQUIRED").alias("problem"))
    return both.select(*keys, "path", problem.alias("problem")).filter("problem IS NOT NULL").unionByName(missing)


def other_sources(references: DataFrame, manifest: DataFrame, keys: list[str], source: str = "source.pdf") -> DataFrame:
    """Keys whose reference(keys, source_sha256) was made from another source than the manifest registers, or from none."""
    own = manifest.filter(F.col("path") == source).select(*keys, F.lower("sha256").alias("_sha256"))
    return references.join(own, keys, "left").filter(~F.lower("source_sha256").eqNullSafe(F.col("_sha256"))).select(*keys)
