"""Clusters of integer vectors around centroids, with distances that are summed over few components where that is enough to know who isn't nearest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.shared import staged

COMPONENTS, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED = 40, 5, 2
#: Integers of this size or more aren't clustered: the squares of 64 differences of smaller ones fit 64 bits.
LARGEST = 1 << 27
#: Components that are summed before centroids are first abandoned, and between that and the next time; vectors that are compared together.
FIRST, STEP, TOGETHER = 16, 8, 2048
_LONG = (1 << 63) - 1


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """Each component x as floor(scale * x), x as a double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x))


def usable(vector: Column, components: int = COMPONENTS) -> Column:
    """Whether the vector has just so many components, none of them null, NaN or infinite."""
    finite = F.forall(vector.cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == components) & finite, F.lit(False))


def nearest(rows: np.ndarray, centroids: np.ndarray, first: int = FIRST, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centroid (of several the one with the smallest number) and its squared distance, all in integers.

    Both have their most varied components in front. All centroids are compared over the first components; the one that leads there is finished, and its
    distance is what to beat. Then each centroid goes on, a few components at a time, for those rows alone where its sum isn't strictly above the best; what
    is left after the last component is its distance, which becomes the best where it is smaller, or equal with a smaller number.
    """
    v = np.ascontiguousarray(rows.T)
    c = np.ascontiguousarray(centroids.T)
    first = min(first, len(v))
    begun = np.zeros((len(centroids), len(rows)), np.int64)
    for x, y in zip(v[:first], c[:first], strict=True):
        begun += np.square(x[None, :] - y[:, None])
    label = begun.argmin(axis=0)
    best = begun[label, np.arange(len(rows))] + np.square(v[first:] - c[first:, label]).sum(axis=0)
    for k in range(len(centroids)):
        alive = np.flatnonzero(begun[k] <= best)
        sums = begun[k, alive]
        for at in range(first, len(v), step):
            apart = v[at : at + step, alive] - c[at : at + step, k, None]
            sums = sums + np.einsum("ij,ij->j", apart, apart)
            left = sums <= best[alive]
            alive, sums = alive[left], sums[left]
            if not len(alive):
                break
        better = (sums < best[alive]) | (k < label[alive])  # what is alive isn't above the best
        label[alive[better]], best[alive[better]] = k, sums[better]
    return label, best


def _blocks(batches: Iterator[pa.RecordBatch], order: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            yield part, np.asarray(part.column(1).flatten()).reshape(-1, len(order)).astype(np.int64)[:, order]


def moved(vectors: DataFrame, centroids: list[list[int]], order: list[int]) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) of each one's vectors, or as they were where there are none.

    A task hands on one row for each centroid, with its vectors' sums; the driver gets as many rows as there are centroids."""
    place, held = np.asarray(order), np.asarray(centroids, np.int64)[:, order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(held), np.int64), np.zeros(held.shape, np.int64)
        for _, rows in _blocks(batches, place):
            label, _ = nearest(rows, held)
            by_label = np.argsort(label, kind="stable")
            names, starts = np.unique(label[by_label], return_index=True)
            sums[names] += np.add.reduceat(rows[by_label], starts)
            counts += np.bincount(label, minlength=len(held))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = vectors.select("id", "v").mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i].cast("decimal(20,0)")) for i in range(len(order))]
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*totals).alias("sums")).collect():
        for i, total in zip(order, r["sums"], strict=True):
            out[r["cluster"]][i] = int(total) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]], order: list[int]) -> DataFrame:
    """id, cluster and squared distance of each vector."""
    place, held = np.asarray(order), np.asarray(centroids, np.int64)[:, order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _blocks(batches, place):
            label, distance = nearest(rows, held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    of_id = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v").mapInArrow(run, f"id {of_id}, cluster int, distance long")


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, in that order; equal ids go by their components, null ids come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    return [list(r["v"]) for r in vectors.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()]


def by_variance(vectors: DataFrame, components: int) -> list[int]:
    """The places of the components, those that vary most over all vectors first."""
    found = vectors.agg(*[F.var_pop(F.col("v")[i]).alias(f"v{i}") for i in range(components)]).first()
    return sorted(range(components), key=lambda i: (-found[i], i))


def cluster(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Of each usable vector the id column, cluster, distance (squared), cluster_inertia and inertia (distances summed over its cluster and over all) and
    centroid_sha256 (of the final centroid's components, as decimal integers joined by commas).

    Vectors are usable with just so many components, none null or non-finite; others have no row. Components become integers (see whole_numbers), and all
    that follows is exact. Centroids start as the vectors of the smallest hashes (see starts), of which fewer than k may be there; rounds that change
    nothing are the last. Ties go to the smaller number. Repeated rows and repeated or null ids are vectors like others. A vector with an integer of LARGEST
    or more in size has distances that no long holds: it takes no part, and its row has nulls but for the id and inertia; an inertia beyond a long is null.
    An empty table gives no rows; other columns aren't read. What is in the driver, and goes to all tasks, are k centroids, whatever the input.
    """
    spark = table.sparkSession
    whole = whole_numbers(F.col(vector_column), scale)
    fits = F.forall(F.col(vector_column).cast("array<double>"), lambda x: F.abs(F.lit(float(scale)) * x) < LARGEST)
    own = table.filter(usable(F.col(vector_column), components)).select(F.col(id_column).alias("id"), F.when(fits, whole).cast("array<int>").alias("v"))
    everything = staged(own, "vectors")
    vectors = everything.filter(F.col("v").isNotNull())
    centroids = starts(vectors, k, seed)
    result = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        lone = everything.select(F.col("id").alias(id_column), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
        return lone.withColumns({"cluster_inertia": F.lit(None).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit(None).cast("string")})
    order = by_variance(vectors, components)
    for _ in range(rounds):
        before, centroids = centroids, moved(vectors, centroids, order)
        if before == centroids:
            break
    found = staged(assigned(vectors, centroids, order), "assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    held = lambda x: x if x <= _LONG else None
    every = held(sum(inertia.values()))
    named = [(c, held(n), every, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, n in sorted(inertia.items())]
    rows = found.join(F.broadcast(spark.createDataFrame(named, result)), "cluster")
    columns = [F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    large = everything.filter(F.col("v").isNull()).select("id", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("cluster", "distance", "cluster_inertia")], F.lit(every).cast("long").alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    return rows.select(*columns).unionByName(large.select(*columns))


def op11_partial_distance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The whole computation, round by round."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}
), components AS MATERIALIZED (SELECT n, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM kept
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY hash, v) - 1 AS c, v FROM (SELECT v, sha256('{seed}:' || vec_id) AS hash FROM kept ORDER BY hash, v LIMIT {k})
)"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
  SELECT n, first(c ORDER BY far, c) AS c, min(far) AS far FROM (
    SELECT n, c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far FROM kept, c{i}) GROUP BY n
)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list((total - ((total % many) + many) % many) // many ORDER BY d) AS v FROM (
      SELECT c, d, sum(x)::BIGINT AS total, count(*) AS many FROM components JOIN a{i} USING (n) GROUP BY c, d) GROUP BY c) m ON m.c = c{i}.c
)"""
            )
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, {last}.c::INTEGER AS cluster, far AS distance, sum(far) OVER (PARTITION BY {last}.c)::BIGINT AS cluster_inertia, sum(far) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM kept JOIN {last} USING (n) JOIN c{rounds} ON c{rounds}.c = {last}.c"""


ORACLE_SQL = {"op11_partial_distance_clusters": _sql()}
