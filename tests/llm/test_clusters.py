from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import by_sql, rows_of, written

from ledgerflow.llm import clusters

ROWS = "vec_id long, embedding array<double>, label int"


def by_loop(rows, k, rounds):
    """(vec_id, vector) by plain loops over Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=named)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        where = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, where, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    where = assign()
    of = [sum(d for d, c in where if c == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, of[c], sum(of), sha[c]) for (i, _), (d, c) in zip(kept, where, strict=True)]


def rows_from(rng, n, spread=0.2):
    middles = rng.normal(0, 0.3, (7, 64))
    return [(int(i), [float(x) for x in middles[i % 7] + rng.normal(0, spread, 64)]) for i in range(n)]


def test_query_matches_its_sql(spark, sf):
    got = clusters.op11_partial_distance_clusters(spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    table["embedding"] = [list(map(float, v)) for v in table["embedding"]]
    assert len(got) == len(table)
    assert rows_of(got) == rows_of(by_sql(clusters.ORACLE_SQL["op11_partial_distance_clusters"], embeddings=table))


def test_odd_vectors_by_loops(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = rows_from(rng, 150)
    same = rows[3][1]
    rows += [(3, same)] * 30 + [(500 + i, same) for i in range(30)] + [(None, rows[5][1]), (None, rows[6][1])]
    rows += [(600, None), (601, []), (602, same[:63]), (603, [*same, 0.0]), (604, [None, *same[1:]]), (605, [math.nan, *same[1:]]), (606, [*same[1:], math.inf]), (607, [-math.inf, *same[1:]])]
    rows += [(608, [-1 / 512] * 64), (609, [-0.0] * 64), (610, [1000.0, *[-1000.0] * 63])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], ROWS).selectExpr("*", "'x' AS id", "1 AS v", "2 AS cluster", "3 AS distance")
    got = clusters.op11_partial_distance_clusters(spark, written(spark, tmp_path, embeddings=frame)).collect()
    want = by_loop(rows, 40, 5)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = rows_from(np.random.default_rng(1), 9)
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], ROWS)
    assert sorted(map(tuple, clusters.cluster(frame).collect())) == sorted(by_loop(rows, 40, 5))
    none = clusters.cluster(frame.limit(0))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_vectors_too_large_for_longs_take_no_part(spark):
    rows = rows_from(np.random.default_rng(2), 20)
    frame = spark.createDataFrame([(i, v, 0) for i, v in [*rows, (77, [1e300] * 64), (78, [float(1 << 19)] * 64)]], ROWS)
    got = {r["vec_id"]: tuple(r) for r in clusters.cluster(frame, k=4).collect()}
    assert {k: v for k, v in got.items() if k < 77} == {r[0]: r for r in by_loop(rows, 4, 5)}
    every = got[0][4]
    assert got[77] == (77, None, None, None, every, None) and got[78] == (78, None, None, None, every, None)
    assert clusters.cluster(frame.filter("vec_id >= 77")).count() == 2


@given(st.integers(1, 60), st.integers(1, 12), st.integers(0, 3), st.integers(1, 70), st.integers(1, 70), st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_nearest_by_full_distances(n, k, width, first, step, rng):
    r = np.random.default_rng(rng.randint(0, 10**6))
    span = [1, 2, 200, (1 << 27) - 1][width]
    rows, centroids = r.integers(-span, span + 1, (n, 64)), r.integers(-span, span + 1, (k, 64))
    if k > 2:
        centroids[k - 1] = centroids[0]  # a tie that the smaller number wins
    label, distance = clusters.nearest(rows, centroids, first, step)
    whole = np.square(rows[:, None, :] - centroids[None]).sum(axis=2)
    assert (label == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


@pytest.mark.parametrize("together", [1, 7, 2048])
def test_rows_meet_in_blocks_of_any_size(spark, monkeypatch, together):
    monkeypatch.setattr(clusters, "TOGETHER", together)
    rows = rows_from(np.random.default_rng(5), 40)
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], ROWS)
    assert sorted(map(tuple, clusters.cluster(frame, k=6, rounds=2).collect())) == sorted(by_loop(rows, 6, 2))
