"""Centroid clustering against plain Python with exact integers, and its SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from acreline.llm import clustering, oracle, queries


def brute(rows, k=16, rounds=3, dim=64, scale=64):
    """{row: (cluster, distance)} and the centroids, by all distances."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] is not None and len(r[1]) == dim and all(c is not None and math.isfinite(c) for c in r[1])]
    whole = lambda x: (lambda n, d: scale * n // d)(*float(x).as_integer_ratio())
    cells = {i: [whole(c) for c in r[1]] for i, r in kept}
    first = sorted(kept, key=lambda p: (hashlib.sha256(f"1:{'null' if p[1][0] is None else p[1][0]}".encode()).hexdigest(), p[1][1]))[:k]
    now = [cells[i] for i, _ in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        got = {i: near(v)[1] for i, v in cells.items()}
        for j in range(len(now)):
            own = [cells[i] for i, c in got.items() if c == j]
            if own:
                now[j] = [sum(p) // len(own) for p in zip(*own)]
    return {i: near(v)[::-1] for i, v in cells.items()}, now


def check(spark, folder, rows):
    want, centroids = brute(rows)
    total = {}
    for c, d in want.values():
        total[c] = total.get(c, 0) + d
    big = lambda x: x if x < 1 << 63 else None
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    expected = sorted((repr((rows[i][0], c, big(d), big(total[c]), big(sum(total.values())), shas[c])) for i, (c, d) in want.items()))
    got = sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in queries.op12_drake_clusters(spark, folder).collect())
    assert got == expected


def table(folder, rows, value=pa.float32()):
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(value)), "key": ["clash"] * len(rows), "a": ["clash"] * len(rows), "cluster": [7] * len(rows)}), folder / "embeddings.parquet")
    return str(folder)


def test_op12_equals_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    check(spark, sf, rows)


def test_op12_awkward_rows(spark, tmp_path):
    """Nulls, short and long vectors, ties, repeated rows and ids, and sizes beyond any whole-number type."""
    rng = random.Random(3)
    vec = lambda s=1.0: [float(np.float32(rng.gauss(0, s))) for _ in range(64)]
    rows = [(i, vec()) for i in range(60)] + [(None, vec()), (None, [0.0] * 64), (5, None), (6, vec()[:63]), (7, vec() + [0.0]), (8, [None] + vec()[1:]), (9, [float("nan")] + vec()[1:]), (10, [float("inf")] + vec()[1:])]
    rows += [(11, [0.0] * 64)] * 40 + [(12 + i, [1.0 / 64 * (i % 2)] * 64) for i in range(30)]
    check(spark, table(tmp_path, rows), rows)
    (tmp_path / "big").mkdir()
    rows += [(100 + i, [float(np.float32(3e38)) * (-1) ** i] * 64) for i in range(3)] + [(200, [float(1 << 20)] * 64), (201, vec(1e6))]
    check(spark, table(tmp_path / "big", rows), rows)
    (tmp_path / "double").mkdir()
    check(spark, table(tmp_path / "double", rows + [(300, [1e300] * 64)], pa.float64()), rows + [(300, [1e300] * 64)])


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_op12_few_vectors(spark, tmp_path, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    check(spark, table(tmp_path, rows), rows)


def test_bounds_certify_most_vectors_and_never_wrongly(spark):
    """Ten rounds over separated groups: exact like brute force, and most vectors keep their centroid without a distance."""
    rng = random.Random(4)
    middle = [[rng.gauss(0, 8) for _ in range(8)] for _ in range(12)]
    rows = [(i, [m + rng.gauss(0, 0.5) for m in middle[i % 12]]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, centroids, seen = clustering.cluster(df, k=12, rounds=10, dim=8)
    want, now = brute(rows, k=12, rounds=10, dim=8)
    assert centroids == now
    assert {r.vec_id: (r.cluster, r.distance) for r in found.collect()} == {i: w for i, w in want.items()}
    assert seen[0] == {4: 3000} and sum(seen[-1].values()) == 3000 and seen[-1].get(0, 0) > 2500


def test_op12_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({oracle.OP12})").fetchall()
    assert sorted(map(tuple, queries.op12_drake_clusters(spark, sf).collect())) == sorted(want)
