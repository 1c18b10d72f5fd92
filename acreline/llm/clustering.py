"""Centroid clustering in whole numbers, with adaptive distance bounds.

A vector keeps an upper bound of the distance to its centroid, lower bounds of the distances to its several nearest other
centroids, and one lower bound that holds for all the rest. When centroids have moved, bounds are moved by as much. If
the upper bound stays below all lower ones the vector keeps its centroid and no distance is computed; if it stays below
those behind the first z, exact distances to these z decide; else all are computed again. Bounds are doubles that are
rounded outwards; every decision is made by exact squared distances, ties going to the smaller number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Up to this size of components a double holds every squared distance of 64 components exactly.
SMALL = 1 << 22
#: Each bound is rounded outwards by this share of what it is made of.
OUT = 1e-12
#: Sums travel as signed digits of this many bits, so that they may be of any size.
DIGIT = 48


def kept(vectors: DataFrame, dim: int, vector: str) -> DataFrame:
    """The rows whose vector has exactly dim components, none null or non-finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vectors.where((F.size(vector) == dim) & ~F.exists(vector, bad))


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly, whatever the size of x."""
    n, d = float(x).as_integer_ratio()
    return scale * n // d


class Centroids:
    """Centroids as exact integers, and as doubles if all are small."""

    def __init__(self, exact: list[list[int]]):
        self.exact = exact
        self.small = all(abs(x) <= SMALL for row in exact for x in row)
        self.floats = np.array(exact, np.float64) if self.small else None

    def squared(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Exact squared distances of small vectors to all centroids, or to those of at, (vectors, n) of numbers."""
        if at is not None:
            return ((x[:, None, :] - self.floats[at]) ** 2).sum(axis=2)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ self.floats.T) + (self.floats * self.floats).sum(axis=1)

    def nearest(self, x: list[int]) -> tuple[int, int]:
        """(number, squared distance) of the centroid nearest to a vector of any size."""
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(self.exact))[::-1]

    def moved(self, to: Centroids) -> np.ndarray:
        """How far each centroid is from that of to, rounded up; infinite where a double can't tell."""
        out = []
        for a, b in zip(self.exact, to.exact):
            d = sum((x - y) ** 2 for x, y in zip(a, b))
            out.append(np.sqrt(float(d)) * (1 + OUT) if d < 1 << 1000 else np.inf)
        return np.array(out)


def rescanned(x, centroids: Centroids, b: int):
    """(a, u, ids, lb) by distances to all centroids."""
    d = centroids.squared(x)
    order = np.argsort(d, axis=1, kind="stable")
    far = np.sqrt(np.take_along_axis(d, order, axis=1))
    lb = np.full((len(x), b + 1), np.inf)
    lb[:, : d.shape[1] - 1] = far[:, 1 : b + 2] * (1 - OUT)
    return order[:, 0], far[:, 0] * (1 + OUT), order[:, 1 : b + 1], lb


def step(x, state, centroids: Centroids, moves: np.ndarray, b: int):
    """(a, u, ids, lb, z) of small vectors after the centroids moved; state is (a, u, ids, lb) with b or more bounds.

    z tells how many lower bounds could not be certified; b + 1 is a scan of all.
    """
    a, u, ids, lb = (np.array(s) for s in state)
    u = (u + moves[a]) * (1 + OUT)
    by = np.concatenate([moves[ids], np.full((len(x), 1), moves.max(initial=0.0))], axis=1)
    lb = lb - by - OUT * (np.abs(lb) + by)
    # what holds for a centroid and all behind it; with fewer bounds than before the last of them holds for the rest
    lb = np.minimum.accumulate(lb[:, ::-1], axis=1)[:, ::-1][:, : b + 1].copy()
    ids = ids[:, :b].copy()
    open_at = lambda rows: b + 1 - (lb[rows] > u[rows, None]).sum(axis=1)
    z = open_at(np.arange(len(x)))
    rows = np.flatnonzero(z)
    if len(rows):
        u[rows] = np.sqrt(centroids.squared(x[rows], a[rows, None])[:, 0]) * (1 + OUT)
        z[rows] = open_at(rows)
    for n in np.unique(z[z > 0]):
        rows = np.flatnonzero(z == n)
        if n > b:
            a[rows], u[rows], ids[rows], lb[rows] = rescanned(x[rows], centroids, b)
            continue
        asked = np.concatenate([a[rows, None], ids[rows, :n]], axis=1)
        d = centroids.squared(x[rows], asked)
        order = np.lexsort((asked, d), axis=1)
        asked, far = np.take_along_axis(asked, order, axis=1), np.sqrt(np.take_along_axis(d, order, axis=1))
        a[rows], u[rows] = asked[:, 0], far[:, 0] * (1 + OUT)
        ids[rows[:, None], np.arange(n)], lb[rows[:, None], np.arange(n)] = asked[:, 1:], far[:, 1:] * (1 - OUT)
    return a, u, ids, lb, z


def digits(value: int) -> list[int]:
    """Signed digits of DIGIT bits, lowest first."""
    out, sign, value = [], -1 if value < 0 else 1, abs(value)
    while value:
        out.append(sign * (value & ((1 << DIGIT) - 1)))
        value >>= DIGIT
    return out


STATE = "a int, u double, ids array<int>, lb array<double>"


def assigned(rows: DataFrame, centroids: Centroids, moves: np.ndarray | None, b: int, dim: int, scale: int) -> DataFrame:
    """rows (key, e and, after the first round, the state) with the new state and distance, and, as rows of kind 1, sums.

    Rows of kind 1 are (cluster, place, digit, value): sums of the components of a task's vectors by cluster, their
    number at place dim, and at cluster -1 how many vectors had which z. They are summed by Spark.
    """
    k = len(centroids.exact)

    def of(batches):
        sums, counts, opened = [[0] * dim for _ in range(k)], np.zeros(k, np.int64), np.zeros(b + 2, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            e = np.stack(batch["e"].to_numpy()).astype(np.float64)
            with np.errstate(over="ignore"):
                x = np.floor(e * scale)
            small = (np.abs(x) <= SMALL).all(axis=1) & centroids.small
            n = len(x)
            a, u, far = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, None, object)
            ids, lb = np.zeros((n, b), np.int64), np.full((n, b + 1), -np.inf)
            rows = np.flatnonzero(small)
            if len(rows):
                if moves is None:
                    a[rows], u[rows], ids[rows], lb[rows] = rescanned(x[rows], centroids, b)
                    opened[b + 1] += len(rows)
                else:
                    before = [np.stack(batch[c].to_numpy()[rows]) if c in ("ids", "lb") else batch[c].to_numpy()[rows] for c in ("a", "u", "ids", "lb")]
                    with np.errstate(invalid="ignore"):
                        a[rows], u[rows], ids[rows], lb[rows], z = step(x[rows], before, centroids, moves, b)
                    opened += np.bincount(z, minlength=b + 2)
                far[rows] = centroids.squared(x[rows], a[rows, None])[:, 0].astype(np.int64)
                for c in np.unique(a[rows]):
                    own = x[rows[a[rows] == c]].astype(np.int64)
                    sums[c] = [s + int(t) for s, t in zip(sums[c], own.sum(axis=0))]
            # components beyond SMALL: exact integers and all centroids
            for r in np.flatnonzero(~small):
                own = [whole(v, scale) for v in e[r]]
                a[r], d = centroids.nearest(own)
                far[r] = d if d < 1 << 63 else None
                sums[a[r]] = [s + t for s, t in zip(sums[a[r]], own)]
                opened[b + 1] += 1
            counts += np.bincount(a, minlength=k)
            out = batch[["key", "e"]].assign(a=a.astype(np.int32), u=u, ids=list(ids.astype(np.int32)), lb=list(lb), distance=pd.array(list(far), dtype="Int64"), kind=0)
            yield out.assign(cluster=0, place=0, digit=0, value=0)
        found = [(c, p, i, v) for c in range(k) for p, s in enumerate([*sums[c], int(counts[c])]) for i, v in enumerate(digits(s))]
        found += [(-1, z, 0, int(v)) for z, v in enumerate(opened)]
        d = pd.DataFrame(found, columns=["cluster", "place", "digit", "value"])
        yield d.assign(key=None, e=None, a=0, u=0.0, ids=None, lb=None, distance=pd.array([None] * len(d), dtype="Int64"), kind=1)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(of, f"key {kinds['key']}, e {kinds['e']}, {STATE}, distance long, cluster int, place int, digit int, value long, kind int")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, salt: str = "1:", key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]], list[dict[int, int]]]:
    """((key, cluster, distance) of every kept vector, final centroids, how many vectors had which z in each pass).

    Kept vectors have dim components, none null or non-finite; each component x counts as floor(scale * x), whatever its
    size. The first centroids are the k vectors of smallest hexadecimal SHA-256 of salt and key (a null key is the word
    null; equal keys go by vector); of fewer vectors there are fewer. In each round every vector goes to its nearest
    centroid, then a centroid with vectors becomes the floor of their mean; one without stays. distance is the squared
    distance after a last assignment, null where it passes a long. Repeated rows each count. No vectors, no centroids.
    Only key and vector are read.

    A round reads the vectors with their bounds and writes them with the next ones; the round before is deleted. Only
    sums by cluster come to the driver: k (dim + 1) numbers. The bounds kept are k / 4, then as many as were asked for,
    k / 8 at least.
    """
    spark = vectors.sparkSession
    rows = kept(vectors.select(F.col(key).alias("key"), F.col(vector).alias("e")), dim, "e")
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("key").cast("string"), F.lit("null"))), 256)
    first = rows.orderBy(name, "e").limit(k).collect()
    now = Centroids([[whole(v, scale) for v in r.e] for r in first])
    if not first:
        return rows.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], []
    n, moves, b, seen, held = len(first), None, min(max(1, k // 4), len(first) - 1), [], None
    for turn in range(rounds + 1):
        scratch = Scratch(spark, "clusters")
        table = f"{scratch.path}/round"
        made = assigned(rows, now, moves, b, dim, scale)
        made.write.partitionBy("kind").parquet(table)
        made = spark.read.schema(made.schema).parquet(table)
        found = made.where("kind = 1").groupBy("cluster", "place", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect()
        rows = made.where("kind = 0").select("key", "e", "a", "u", "ids", "lb", "distance")
        if held:
            held.clear()
        held = scratch
        total: dict[tuple[int, int], int] = {}
        for r in found:
            total[r.cluster, r.place] = total.get((r.cluster, r.place), 0) + (int(r.v) << (DIGIT * r.digit))
        opened = {p: v for (c, p), v in total.items() if c < 0 and v}
        seen.append(opened)
        if turn < rounds:
            after = Centroids([[total.get((c, p), 0) // total[c, dim] for p in range(dim)] if total.get((c, dim)) else now.exact[c] for c in range(n)])
            if moves is not None:
                b = min(b, max([1, k // 8, *(z for z in opened if z <= b)]))
            moves, now = now.moved(after), after
    return rows.select(F.col("key").alias(key), F.col("a").alias("cluster"), "distance"), now.exact, seen


def with_sums(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """found with cluster_inertia, inertia (sums of distance; null if a distance or the sum passes a long) and centroid_sha256."""
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    # a row a centroid
    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("none")).collect()
    as_long = lambda d, none: int(d) if not none and d < 1 << 63 else None
    every = as_long(sum(int(r.d or 0) for r in by), any(r.none for r in by))
    rows = [(r.cluster, as_long(r.d, r.none), every, names[r.cluster]) for r in by]
    sums = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sums), "cluster")
