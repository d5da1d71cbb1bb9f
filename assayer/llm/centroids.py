"""Centroid clustering by a bisector tournament, in exact integers.

A component x counts as the integer floor(256 * x). For each pair of centroids i < j the bisector has an integer normal
2 (c_j - c_i) and a threshold |c_j|^2 - |c_i|^2; a vector whose product with the normal is over the threshold is nearer
to j, and zero favours i. Each vector runs a knock-out over its k centroids: k - 1 such sign tests leave one, whose exact
squared distance is then taken. In the first rounds of a knock-out all vectors meet the same bisectors (one matrix
product); later each takes the bisector of the two that are left to it.

Spark deals the vectors; a task returns, for each centroid and component, its vectors' sum and count, which are added by
a shuffle. What the driver holds are the k centroids alone (k times the vector's length, whatever the number of rows).
Vectors are read once, turned into integers and written; each round reads them from there.

Defined results: rows whose vector is null, has another length, or holds a null or non-finite component, or one whose
integer is 2**62 or more in size, are left out, as are rows without an id. Repeated rows and ids count each on their
own. With fewer vectors than k there are as many centroids as vectors; of equal hashes the smaller vector comes first.
Sums are exact whatever their size; a distance or sum of distances over 2**63 - 1 is null. An empty table gives an empty
one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.tables import written

#: Up to this size of a component all sums of products are exact in doubles (2 * 2**22 * 2**21 * 512 < 2**53).
SMALL, MOST_SMALL = 1 << 21, 512
LARGEST = (1 << 63) - 1
SUM = "decimal(38,0)"


def integers(vector: Column) -> Column:
    """The vector's components as longs."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def usable(vector: Column, size: int) -> Column:
    """Has the vector exactly ``size`` components, each a number of the range?"""
    wide = F.lit(float(1 << 54))
    return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < wide), F.lit(False))), F.lit(False))


class Bisectors:
    """Normals and thresholds of all pairs of some centroids."""

    def __init__(self, centroids: list[list[int]]) -> None:
        kind = np.float64 if len(centroids[0]) <= MOST_SMALL and max(abs(x) for c in centroids for x in c) < SMALL else object
        c = np.array(centroids, kind)
        self.centroids, self.kind = c, kind
        square = (c * c).sum(axis=1)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        self.thresholds = square[None, :] - square[:, None]

    def exact(self) -> Bisectors:
        """The same in integers of any size."""
        if self.kind is object:
            return self
        out = Bisectors.__new__(Bisectors)
        out.kind = object
        for name in ("centroids", "normals", "thresholds"):
            own = getattr(self, name)
            setattr(out, name, own.astype(np.int64).astype(object))
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row of integers, and the exact squared distance."""
        if self.kind is not object and len(x) and int(np.abs(x).max()) >= SMALL:
            small = np.abs(x).max(axis=1) < SMALL
            number, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
            number[small], distance[small] = self.nearest(x[small])
            number[~small], distance[~small] = self.exact().nearest(x[~small])
            return number, distance
        x = x.astype(self.kind)
        k = len(self.centroids)
        # the standing of each vector: column j is who is left of its j-th part of the centroids
        left = list(range(k))  # while all vectors have met the same pairs only the numbers are held
        pairs = np.arange(0, k - 1, 2)
        standing = np.tile(np.array(left), (len(x), 1))
        if len(pairs):
            over = x @ self.normals[pairs, pairs + 1].T > self.thresholds[pairs, pairs + 1]
            standing = np.concatenate([np.where(over, pairs + 1, pairs), standing[:, 2 * len(pairs) :]], axis=1)
        while standing.shape[1] > 1:
            met = standing.shape[1] // 2
            out = np.empty((len(x), met), np.int64)
            for m in range(met):
                i, j = standing[:, 2 * m], standing[:, 2 * m + 1]
                out[:, m] = np.where((x * self.normals[i, j]).sum(axis=1) > self.thresholds[i, j], j, i)
            standing = np.concatenate([out, standing[:, 2 * met :]], axis=1)
        number = standing[:, 0] if len(x) else np.zeros(0, np.int64)
        return number, ((x - self.centroids[number]) ** 2).sum(axis=1)


def _rows(column: pd.Series, size: int) -> np.ndarray:
    return np.concatenate(column.to_list()).reshape(-1, size).astype(np.int64) if len(column) else np.zeros((0, size), np.int64)


def _sums(vectors: DataFrame, bisectors: Bisectors, size: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each centroid's vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(bisectors)
    k = len(bisectors.centroids)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's sums, of all its batches."""
        count, total = np.zeros(k, np.int64), np.zeros((k, size), object)
        for batch in batches:
            x = _rows(batch["vector"], size)
            number, _ = shared.value.nearest(x)
            count += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            own, first = np.unique(number[order], return_index=True)
            if len(own):
                x = x[order] if np.abs(x).max() < SMALL else x[order].astype(object)
                total[own] += np.add.reduceat(x, first, axis=0).astype(object)
        held = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": np.repeat(held, size), "place": np.tile(np.arange(size), len(held)), "n": np.repeat(count[held], size), "total": [Decimal(int(v)) for v in total[held].ravel()]})

    parts = vectors.select("vector").mapInPandas(added, f"cluster int, place int, n long, total {SUM}")
    found = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").cast(SUM).alias("total")).collect()  # k * size rows at most
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(found):
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return out


def clustered(table: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2, vec: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = table.sparkSession
    kept = table.select(F.col(vec).alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"), size))
    vectors = written(kept.select("vec_id", integers(F.col("v")).alias("vector")), "vectors")
    first = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "vector").limit(k)
    centroids = [list(r["vector"]) for r in first.collect()]
    names = "vec_id {}, cluster int, distance long".format(vectors.schema["vec_id"].dataType.simpleString())
    if not centroids:
        return spark.createDataFrame([], f"{names}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        for i, (n, total) in _sums(vectors, Bisectors(centroids), size).items():
            centroids[i] = [v // n for v in total]
    shared = spark.sparkContext.broadcast(Bisectors(centroids))

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, distance = shared.value.nearest(_rows(batch["vector"], size))
            exact = distance.astype(np.int64) if distance.dtype != object else [int(d) if d <= LARGEST else None for d in distance]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": number, "distance": pd.Series(exact, dtype="Int64")})

    out = written(vectors.mapInPandas(assigned, names), "assigned")
    fits = lambda c: F.when(c <= LARGEST, c).cast("long")
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast(SUM)))
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(total.alias("s")).collect()}  # k rows at most
    all_of = None if any(s is None for s in sums.values()) else sum(sums.values())
    own = [(i, s, all_of, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, s in sums.items()]
    told = spark.createDataFrame(own, f"cluster int, s {SUM}, a {SUM}, centroid_sha256 string")
    told = told.select("cluster", fits(F.col("s")).alias("cluster_inertia"), fits(F.col("a")).alias("inertia"), "centroid_sha256")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
