"""Operator 13: clusters of vectors around centroids, found by the threshold algorithm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, settle

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Scaled components up to this size: 64 squares of differences then fit a long.
LARGEST = 1 << 27
_FAR = np.iinfo(np.int64).max


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each point's nearest centroid, ties to the smaller number.

    Every dimension lists the centroids by value. From a point's own value the list is
    walked outward, one centroid a round in every dimension; each centroid that is met
    first is measured exactly. Centroids not met yet are at least as far in every
    dimension as its frontier, so a point is done when the frontiers' squares add up to
    more than its best distance; at an equal sum one of them might still tie.
    """
    n, d = points.shape
    k = len(centroids)
    listed = np.argsort(centroids, axis=0, kind="stable").T
    values = np.take_along_axis(centroids.T, listed, 1)
    dims = np.arange(d)
    right = np.stack([np.searchsorted(values[j], points[:, j]) for j in dims], 1)
    left = right - 1
    best, number = np.full(n, _FAR), np.full(n, k)
    met = np.zeros((n, k), bool)
    live = np.arange(n)
    for _ in range(k):
        x, lo, hi = points[live], left[live], right[live]
        below = np.where(lo >= 0, x - values[dims, np.maximum(lo, 0)], _FAR)
        above = np.where(hi < k, values[dims, np.minimum(hi, k - 1)] - x, _FAR)
        down = below <= above
        frontier = np.minimum(below, above)
        found = listed[dims, np.where(down, lo, hi)]
        left[live], right[live] = lo - down, hi + ~down
        fresh = np.zeros((len(live), k), bool)
        fresh[np.arange(len(live))[:, None], found] = True
        fresh &= ~met[live]
        met[live] |= fresh
        row, centroid = np.nonzero(fresh)
        if len(row):
            far = ((x[row] - centroids[centroid]) ** 2).sum(1)
            first = np.lexsort((centroid, far, row))
            first = first[np.append(True, np.diff(row[first]) > 0)]
            at, far, centroid = live[row[first]], far[first], centroid[first]
            better = (far < best[at]) | ((far == best[at]) & (centroid < number[at]))
            best[at[better]], number[at[better]] = far[better], centroid[better]
        live = live[(frontier**2).sum(1) <= best[live]]
        if not len(live):
            break
    return number, best


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, dimensions)


def _sums(centroids: np.ndarray):
    """Of a task's points: count and sum of each component in each cluster."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            points = _matrix(batch["point"], d)
            number, _ = nearest(points, centroids)
            np.add.at(total, number, points)
            size += np.bincount(number, minlength=k)
        held = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(held, d).astype(np.int32)),
                pa.array(np.tile(np.arange(d), len(held)).astype(np.int32)),
                pa.array(total[held].ravel()),
                pa.array(np.repeat(size[held], d)),
            ],
            names=["cluster", "component", "total", "size"],
        )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, far = nearest(_matrix(batch["point"], centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(number.astype(np.int32)), pa.array(far)],
                names=["vec_id", "cluster", "distance"],
            )

    return run


def _points(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """vec_id and point, whole numbers, of the vectors that can be compared."""

    def whole(x: Column) -> Column:
        scaled = x * F.lit(float(scale))
        return F.when(F.abs(scaled) <= LARGEST, F.floor(scaled)).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is over {LARGEST}")).cast("long")
        )

    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    doubles = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return doubles.filter((F.size("embedding") == dimensions) & F.forall("embedding", finite)).select(
        "vec_id", F.transform("embedding", whole).alias("point")
    )


def centroids_of(points: DataFrame, clusters: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids after ``rounds`` of assignment; fewer than ``clusters`` where points are fewer."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = points.orderBy(F.sha2(name, 256), "point").limit(clusters).select("point").collect()
    centroids = np.array([r.point for r in first], np.int64)
    for _ in range(rounds if len(centroids) else 0):
        sums = (
            points.select("point")
            .mapInArrow(_sums(centroids), "cluster int, component int, total long, size long")
            .groupBy("cluster", "component")
            .agg(F.sum("total").alias("total"), F.sum("size").alias("size"))
        )
        for r in sums.collect():  # clusters x dimensions at most
            centroids[r.cluster, r.component] = r.total // r["size"]
    return centroids


def cluster_vectors(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector.

    Components become floor(scale * x). The first centroids are the vectors whose
    ``<seed>:<vec_id>`` has the smallest SHA-256 (of equal ones, a null id counting as
    none, the smaller vector). Each round moves every centroid that has vectors to the floor of their
    mean; the rows show the assignment that follows. Only centroids (``clusters`` x
    ``dimensions`` numbers, both parameters) and their sums go through the driver.

    Vectors that are null, of another length or hold null or non-finite components have
    no row. Repeated rows and ids count as often as they occur. With fewer vectors than
    ``clusters`` there are as many centroids as vectors, equal ones going to the smaller
    number; an empty table gives no rows. A component beyond LARGEST after scaling is an error, since
    distances would not fit. Further columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    points = _points(vectors, dimensions, scale)
    centroids = centroids_of(points, clusters, rounds, seed).reshape(-1, dimensions)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    assigned = settle(points.mapInArrow(_assigned(centroids), f"vec_id {kind}, cluster int, distance long"))
    inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = spark.createDataFrame(
        [
            (i, own, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest())
            for i, own in inertia.items()
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
