"""Exact clustering around integer centroids; candidates come from an annulus of norms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialise

#: Scaled components up to this magnitude have squared distances that fit a long at up to 512 dimensions.
MOST = 1 << 26

#: Pairs of a vector and a candidate that are compared at once.
PAIRS = 1 << 14


class Annuli:
    """Centroids sorted by norm. A centroid within ``u`` of a vector has a norm within ``u`` of the vector's (triangle inequality), so
    two binary searches give all that can be as near as ``u``."""

    def __init__(self, centroids: np.ndarray):
        norm = np.sqrt((centroids.astype(np.int64) ** 2).sum(1).astype(np.float64))
        self.number = np.lexsort((np.arange(len(norm)), norm))
        self.norm, self.sorted = norm[self.number], centroids[self.number].astype(np.int64)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector the number of its nearest centroid (ties: the smaller number), the squared distance, and how many
        candidates were compared. All distances are exact integers; the annulus is widened by more than the norms' rounding, so
        centroids on its border stay in."""
        x = x.astype(np.int64)
        norm = np.sqrt((x * x).sum(1).astype(np.float64))
        # upper bound: the nearer of the two centroids next in norm
        right = np.searchsorted(self.norm, norm).clip(0, len(self.norm) - 1)
        left = (right - 1).clip(0)
        bound = np.sqrt(np.minimum(self._squares(x, right), self._squares(x, left)).astype(np.float64))
        slack = 1e-9 * (1.0 + norm + bound)
        lo = np.searchsorted(self.norm, norm - bound - slack, side="left")
        hi = np.searchsorted(self.norm, norm + bound + slack, side="right")
        many = hi - lo
        best, number = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        ends = np.cumsum(many)
        a = 0
        while a < len(x):  # runs of vectors with about PAIRS candidates together
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
            n, begin = many[a:b], np.concatenate([[0], np.cumsum(many[a:b])[:-1]])
            row = np.repeat(np.arange(a, b), n)
            at = np.arange(n.sum()) - np.repeat(begin, n) + np.repeat(lo[a:b], n)
            d = self._squares(x[row], at)
            best[a:b] = np.minimum.reduceat(d, begin)
            own = np.where(d == best[row], self.number[at], len(self.norm))
            number[a:b] = np.minimum.reduceat(own, begin)
            a = b
        return number, best, many

    def _squares(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        for a in range(0, len(x), PAIRS):
            d = x[a : a + PAIRS] - self.sorted[at[a : a + PAIRS]]
            out[a : a + PAIRS] = np.einsum("nd,nd->n", d, d)
        return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims)


def integers(vectors: DataFrame, dims: int, scale: float) -> DataFrame:
    """``vec_id, x`` of the vectors that take part: exactly ``dims`` components, none null or non-finite, each as
    floor(scale * component) in a row of 32-bit integers. Components whose scaled magnitude is over 2**26 are an error: their
    distances might not fit a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dims)
            own = np.isfinite(flat).all(axis=1)  # a null component reads as NaN
            flat, ids = flat[own], batch.column(0).filter(pa.array(own))
            if len(flat) and np.abs(flat).max() > MOST:
                raise ValueError(f"a scaled component is beyond {MOST}: squared distances would not fit a long")
            yield pa.record_batch([ids, pa.array([r.tobytes() for r in flat.astype(np.int32)], pa.binary())], ["vec_id", "x"])

    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.where(F.size("embedding") == dims).mapInArrow(run, "vec_id long, x binary")


def _assigned(x: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance, compared`` of each vector."""
    shared = x.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annuli(shared.value)
        for batch in batches:
            number, distance, many = near.assign(_matrix(batch.column(1), shared.value.shape[1]))
            yield pa.record_batch([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance), pa.array(many.astype(np.int32))], ["vec_id", "cluster", "distance", "compared"])

    return x.mapInArrow(run, "vec_id long, cluster int, distance long, compared int")


def _moved(x: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the exact floor of each cluster's mean, empty ones as they were. A task sums up what it assigns
    and sends one row a cluster; the sums, k rows, come to the driver as decimals."""
    shared = x.sparkSession.sparkContext.broadcast(centroids)
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annuli(shared.value)
        sums, sizes = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            own = _matrix(batch.column(1), dims)
            number = near.assign(own)[0]
            sizes += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            present, begin = np.unique(number[order], return_index=True)
            if len(present):
                sums[present] += np.add.reduceat(own[order].astype(np.int64), begin, axis=0)
        met = np.flatnonzero(sizes)
        yield pa.record_batch([pa.array(met.astype(np.int32)), pa.array(sizes[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    part = x.mapInArrow(run, "cluster int, n long, sums array<long>")
    total = part.select("cluster", "n", F.posexplode("sums").alias("pos", "s")).groupBy("cluster", "pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = centroids.copy()
    for r in total.collect():
        out[r["cluster"], r["pos"]] = int(r["s"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """Clusters of ``vectors(vec_id, embedding)`` in integer arithmetic, and the final centroids (k x dims).

    Rows: ``vec_id, cluster, distance`` (squared)``, cluster_inertia, inertia, centroid_sha256`` and ``compared``, the number of
    candidates in the vector's annulus. Vectors take part as told at ``integers``. The first centroids are the k vectors of the
    smallest sha256 of ``seed:vec_id``, in that order (vectors that share a vec_id: by their bytes; a vector without vec_id starts
    none); with fewer vectors there are fewer centroids. Each round assigns every vector to the nearest centroid, ties to the
    smaller number, and moves the centroids to the floor of their vectors' means; an empty cluster keeps its centroid. Repeated rows count
    as often as they occur, other columns are ignored, an empty table gives no rows; vectors that all lack a vec_id start no centroid
    and give no rows either.

    The integer vectors are written once, 4 bytes a component; a round reads them once and shuffles a row for each task and cluster.
    Only centroids, sums and totals, k rows each, come to the driver and are broadcast.
    """
    spark = vectors.sparkSession
    x = materialise(integers(vectors, dims, scale), "centroid-vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = x.where("vec_id is not null").withColumn("h", name).orderBy("h", "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared int"), np.zeros((0, dims), np.int64)
    centroids = np.array([np.frombuffer(r["x"], np.int32) for r in first], np.int64)
    for _ in range(rounds):
        centroids = _moved(x, centroids)
    assigned = materialise(_assigned(x, centroids), "centroid-assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    drop_scratch(spark, x)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(n, sums[n], sum(sums.values()), digest[n]) for n in sorted(sums)]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each of the k clusters
    out = assigned.join(F.broadcast(totals), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"), centroids
