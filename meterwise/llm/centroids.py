"""Clustering of vectors by rounds of nearest centroids, over dictionaries of distinct subvectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterwise.session import materialize

CHUNK = 8192  # vectors that share one set of dictionaries
WIDTH = 2  # dimensions of a subvector
SMALL = 1 << 27  # whole-number components below this leave every squared distance of 64 of them inside a long
LONG = 2**63 - 1


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """``(vec_id, q)``: vectors of exactly ``dimensions`` finite components as whole numbers floor(scale * x)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.coalesce((F.size("v") == dimensions) & fine, F.lit(False))).select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale))).alias("q"))


def _subvectors(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, code of each row) of a block of dimensions."""
    low, high = q.min(axis=0), q.max(axis=0)
    if q.shape[1] <= 2 and max(abs(int(x)) for x in (*low, *high)) < SMALL:  # one key for both dimensions sorts faster
        span = int(high[-1] - low[-1]) + 1
        key = (q[:, 0] - low[0]) * (span if q.shape[1] == 2 else 1) + (q[:, 1] - low[1] if q.shape[1] == 2 else 0)
        _, first, code = np.unique(key, return_index=True, return_inverse=True)
        return q[first], code.astype(np.int32)
    words, code = np.unique(q, axis=0, return_inverse=True)
    return words, code.reshape(-1).astype(np.int32)


ENCODED = "ids array<long>, words array<array<long>>, codes array<array<int>>"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of vectors: for every block of dimensions its distinct subvectors, one after the other, and the code of
    each vector's subvector.  Nothing is lost: word and code give the components back."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            q = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            blocks = [_subvectors(q[:, d:d + WIDTH]) for d in range(0, q.shape[1], WIDTH)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                 pa.array([[w.reshape(-1) for w, _ in blocks]], pa.list_(pa.list_(pa.int64()))),
                 pa.array([[c for _, c in blocks]], pa.list_(pa.list_(pa.int32())))], ["ids", "words", "codes"])


def _chunks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]]:
    """(ids, [(words, codes) of each block]) of every chunk."""
    widths = [min(WIDTH, dimensions - d) for d in range(0, dimensions, WIDTH)]
    for batch in batches:
        for i in range(batch.num_rows):
            words, codes = batch.column(1)[i].values, batch.column(2)[i].values
            yield batch.column(0)[i].values, [
                (words[b].values.to_numpy(zero_copy_only=False).reshape(-1, w), codes[b].values.to_numpy(zero_copy_only=False)) for b, w in enumerate(widths)]


def _nearest(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector: every distinct subvector is compared with the centroids once, and a
    vector's distances are the sums of what its codes say.  Exact; ties go to the smaller number."""
    small = all(w.size == 0 or -SMALL < int(w.min()) <= int(w.max()) < SMALL for w, _ in blocks) and all(abs(x) < SMALL for x in centroids.ravel())
    kind = np.int64 if small else object  # beyond a long, Python's whole numbers
    total, d = 0, 0
    for words, codes in blocks:
        apart = words.astype(kind)[:, None, :] - centroids[None, :, d:d + words.shape[1]].astype(kind)
        total = total + (apart * apart).sum(axis=2)[codes]
        d += words.shape[1]
    cluster = np.argmin(total, axis=1)
    return cluster, total[np.arange(len(cluster)), cluster]


def _sums(centroids: np.ndarray):
    """One row for each cluster and dimension of a partition: how many vectors, and the exact sum of their components."""
    k, dimensions = centroids.shape

    def run(batches):
        count, total = [0] * k, np.zeros((k, dimensions), dtype=object)
        for _, blocks in _chunks(batches, dimensions):
            cluster, _ = _nearest(blocks, centroids)
            n = np.bincount(cluster, minlength=k)
            count = [a + int(b) for a, b in zip(count, n)]
            d = 0
            for words, codes in blocks:
                often = np.bincount(cluster * len(words) + codes, minlength=k * len(words)).reshape(k, len(words))
                total[:, d:d + words.shape[1]] += (often @ words).astype(object) if -SMALL < int(words.min()) <= int(words.max()) < SMALL else often.astype(object) @ words.astype(object)
                d += words.shape[1]
        held = [c for c in range(k) if count[c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c in held for _ in range(dimensions)], pa.int32()), pa.array([d for _ in held for d in range(dimensions)], pa.int32()),
             pa.array([count[c] for c in held for _ in range(dimensions)], pa.int64()), pa.array([str(x) for c in held for x in total[c]], pa.string())],
            ["cluster", "dimension", "n", "total"])
    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for ids, blocks in _chunks(batches, centroids.shape[1]):
            cluster, distance = _nearest(blocks, centroids)
            if distance.dtype == object:
                distance = np.array([min(LONG, x) for x in distance], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])
    return run


def _first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id; vectors under one id by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(order.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r["q"] for r in first], dtype=object)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dimensions: int = 64, scale: int = 64,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(``(vec_id, cluster, distance)`` for every kept vector, the final centroids).

    Vectors are kept if they have exactly ``dimensions`` components, none null or not finite, and become whole numbers
    floor(scale * x).  They are written once as chunks: each block of ``WIDTH`` dimensions as the chunk's distinct
    subvectors and the code of every vector.  A round reads the chunks, compares each distinct subvector with the
    centroids once, adds partial distances by code, and gives one partial sum for each partition, cluster and
    dimension; Spark adds them up, and k x ``dimensions`` sums come to the driver.  All arithmetic is exact.

    Fewer than k vectors make fewer centroids; an empty table gives no rows.  Ties of distance go to the smaller
    centroid, an empty centroid stays.  Null ids count as the empty string where ids are hashed; repeated rows are
    vectors of their own.  Components beyond a long are held at its ends, and so are distances.  Other columns are not
    looked at, whatever their names.
    """
    whole = whole_vectors(vectors, id_col, vector_col, dimensions, scale)
    centroids = _first_centroids(whole, k, seed)
    if not len(centroids):
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    chunks = materialize(whole.mapInArrow(_encode, ENCODED))
    for _ in range(rounds):
        partial = chunks.mapInArrow(_sums(centroids), "cluster int, dimension int, n long, total string")
        sums = partial.groupBy("cluster", "dimension").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        centroids = centroids.copy()
        for r in sums:
            centroids[r["cluster"], r["dimension"]] = int(r["total"]) // r["n"]
    found = chunks.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long")
    return found, [[int(x) for x in c] for c in centroids]


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``found`` and, for each row, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of its cluster."""
    spark = found.sparkSession
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    saved = materialize(found)
    sums = {r[0]: int(r[1]) for r in saved.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = min(LONG, sum(sums.values()))
    rows = [(c, min(LONG, n), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, n in sums.items()]
    return saved.join(spark.createDataFrame(rows, schema), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
