"""Centroid clustering of vectors of whole numbers, with the candidates of each vector found in an annulus.

By the triangle inequality a centroid nearer than a bound u has a norm within u
of the vector's. Centroids are sorted by norm; a vector's bound is its distance
to the centroid of nearest norm, a binary search finds those in the annulus, and
only these are compared, in whole numbers, so that equal distances are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.shared import stash

WIDTH, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Components up to which squared distances of 64 of them fit a long; larger ones are refused.
MOST = 1 << 27
#: Up to this the sums of products of 64 components are exact in doubles.
EXACT = 1 << 22
ROWS = 4096


@dataclass
class Centroids:
    """Whole-number centroids in their order, and by norm."""

    rows: np.ndarray

    def __post_init__(self):
        self.squares = (self.rows**2).sum(axis=1)
        self.by_norm = np.argsort(self.squares, kind="stable")
        self.norms = np.sqrt(self.squares[self.by_norm].astype(float))

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in self.rows.tolist()]


def _distances(x: np.ndarray, squares: np.ndarray, centre: np.ndarray, square: int, exact: bool) -> np.ndarray:
    """Squared distances of rows to a centroid: by products where doubles hold them exactly."""
    if exact:
        return squares + square - 2 * (x.astype(float) @ centre.astype(float)).astype(np.int64)
    return ((x - centre) ** 2).sum(axis=1)


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of each row, the smaller number at ties; and how many were compared."""
    squares, c = (x**2).sum(axis=1), centroids
    exact = max(np.abs(x).max(initial=0), np.abs(c.rows).max(initial=0)) <= EXACT
    norms = np.sqrt(squares.astype(float))
    right = np.clip(np.searchsorted(c.norms, norms), 0, len(c.norms) - 1)
    left = np.maximum(right - 1, 0)
    guess = np.where(np.abs(c.norms[left] - norms) <= np.abs(c.norms[right] - norms), left, right)
    best, found = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)

    def compare(rows: np.ndarray, place: int) -> None:
        number = c.by_norm[place]
        d = _distances(x[rows], squares[rows], c.rows[number], c.squares[number], exact)
        better = (d < best[rows]) | (d == best[rows]) & (number < found[rows])
        best[rows[better]], found[rows[better]] = d[better], number

    for place in np.unique(guess):
        compare(np.flatnonzero(guess == place), place)
    bound = np.sqrt(best.astype(float))
    slack = 1e-9 * (1 + norms + bound)  # norms are rounded; what lies on the edge is compared
    low = np.searchsorted(c.norms, norms - bound - slack, side="left")
    high = np.searchsorted(c.norms, norms + bound + slack, side="right")
    compared = len(x)
    for place in range(len(c.norms)):
        rows = np.flatnonzero((low <= place) & (place < high) & (guess != place))
        compared += len(rows)
        if len(rows):
            compare(rows, place)
    return found.astype(np.int32), best, compared


def _whole(batch: pa.RecordBatch, k: int, scale: int) -> np.ndarray:
    part = batch.column(1).slice(k, ROWS)
    x = np.floor(scale * part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(part), -1)
    if np.abs(x).max(initial=0) > MOST:
        raise ValueError(f"a component times {scale} is over {MOST}; its squared distances do not fit a long")
    return x.astype(np.int64)


def _cluster_sums(vectors: DataFrame, centroids: Centroids, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact (sums, counts) per cluster: each task adds up its own, clusters times components numbers go to the driver."""
    shape = (len(centroids.rows), centroids.rows.shape[1] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                x = _whole(batch, k, scale)
                near = nearest(x, centroids)[0]
                order = np.argsort(near, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
                total[near[order][starts], :-1] += np.add.reduceat(x[order], starts, axis=0)
                total[:, -1] += np.bincount(near, minlength=len(total))
        if total[:, -1].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    summed = vectors.mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(shape, np.int64).ravel()
    out[summed.column("at").to_numpy()] = summed.column("v").to_numpy()
    return out.reshape(shape)[:, :-1], out.reshape(shape)[:, -1]


def cluster_vectors(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """The cluster of every vector after some rounds from hashed starts.

    Vectors (``embedding`` of ``vec_id``) with another number of components than
    ``width``, or a null or non-finite one, are left out; each component becomes
    floor(``scale`` * x). The ``clusters`` vectors whose ``seed:vec_id`` has the
    smallest sha256 are the first centroids (a null id is written as nothing; of
    rows that repeat an id the smaller vector comes first, each a start of its
    own). A round assigns every vector to the nearest centroid, the smaller
    number at ties, and puts each centroid at its vectors' rounded-down means;
    one without vectors stays. With fewer vectors than ``clusters`` there are as
    many centroids as vectors; an empty table gives an empty one. Components
    beyond 2 ** 27 after scaling are a ValueError, as their squared distances
    do not fit a long. Only the two columns named are read.

    A round is one pass that sends clusters times ``width`` numbers to the
    driver, whatever the number of vectors; nothing is written between rounds.
    Returns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.
    """
    usable = (F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = embeddings.where(F.coalesce(usable, F.lit(False))).select("vec_id", "embedding")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    first = vectors.orderBy(start, whole).limit(clusters).select(start.alias("h"), whole.alias("v")).collect()  # a row per centroid
    out = "vec_id {}, cluster int, distance long".format(embeddings.schema["vec_id"].dataType.simpleString())
    centroids = Centroids(np.array([r["v"] for r in sorted(first, key=lambda r: (r["h"], r["v"]))], np.int64).reshape(len(first), width))
    if len(first):
        _checked(centroids.rows, scale)
    for _ in range(rounds if len(first) else 0):
        sums, counts = _cluster_sums(vectors, centroids, scale)
        centroids = Centroids(np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids.rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                found, distance, _ = nearest(_whole(batch, k, scale), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, ROWS), pa.array(found), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = stash(vectors.mapInArrow(run, out))
    inertias = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(c, d) for c, d in enumerate(centroids.digests())]
    facts = inertias.join(F.broadcast(embeddings.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    found = [(r["cluster"], r["cluster_inertia"], r["centroid_sha256"]) for r in facts.collect()]  # a row per centroid
    whole_inertia = sum(i for _, i, _ in found)
    known = embeddings.sparkSession.createDataFrame([(c, i, whole_inertia, d) for c, i, d in found], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _checked(rows: np.ndarray, scale: int) -> None:
    if np.abs(rows).max(initial=0) > MOST:
        raise ValueError(f"a component times {scale} is over {MOST}; its squared distances do not fit a long")
