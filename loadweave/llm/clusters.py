"""Centroid clustering of integer vectors: Lloyd's rounds, exact, with centroids filtered in rotated space.

Vectors are rotated onto the principal axes of their own covariance once, and stored with the leading
coordinates and the norm of the rest. Against a centroid treated alike, the squared distance of the leading
coordinates plus the squared difference of the two rest norms never exceeds the true squared distance. So
a centroid whose bound lies above the distance to the most promising one is out; the others are measured in
integers. Rounds read the stored table; a task returns one row per centroid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.session import materialise

#: Components are held within this; squared distances of 64 of them then fit a long.
MOST = 1 << 27
#: Vectors against centroids measured at once.
CELLS, PAIRS = 1 << 19, 1 << 15
#: Rounding allowance of a bound, as a share of the squared sum of both norms; rounding is below 1e-12 of it.
SLACK = 1e-9
#: Share of the variance that the leading coordinates hold, and the part of all coordinates they may be at most.
SHARE, AT_MOST = 0.8, 0.5


def quantise(vectors: DataFrame, *, scale: int, dim: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of each component. Vectors that are null, have another number of components
    than ``dim`` or hold a null or non-finite component take no part. Results beyond +-MOST are held there."""
    usable = (F.col(vector).isNotNull() & (F.size(vector) == dim)
              & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(F.least(F.greatest(
        scale * x.cast("double"), F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))
    return vectors.where(usable).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(kind)


@dataclass
class Rotation:
    """Mean and leading principal axes; ``project`` gives leading coordinates and rest norm."""

    mean: np.ndarray
    axes: np.ndarray

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centred = x - self.mean
        lead = centred @ self.axes
        rest = np.einsum("ij,ij->i", centred, centred) - np.einsum("ij,ij->i", lead, lead)
        return lead, np.sqrt(np.maximum(rest, 0))


def fit_rotation(vectors: DataFrame, dim: int) -> Rotation:
    """Principal axes from the moments of all vectors: dim * (dim + 1) sums a task, added up by Spark."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = np.ones((batch.num_rows, dim + 1))
            x[:, :dim] = _matrix(batch.column(0), dim, np.float64)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.record_batch({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()),
                               "s": pa.array(total.ravel(), pa.float64())})

    total = np.zeros((dim + 1, dim + 1))
    sums = vectors.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    for row in sums.collect():  # (dim + 1) squared numbers
        total[row["i"], row["j"]] = row["s"]
    n = max(total[dim, dim], 1)
    mean = total[dim, :dim] / n
    values, axes = np.linalg.eigh(total[:dim, :dim] / n - np.outer(mean, mean))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    reached = np.searchsorted(np.cumsum(values), SHARE * values.sum()) + 1
    lead = int(np.clip(reached, 1, max(1, int(dim * AT_MOST))))
    return Rotation(mean, np.ascontiguousarray(axes[:, :lead]))


class Filter:
    """Finds the nearest centroid of stored vectors."""

    def __init__(self, rotation: Rotation, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        self.lead, self.rest = rotation.project(centroids.astype(np.float64))
        self.square = np.einsum("ij,ij->i", self.lead, self.lead)
        self.norm = np.sqrt(self.square + self.rest ** 2)

    def _exact(self, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        for at in range(0, len(rows), PAIRS):
            part = slice(at, at + PAIRS)
            gap = x[rows[part]] - self.centroids[cols[part]]
            out[part] = np.einsum("ij,ij->i", gap, gap)
        return out

    def bounds(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Numbers not above the squared distances of vectors and centroids."""
        square = np.einsum("ij,ij->i", lead, lead)
        near = square[:, None] - 2 * (lead @ self.lead.T) + self.square + (rest[:, None] - self.rest) ** 2
        norm = np.sqrt(square + rest ** 2)
        return near - SLACK * (norm[:, None] + self.norm) ** 2

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance, distances measured); ties go to the smaller number."""
        k, step = len(self.centroids), max(1, CELLS // len(self.centroids))
        near, distance, measured = np.empty(len(x), np.int32), np.empty(len(x), np.int64), 0
        for at in range(0, len(x), step):
            part = slice(at, at + step)
            some = x[part]
            low = self.bounds(lead[part], rest[part])
            every = np.arange(len(some))
            likely = low.argmin(1)
            found = np.full((len(some), k), np.iinfo(np.int64).max)
            found[every, likely] = first = self._exact(some, every, likely)
            low[every, likely] = np.inf
            rows, cols = np.nonzero(low <= first[:, None])
            found[rows, cols] = self._exact(some, rows, cols)
            near[part] = found.argmin(1)
            distance[part] = found[every, near[part]]
            measured += len(some) + len(rows)
        return near, distance, measured


def _read(batch: pa.RecordBatch, dim: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (_matrix(batch.column("v"), dim, np.int64), _matrix(batch.column("lead"), lead, np.float64),
            batch.column("rest").to_numpy(zero_copy_only=False))


def store(vectors: DataFrame, rotation: Rotation) -> DataFrame:
    """(id, v, lead, rest), written once for all rounds."""
    dim = len(rotation.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation.project(_matrix(batch.column("v"), dim, np.float64))
            ends = pa.array(np.arange(batch.num_rows + 1) * lead.shape[1], pa.int32())
            yield pa.record_batch({"id": batch.column("id"), "v": batch.column("v"),
                                   "lead": pa.ListArray.from_arrays(ends, pa.array(lead.ravel())), "rest": pa.array(rest)})

    return materialise(vectors.mapInArrow(run, "id long, v array<int>, lead array<double>, rest double"), "rotated")


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest SHA-256 of ``seed:id``, in that order; equal ids by their components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in vectors.orderBy(name, "v").limit(k).collect()], np.int64)  # k rows


def moved(stored: DataFrame, rotation: Rotation, centroids: np.ndarray) -> np.ndarray:
    """One round: each vector goes to its nearest centroid, each centroid to the floor of its vectors' mean."""
    k, dim = centroids.shape
    columns = [f"s{i}" for i in range(dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, counts = Filter(rotation, centroids), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, lead, rest = _read(batch, dim, rotation.axes.shape[1])
            near, _, _ = search.nearest(x, lead, rest)
            order = np.argsort(near, kind="stable")
            members = np.bincount(near, minlength=k)
            counts += members
            full = np.flatnonzero(members)
            if len(full):
                starts = np.cumsum(members)[full] - members[full]
                sums[full] += np.add.reduceat(x[order], starts, axis=0)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array(counts[full]), *[pa.array(sums[full, i]) for i in range(dim)]],
            ["cluster", "n", *columns])

    schema = ", ".join(["cluster int", "n long", *[f"{c} long" for c in columns]])
    total = (stored.select("v", "lead", "rest").mapInArrow(run, schema)
             .groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", *columns)]))
    out = centroids.copy()
    for row in total.collect():  # at most k rows
        out[row["cluster"]] = [row[c] // row["n"] for c in columns]
    return out


def assign(stored: DataFrame, rotation: Rotation, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every stored vector, by squared distance."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Filter(rotation, centroids)
        for batch in batches:
            near, distance, _ = search.nearest(*_read(batch, dim, rotation.axes.shape[1]))
            yield pa.record_batch({"id": batch.column("id"), "cluster": pa.array(near, pa.int32()),
                                   "distance": pa.array(distance, pa.int64())})

    return stored.mapInArrow(run, "id long, cluster int, distance long")


def cluster(vectors: DataFrame, *, dim: int, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256,
            key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid) of every usable vector (see ``quantise``).

    Centroids start as the ``seeds``; fewer usable vectors than ``k`` give as many centroids. Empty ones stay
    where they are. Rows that repeat an id or a vector are vectors of their own; a null id stays null and
    counts as the empty text among the seeds; other columns are ignored; no usable vector, no rows. An
    inertia beyond a long is null. Only
    moments, centroids and sums per centroid reach the driver: (dim + 1) squared and k * dim numbers.
    """
    ready = materialise(quantise(vectors, scale=scale, dim=dim, key=key, vector=vector), "whole")
    centroids = seeds(ready, k, seed)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid array<long>")
    rotation = fit_rotation(ready, dim)
    stored = store(ready, rotation)
    for _ in range(rounds):
        centroids = moved(stored, rotation, centroids)
    found = materialise(assign(stored, rotation, centroids), "assigned")
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # at most k rows
    return found.withColumnRenamed("id", key).join(F.broadcast(_facts(spark, sums, centroids)), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _facts(spark, sums: dict[int, int], centroids: Sequence) -> DataFrame:
    """One row per centroid that has vectors; so at most k rows are broadcast."""
    def held(value: int) -> int | None:
        return value if value < 1 << 63 else None

    total = held(sum(sums.values()))
    rows = [(c, held(d), total, centroids[c].tolist()) for c, d in sorted(sums.items())]
    return spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
