"""Clustering of vectors around centroids in exact integers, with partial-distance search.

Every component x becomes floor(1024 x).  Assignment adds up squared differences over the dimensions of highest
variance first.  The centroid that is nearest after the first few is followed to the end; every other one is
abandoned as soon as its partial sum is strictly above that distance, and the survivors finish all dimensions, so that
ties are seen and go to the smaller number.  Tasks return counts and sums of their vectors for each centroid;
only these, added up, come to the driver: as many rows as there are centroids.

Vectors are written once as packed integers to the shared folder; each round reads them.  They are 32-bit where all
components are below 2**26 in size, so that distances are 64-bit sums; other vectors are computed with Python's
integers.

Defined results: vectors of another length, or null, or with null or non-finite components are left out; rows
with a null id are vectors, but start no centroid; repeated ids are vectors of their own (starts go by hash, then by components);
with fewer vectors than centroids there are as many centroids as vectors; components beyond 2**62 count as 2**62, and distances
and inertias beyond 2**63 - 1 as that; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.cluster import Shelf

SCALE = 1024
#: Up to this size a squared distance of a few thousand dimensions fits 64 bits.
SMALL = 1 << 26
LARGEST, MOST = 1 << 62, (1 << 63) - 1
#: Dimensions added at a time.
STEP = 8


def quantised(x: float) -> int:
    """floor(1024 x), at most LARGEST in size."""
    whole = math.floor(x * SCALE) if abs(x) < 1 << 60 else int(x) * SCALE
    return max(-LARGEST, min(LARGEST, whole))


def packed(vectors: np.ndarray) -> list[bytes]:
    """Each vector's integers: 32-bit, or 64-bit where that is too small."""
    scaled = np.floor(vectors * float(SCALE))
    small = (np.abs(scaled) < SMALL).all(1)
    narrow = np.where(small[:, None], scaled, 0).astype("<i4")
    return [narrow[i].tobytes() if ok else np.array([quantised(x) for x in vectors[i].tolist()], "<i8").tobytes() for i, ok in enumerate(small.tolist())]


def unpacked(rows: pa.Array, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors: the 32-bit ones as 64-bit integers, the others as Python's."""
    size = np.diff(np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1])
    for width, kind in ((4, np.int64), (8, object)):
        at = np.flatnonzero(size == width * d)
        if len(at):
            raw = b"".join(rows.take(pa.array(at)).to_pylist())
            yield at, np.frombuffer(raw, f"<i{width}").reshape(-1, d).astype(kind)


def nearest(x: np.ndarray, centroids: list[list[int]], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number) and its squared distance.

    `order` has the dimensions in the order in which they are added."""
    exact = x.dtype == object or any(abs(v) >= SMALL for c in centroids for v in c)
    kind = object if exact else np.int64
    x, c = x.astype(kind)[:, order], np.array(centroids, kind).reshape(len(centroids), -1)[:, order]
    d = x.shape[1]

    def part(i: np.ndarray, k: np.ndarray, low: int, high: int) -> np.ndarray:
        diff = x[i, low:high] - c[k, low:high]
        return (diff * diff).sum(1)

    all_rows = np.arange(len(x))
    first = np.stack([part(all_rows, np.full(len(x), k), 0, STEP) for k in range(len(c))], 1)
    lead = np.argmin(first, 1)
    best = first[all_rows, lead] + part(all_rows, lead, STEP, d)
    alive = first <= best[:, None]
    alive[all_rows, lead] = False
    i, k = np.nonzero(alive)
    partial = first[i, k]
    for low in range(STEP, d, STEP):
        partial = partial + part(i, k, low, low + STEP)
        stays = partial <= best[i]
        i, k, partial = i[stays], k[stays], partial[stays]
    own = best.copy()
    np.minimum.at(best, i, partial)
    cluster = np.where(own == best, lead, len(c))
    tied = partial == best[i]
    np.minimum.at(cluster, i[tied], k[tied])
    return cluster, best


def integers(vectors: DataFrame, key: str, vector: str, d: int) -> DataFrame:
    """Key and packed integers of the vectors that have d components, none null or non-finite."""
    kind = vectors.schema[key].dataType.simpleString()
    value = F.col(vector)
    known = vectors.where(value.isNotNull() & (F.size(value) == d)).select(F.col(key), value.cast("array<double>").alias("v"))
    finite = known.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed(b.column(1).flatten().to_numpy().reshape(-1, d)), pa.binary())], [key, "v"])

    return finite.mapInArrow(run, f"{key} {kind}, v binary")


def sums(kept: DataFrame, centroids: list[list[int]], order: np.ndarray, d: int) -> dict[int, tuple[int, int, list[int]]]:
    """For each centroid that has vectors: their number, the sum of their distances, the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for _, x in unpacked(b.column(0), d):
                cluster, distance = nearest(x, centroids, order)
                for k in np.unique(cluster).tolist():
                    own = cluster == k
                    n, inertia, parts = total.get(k, (0, 0, [0] * d))
                    total[k] = [n + int(own.sum()), inertia + sum(distance[own].tolist()), [a + b for a, b in zip(parts, x[own].sum(0).tolist(), strict=True)]]
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([Decimal(min(t[1], MOST << 32)) for t in total.values()], pa.decimal128(38, 0)), pa.array([list(map(Decimal, t[2])) for t in total.values()], pa.list_(pa.decimal128(38, 0)))],
                ["cluster", "n", "inertia", "parts"],
            )

    tasks = kept.select("v").mapInArrow(run, "cluster int, n long, inertia decimal(38,0), parts array<decimal(38,0)>")
    added = tasks.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(*[F.sum(F.col("parts")[j]) for j in range(d)]).alias("parts"))
    return {r.cluster: (r.n, int(r.inertia), list(map(int, r.parts))) for r in added.collect()}


def spread(kept: DataFrame, d: int) -> np.ndarray:
    """The dimensions by falling variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(d), np.zeros(d)
        for b in batches:
            for _, x in unpacked(b.column(0), d):
                x = x.astype(float)
                n, one, two = n + len(x), one + x.sum(0), two + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([one.tolist()]), pa.array([two.tolist()])], ["n", "one", "two"])

    tasks = kept.select("v").mapInArrow(run, "n long, one array<double>, two array<double>")
    total = tasks.agg(F.sum("n"), F.array(*[F.sum(F.col("one")[j]) for j in range(d)]), F.array(*[F.sum(F.col("two")[j]) for j in range(d)])).first()
    if not total[0]:
        return np.arange(d)
    mean = np.array(total[1], float) / total[0]
    return np.argsort(mean * mean - np.array(total[2], float) / total[0], kind="stable")


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", d: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """One row for each kept vector: key, cluster, distance (squared, to the final centroid), cluster_inertia, inertia,
    centroid_sha256 (of the centroid's components in decimal, joined by commas)."""
    shelf = Shelf(vectors.sparkSession)
    kept = shelf.put(integers(vectors, key, vector, d))
    first = kept.where(F.col(key).isNotNull()).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), "v").limit(k).select("v").collect()
    centroids = [np.frombuffer(r.v, "<i4" if len(r.v) == 4 * d else "<i8").tolist() for r in first]
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    order = spread(kept, d)
    for _ in range(rounds):
        got = sums(kept, centroids, order, d)
        new = [[s // got[i][0] for s in got[i][2]] if i in got else c for i, c in enumerate(centroids)]
        if new == centroids:
            break  # all later rounds would repeat this one
        centroids = new
    else:
        got = sums(kept, centroids, order, d)
    each = [min(got[i][1], MOST) if i in got else 0 for i in range(len(centroids))]
    inertia = min(sum(x[1] for x in got.values()), MOST)
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for at, x in unpacked(b.column(1), d):
                c, distance = nearest(x, centroids, order)
                own[at], far[at] = c, [min(v, MOST) for v in distance.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own), pa.array(far), pa.array(np.array(each, np.int64)[own]), pa.array(np.full(b.num_rows, inertia)), pa.array([named[i] for i in own.tolist()], pa.string())], [key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return kept.mapInArrow(run, schema)
