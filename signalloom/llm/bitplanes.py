"""k-means on integer vectors by popcounts of bit planes (dealt operator 12).

A vector of 64 integer components is kept as its bit planes: plane ``p`` packs bit ``p`` of all components into one
unsigned 64-bit word, in two's complement, so the top plane counts negative. The dot product of a vector and a centroid is
then the sum over plane pairs of ``weight * weight * popcount(plane & plane)``, which is exact, and the squared distance
follows from it and both norms. Component sums of a cluster are plane-wise bit counts with the same weights.

A round is one pass over the stored planes: tasks assign their vectors and return one row per cluster and task, 64 sums
and a count. Spark adds them, and the driver reads one row per centroid, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.store import stored

#: Components of a vector; one plane is one 64-bit word.
WIDTH = 64
#: Components are below 2 ** LIMIT in size, so squared distances fit into a long.
LIMIT = 27


def weights(planes: int) -> np.ndarray:
    """Value of a bit in each plane: powers of two, the last one negative."""
    value = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    value[-1] = -value[-1]
    return value


def to_planes(values: np.ndarray) -> np.ndarray:
    """Planes (rows, planes) of integer rows of ``WIDTH`` components, as many as the largest component needs."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    planes = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
    bits = (values[:, None, :] >> np.arange(planes, dtype=np.int64)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def dots(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact dot products (vectors, centroids) of two sets of planes."""
    left, right = weights(vectors.shape[1]), weights(centroids.shape[1])
    out = np.zeros((len(vectors), len(centroids)), np.int64)
    for k, planes in enumerate(centroids):
        for q in np.flatnonzero(planes):
            out[:, k] += right[q] * (np.bitwise_count(vectors & planes[q]).astype(np.int64) @ left)
    return out


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of every vector to every centroid, both as planes."""

    def norms(planes: np.ndarray) -> np.ndarray:
        value, out = weights(planes.shape[1]), np.zeros(len(planes), np.int64)
        for p in range(planes.shape[1]):
            out += value[p] * (np.bitwise_count(planes & planes[:, p : p + 1]).astype(np.int64) @ value)
        return out

    return norms(vectors)[:, None] + norms(centroids)[None, :] - 2 * dots(vectors, centroids)


def plane_sums(vectors: np.ndarray) -> np.ndarray:
    """Component sums of vectors given as planes."""
    out = np.zeros(WIDTH, np.int64)
    for p, value in enumerate(weights(vectors.shape[1])):
        words = np.ascontiguousarray(vectors[:, p]).astype("<u8").view(np.uint8).reshape(-1, 8)
        out += value * np.unpackbits(words, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def _read(blobs: pd.Series) -> np.ndarray:
    """Planes of a batch; rows with fewer planes repeat their top one, the sign."""
    rows = [np.frombuffer(b, "<u8") for b in blobs]
    out = np.empty((len(rows), max(map(len, rows))), np.uint64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
        out[i, len(row) :] = row[-1]
    return out


def plane_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, planes of the rows that take part: ``WIDTH`` components, none null or non-finite, each scaled and
    floored. Rows with a scaled component of 2 ** 27 or more have no distance in a long and take no part either."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.array([np.nan if x is None else x for x in v], np.float64) for v in batch.embedding]
            values = np.floor(scale * np.stack(found)) if found else np.zeros((0, WIDTH))
            with np.errstate(invalid="ignore"):
                whole = np.isfinite(values).all(axis=1) & (np.abs(values) < 2**LIMIT).all(axis=1)
            planes = to_planes(values[whole].astype(np.int64))
            yield pd.DataFrame({"vec_id": batch.vec_id[whole], "planes": [row.tobytes() for row in planes]})

    # ids pass through pandas as text: whole numbers next to nulls would become doubles there
    rows = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.size("embedding") == WIDTH).mapInPandas(pack, "vec_id string, planes binary")


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """Components of the ``k`` rows of smallest sha256 of seed and id; equal ids by their planes, rows without id last."""
    spot = F.sha2(F.concat(F.lit(f"{seed}:"), "vec_id"), 256)
    heads = rows.select("planes", spot.alias("spot")).orderBy(F.asc_nulls_last("spot"), "planes").limit(k).collect()
    return np.array([plane_sums(np.frombuffer(r.planes, "<u8")[None, :]) for r in heads], np.int64).reshape(-1, WIDTH)


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 per row of ``vectors`` (vec_id, embedding) that
    takes part, after ``rounds`` rounds of k-means from ``k`` rows drawn by hash.

    A vector belongs to the nearest centroid, ties to the smaller number. A centroid becomes the floor of its vectors' mean;
    one without vectors stays. Rows without vector, of another length, with null or non-finite components (or beyond
    2 ** 27 when scaled) take no part. Rows without id are clustered, but start no centroid unless rows with id are
    lacking. Repeated rows count as often as they occur and may start equal centroids. Fewer rows than ``k`` give
    fewer centroids; no rows give no rows. Extra columns are ignored."""
    rows = stored(plane_vectors(vectors, scale))
    spark = rows.sparkSession
    centroids = first_centroids(rows, k, seed)

    for _ in range(rounds if len(centroids) else 0):
        planes = to_planes(centroids)

        def sums(batches: Iterator[pd.DataFrame], planes: np.ndarray = planes) -> Iterator[pd.DataFrame]:
            total, count = np.zeros((len(planes), WIDTH), np.int64), np.zeros(len(planes), np.int64)
            for batch in batches:
                if len(batch):
                    found = _read(batch.planes)
                    nearest = distances(found, planes).argmin(axis=1)
                    for c in np.unique(nearest):
                        total[c] += plane_sums(found[nearest == c])
                        count[c] += (nearest == c).sum()
            yield pd.DataFrame({"cluster": np.arange(len(planes)), "n": count, "sums": list(total)})

        part = rows.select("planes").mapInPandas(sums, "cluster int, n long, sums array<long>").where("n > 0")
        added = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(WIDTH)])
        centroids = centroids.copy()
        for row in added.collect():  # one row per centroid
            centroids[row.cluster] = np.array([row[f"s{i}"] for i in range(WIDTH)], np.int64) // row.n

    last = to_planes(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = distances(_read(batch.planes), last)
                yield pd.DataFrame({"vec_id": batch.vec_id, "cluster": far.argmin(axis=1), "distance": far.min(axis=1)})

    assigned = stored(rows.mapInPandas(assign, "vec_id string, cluster int, distance long"))
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    named = spark.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string")
    totals = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(F.broadcast(named), "cluster")
    inertia = assigned.agg(F.sum("distance")).first()[0]
    # one row per centroid
    result = assigned.join(F.broadcast(totals), "cluster").withColumn("inertia", F.lit(inertia).cast("long"))
    return result.select(F.col("vec_id").cast("long").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
