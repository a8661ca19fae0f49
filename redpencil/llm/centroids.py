"""Centroid clustering of integer vectors; the nearest centroid is found by the threshold algorithm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.common import stored

BLOCK = 512  # vectors that walk their lists together
LIMIT = 2**27  # components beyond this could overflow a squared distance of 64 components
_FAR = np.int64(2**31)  # stands for the end of a list; its square still fits


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row of ``x`` (ties: the smaller number).

    Each dimension has a list of the centroids by value. A vector enters every list at its own
    value and walks outward, one entry a list and round; a centroid met for the first time gets
    its exact distance. A centroid not met yet is in no dimension nearer than the frontier of that
    list, so the vector stops when the frontier's squared distances sum to more than its best one.
    """
    k, dims = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    column = np.arange(dims)
    best = np.full(len(x), np.iinfo(np.int64).max)
    number = np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        v = x[at:at + BLOCK]
        right = np.stack([np.searchsorted(values[:, d], v[:, d]) for d in range(dims)], axis=1)
        left = right - 1
        seen = np.zeros((len(v), k), bool)
        walking = np.arange(len(v))
        for _ in range(k):
            w, lo, hi = v[walking], left[walking], right[walking]
            down = np.where(lo >= 0, w - values[np.maximum(lo, 0), column], _FAR)
            up = np.where(hi < k, values[np.minimum(hi, k - 1), column] - w, _FAR)
            take_left = down <= up
            met = order[np.where(take_left, lo, np.minimum(hi, k - 1)), column]
            left[walking], right[walking] = lo - take_left, hi + ~take_left
            fresh = np.zeros((len(walking), k), bool)
            fresh[np.arange(len(walking))[:, None], met] = True
            fresh &= ~seen[walking]
            seen[walking] |= fresh
            row, c = np.nonzero(fresh)
            found = np.full((len(walking), k), np.iinfo(np.int64).max)
            found[row, c] = ((w[row] - centroids[c]) ** 2).sum(1)
            c = found.argmin(1)
            near = found[np.arange(len(walking)), c]
            place = at + walking
            closer = (near < best[place]) | ((near == best[place]) & (c < number[place]))
            best[place[closer]], number[place[closer]] = near[closer], c[closer]
            frontier = np.minimum(down, up)
            # a vector that has met every centroid has none left to look for
            walking = walking[((frontier * frontier).sum(1) <= best[place]) & ~seen[walking].all(1)]
            if not len(walking):
                break
    return number, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def whole_vectors(df: DataFrame, dims: int, scale: int = 256, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector has ``dims`` finite components, with ``__v``: floor(scale * component) as long."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & (F.size(v) == dims) & finite).withColumn(
        "__v", F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def first_centroids(vectors: DataFrame, k: int, key: Column) -> np.ndarray:
    """The vectors with the ``k`` smallest keys, in that order; rows of one key by their components."""
    rows = vectors.select(key.alias("key"), "__v").orderBy("key", "__v").limit(k).collect()
    return np.array([r["__v"] for r in rows], np.int64)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each non-empty centroid becomes the floored mean of its vectors, exactly."""
    k, dims = centroids.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dims)
                c, _ = nearest(x, centroids)
                n += np.bincount(c, minlength=k)
                np.add.at(total, c, x)
        for c in np.flatnonzero(n).tolist():
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array([c] * dims, pa.int32()), "dim": pa.array(range(dims), pa.int32()),
                "n": pa.array([int(n[c])] * dims, pa.int64()), "total": pa.array(total[c], pa.int64())})

    sums = vectors.select("__v").mapInArrow(totals, "cluster int, dim int, n long, total long")
    moved = centroids.copy()
    # k x dims rows, whatever the table's size
    for r in sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        moved[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return moved


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster and squared distance of each row of :func:`whole_vectors`; ``__v`` goes."""
    dims = centroids.shape[1]
    others = [f for f in vectors.schema if f.name not in ("__v", "cluster", "distance")]
    schema = T.StructType([*others, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c, d = nearest(_matrix(batch.column(batch.num_columns - 1), dims), centroids)
                columns = [*batch.columns[:-1], pa.array(c, pa.int32()), pa.array(d, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return vectors.select(*[F.col(f"`{f.name}`") for f in others], "__v").mapInArrow(place, schema)


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Cluster the whole vectors of a table around ``k`` centroids in ``rounds`` rounds.

    Returns id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256. Centroids
    start as the vectors with the smallest SHA-256 of ``seed:id``. Each round is one pass over the
    quantised vectors; a task sends k x dims sums at most, and only those reach the driver.

    Defined cases: null vectors, vectors of another length and those with a null or non-finite
    component give no row; a null id hashes as an empty one and its row stays; rows that repeat an
    id are rows of their own; fewer than ``k`` vectors make fewer centroids; of equally near
    centroids the smaller number wins; an empty table gives no rows; a component of 2^27 or
    more after scaling stops the job, for its squares could overflow; other columns are not read.
    """
    spark = df.sparkSession
    narrow = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    vectors = stored(whole_vectors(narrow, dims, scale, "vec").select("id", "__v"), "vectors")
    widest = vectors.agg(F.max(F.array_max(F.transform("__v", F.abs)))).first()[0]
    if widest is not None and widest >= LIMIT:
        raise ValueError(f"a component of {widest} after scaling; {LIMIT} is the limit")
    out = (f"`{id_col}` {narrow.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, "
           "inertia long, centroid_sha256 string")
    if widest is None:
        return spark.createDataFrame([], out)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = first_centroids(vectors, k, key)
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)
    rows = stored(assigned(vectors, centroids), "assigned")
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
             for c, s in sums.items()]
    clusters = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(clusters), "cluster").select(  # k rows at most
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
