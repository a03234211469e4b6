"""Centroid clustering in exact integers, with distances by matrix products.

Components become integers floor(scale * x). |x|² - 2 x·c + |c|² then comes from BLAS in float64, which is exact as long as no
partial sum reaches 2^53, whatever the order of its terms. That holds while all components of vectors and centroids are within a bound
that follows from their number (2^22 for 64). Vectors or centroids beyond it are computed by integers instead, of 64 bits
while these suffice and of any length else, with the same ties, so results never depend on which way was taken.

Vectors are laid out once as a table of blocks. A round sends the centroids to the tasks and brings back by treeAggregate
one sum and count for each centroid: neither what is sent nor what comes back grows with the number of vectors. Sums are
integers of any length, so their order doesn't matter.

Defined cases: vectors that are null, of another length, or with a component that is null or not finite, give no row; with
fewer vectors than clusters there are as many clusters as vectors; equal vectors may start several centroids, of which the
first gets all; a null id comes last in the choice of first centroids, and rows that repeat an id are ordered by
their vectors there; distances and their sums beyond 64 bits are null; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import id_type, map_batches, ship, stored

#: Rows of a block; a matrix of so many rows by the clusters is what a task computes at once.
BLOCK_ROWS = 1024
EXACT, LONG = 1 << 53, (1 << 63) - 1


def bound(dim: int, limit: int = EXACT) -> int:
    """Components up to this, of vectors and centroids, keep all terms and partial sums of a distance below the limit."""
    return math.isqrt(limit // max(dim, 1)) // 2 - 1


def _scaled(x: float, scale: int) -> int:
    """floor(scale * x), also where the product would leave float64 or be rounded."""
    n, d = x.as_integer_ratio()
    return n * scale // d


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of a float64 matrix: as float64 where that is exact, else as Python integers. scale is a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    return y if np.abs(y).max(initial=0) < EXACT else np.array([[_scaled(v, scale) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c, both integers in float64 or object matrices; int64, or object where these don't suffice."""
    dim, most = x.shape[1], [np.abs(m).max(axis=1, initial=0) for m in (x, c)]
    if all((m <= bound(dim)).all() for m in most):
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    small, few = (m <= bound(dim) for m in most)
    longs = all((m <= bound(dim, LONG)).all() for m in most)
    out = np.zeros((len(x), len(c)), dtype=np.int64 if longs else object)
    if small.any() and few.any():
        out[np.ix_(small, few)] = distances(x[small], c[few])
    kind = np.int64 if longs else object
    to_kind = lambda m: m.astype(np.int64) if longs else np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    xs, cs = to_kind(x), to_kind(c)
    for j in range(len(c)):  # one centroid at a time, to hold one matrix of differences
        rows = ~small if few[j] else np.ones(len(x), dtype=bool)
        if rows.any():
            d = xs[rows] - cs[j]
            out[rows, j] = (d * d).sum(axis=1, dtype=kind)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; the smaller number where several are as near."""
    d = distances(x, c)
    at = np.argmin(d, axis=1) if len(d) else np.zeros(0, dtype=np.int64)
    return at, d[np.arange(len(d)), at]


def sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Sum of the rows of x of each cluster, as Python integers."""
    if x.dtype != object and len(x) * np.abs(x).max(initial=0) < EXACT:
        return ((at[None, :] == np.arange(k)[:, None]).astype(np.float64) @ x).astype(np.int64).astype(object)
    out = np.zeros((k, x.shape[1]), dtype=object)
    for row, j in zip(x.tolist(), at.tolist(), strict=True):
        out[j] += np.array([int(v) for v in row], dtype=object)
    return out


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(-1, dim)


def _blocks(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[k : k + BLOCK_ROWS]
                x = np.array(part["vector"].tolist(), dtype=np.float64).reshape(-1, dim)
                yield pd.DataFrame({"ids": [part["id"].tolist()], "x": [x.tobytes()]})

    return run


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, all of them numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, number), F.lit(False))


def cluster(vectors: DataFrame, k: int, rounds: int, seed: int, dim: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(table of id, cluster, distance, cluster_inertia, inertia; centroids) after `rounds` of assigning and moving, assigned once more."""
    spark, kind = vectors.sparkSession, id_type(vectors, id_col)
    kept = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(usable(F.col("vector"), dim))
    starts = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")).cast("binary"), 256).asc_nulls_last(), "vector").limit(k).select("vector").collect()
    if not starts:
        return kept.select(F.col("id").cast(kind).alias(id_col), *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long")))), np.zeros((0, dim))
    centroids = integers(np.array([r["vector"] for r in starts], dtype=np.float64).reshape(-1, dim), scale)
    laid = stored(map_batches(kept, _blocks(dim), "ids array<string>, x binary"), "vector-blocks")
    data = laid.select("x").rdd.map(lambda r: bytes(r[0]))
    ship(spark)

    def folded(centroids: np.ndarray):
        n = len(centroids)

        def add(had, block: bytes):
            x = integers(_matrix(block, dim), scale)
            at, d = nearest(x, centroids)
            within = np.zeros(n, dtype=object)
            for j in range(n):
                within[j] = sum(d[at == j].tolist())
            return merge(had, (sums(x, at, n), np.bincount(at, minlength=n).astype(object), within))

        def merge(a, b):
            return b if a is None else a if b is None else tuple(p + q for p, q in zip(a, b, strict=True))

        return data.treeAggregate(None, add, merge)

    for _ in range(rounds):
        total, count, _ = folded(centroids)
        moved = [[s // n for s in row] if n else [int(v) for v in old] for row, n, old in zip(total.tolist(), count.tolist(), centroids.tolist(), strict=True)]
        centroids = np.array(moved, dtype=object).reshape(-1, dim)
        if np.abs(centroids).max() < EXACT:
            centroids = centroids.astype(np.float64)
    within = [int(v) for v in folded(centroids)[2].tolist()]
    long = lambda n: n if n <= LONG else None

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, block in zip(batch["ids"], batch["x"], strict=True):
                at, d = nearest(integers(_matrix(block, dim), scale), centroids)
                yield pd.DataFrame({"id": ids, "cluster": at.astype(np.int32), "distance": pd.array([long(v) for v in d.tolist()], dtype="Int64"),
                                    "cluster_inertia": pd.array([long(within[j]) for j in at.tolist()], dtype="Int64"), "inertia": pd.array([long(sum(within))] * len(at), dtype="Int64")})

    rows = map_batches(laid, assigned, "id string, cluster int, distance long, cluster_inertia long, inertia long")
    return rows.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col), centroids


def centroid_digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in centroids.tolist()]
