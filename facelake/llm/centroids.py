"""Plain Lloyd clustering of integer vectors, exact to the last unit.

A vector's components are scaled and rounded down once and stored as integers. A round sends the centroids to the
tasks (k x dim numbers), where a batch's squared differences from each centroid are summed in NumPy and the first
least one wins. A task returns one row for each centroid and component, whatever it has read; these are summed by
Spark, and k x dim totals come to the driver. Totals are decimals, so that they hold at any number of rows.

Defined results: rows whose vector is null, of another length, or holds null, infinite or undefined entries are left
out; repeated rows and repeated ids count as often as they stand; rows without id take part like any other, but start
a centroid only after all others; equally near centroids give the smaller number; with fewer rows than k each row
starts a centroid; an empty table gives an empty result. Integers beyond 2**62, and distances or inertias beyond
a long, are an error. Of other columns only the id is kept, so that none can clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facelake.llm.common import stored

#: Up to this magnitude of all components, differences of 2**12 components can be squared and summed in 64 bits.
NARROW = 1 << 24
WIDEST = 1 << 62
TOTAL = "decimal(38,0)"


def finite(vector: Column) -> Column:
    """Whether a vector is there and has no null, infinite or undefined entry."""
    bound = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < bound)), F.lit(False))


def integer_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that are kept: x is floor(scale * entry) of each entry, taken as a double."""
    vector = F.col(f"`{vector_col}`")
    wide = F.raise_error(F.lit("a component does not fit the integers of the clustering")).cast("long")

    def scaled(entry):
        y = F.floor(entry.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(entry.cast("double")) < F.lit(WIDEST / scale), y).otherwise(wide)

    kept = vectors.where((F.size(vector) == dim) & finite(vector))
    return kept.select(F.col(f"`{id_col}`").alias("id"), F.transform(vector, scaled).alias("x"))


def starting_rows(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors of the k rows of (id, x) with the least sha256 of seed:id, in that order; equal ones by vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), "x").limit(k)
    return [list(r.x) for r in first.collect()]


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances, a row for each vector and a column for each centroid: int64, or Python's integers where
    64 bits might not hold them."""
    largest = max((abs(v) for c in centroids for v in c), default=0)
    narrow = not x.size or (largest < NARROW and np.abs(x).max() < NARROW and x.shape[1] <= 4096)
    kind = np.int64 if narrow else object
    x = x.astype(kind)
    out = np.empty((len(x), len(centroids)), kind)
    for j, centroid in enumerate(centroids):
        apart = x - np.array(centroid, kind)
        out[:, j] = (apart * apart).sum(axis=1)
    return out


def matrix(column, dim: int) -> np.ndarray:
    """The vectors of a pandas column of arrays."""
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, dim), np.int64)


def totals(rows: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """By centroid with rows: their number and the sum of each of their components."""
    k, dim = len(centroids), len(centroids[0])
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def fold(batches):
        import pandas as pd

        count, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            x = matrix(batch["x"], dim)
            nearest = distances(x, sent.value).argmin(axis=1)
            for j in np.unique(nearest):
                own = x[nearest == j]
                count[j] += len(own)
                # a batch's sums hold in 64 bits unless its values are wide; Python's integers add up the batches
                total[j] += own.sum(axis=0).astype(object) if np.abs(own).max() < WIDEST // len(own) else own.astype(object).sum(axis=0)
        used = np.flatnonzero(count)
        yield pd.DataFrame({
            "cluster": np.repeat(used, dim).astype(np.int32), "place": np.tile(np.arange(dim, dtype=np.int32), len(used)),
            "n": np.repeat(count[used], dim), "total": [str(v) for j in used for v in total[j]],
        })

    parts = rows.select("x").mapInPandas(fold, "cluster int, place int, n long, total string")
    summed = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast(TOTAL)).alias("total"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in summed.orderBy("cluster", "place").collect():  # k x dim rows at most
        found.setdefault(r.cluster, (r.n, []))[1].append(int(r.total))
    sent.unpersist()
    return found


def fit(rows: DataFrame, k: int, rounds: int, seed: str) -> list[list[int]]:
    """The centroids of (id, x) after some rounds; those without vectors stay where they are."""
    centroids = starting_rows(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        moved = totals(rows, centroids)
        after = [[t // moved[j][0] for t in moved[j][1]] if j in moved else c for j, c in enumerate(centroids)]
        if after == centroids:  # every further round would give the same
            break
        centroids = after
    return centroids


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of each row of (id, x)."""
    id_type = rows.schema["id"].dataType.simpleString()

    def nearest(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            apart = distances(matrix(batch.column(1).to_pandas(), len(centroids[0])), centroids)
            best = apart.argmin(axis=1)
            least = apart[np.arange(len(best)), best]
            if max(least) > np.iinfo(np.int64).max:
                raise OverflowError("a squared distance does not fit a long")
            yield pa.record_batch([batch.column(0), pa.array(best, pa.int32()), pa.array(least.astype(np.int64))], names=["id", "cluster", "distance"])

    # Arrow, as pandas has no long ids beside nulls
    return rows.mapInArrow(nearest, f"id {id_type}, cluster int, distance long")


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row.

    centroid_sha256: lowercase hex digest of the cluster's final centroid, decimal components joined by commas.
    """
    if k < 1 or dim < 1:
        raise ValueError("k and dim must be positive")
    rows = stored(integer_vectors(vectors, dim, scale, id_col, vector_col), "integer-vectors")
    centroids = fit(rows, k, rounds, seed)
    found = stored(assign(rows, centroids), "assigned")
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast(TOTAL)).alias("total")).collect()}  # k rows at most
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(j, inertia.get(j, 0), h) for j, h in enumerate(hashes)]
    if sum(inertia.values()) > np.iinfo(np.int64).max:
        raise OverflowError("the inertia does not fit a long")

    def fact(place: int, kind: str):
        """A cluster's fact, from an array of k of them."""
        values = F.array(*[F.lit(f[place]).cast(kind) for f in facts]) if facts else F.array().cast(f"array<{kind}>")
        return F.get(values, F.col("cluster"))

    return found.select(
        "id", "cluster", "distance", fact(1, "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), fact(2, "string").alias("centroid_sha256")
    )
