"""Whitening of integer vectors: projections on the principal components, each of variance 1.

The entries become integers x, whose sums per dimension are exact. A centred row (n * x - S) / n is rounded
once, so MLlib's singular values of the distributed centred rows are those of the covariance to double precision:
e = sigma ** 2 / n, the right singular vectors are the components. The total variance is not taken from the
decomposition: it is the sum of the rows' exact squared deviations over n ** 3. Projections are NumPy products of a
batch's centred rows with dim x k numbers; their covariance is a Spark aggregate over pairs of components.

To the driver come the sums (dim numbers), the components (dim x k) and the covariances (k x k). With the rounded mean m
and the rest R = S - n * m, a row's deviation is n^2 sum y^2 - 2 n sum y R + sum R^2 for y = x - m: sums of longs, put
together as decimals.

Defined results: rows whose vector is null, empty or holds null, infinite or undefined entries are left out, as
are those of another length than most have (of equally common lengths, than the greatest); repeated rows count as
often as they stand; components whose variance is below 1e-10 of the first one's, which rounding hides, are not returned,
so that a single row or equal rows give an empty result, as does an empty table; entries beyond 2**17 in magnitude are
an error, as is a deviation beyond a long. Of other columns only the id is kept, so that none can clash.
"""

from __future__ import annotations


import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facelake.llm.centroids import finite
from facelake.llm.common import stored

WIDE = "decimal(38,0)"
#: Entries up to this magnitude keep all sums of a row in 64 bits.
LARGEST = 1 << 17
#: A component has at least this share of the first one's variance.
LEAST = 1e-10


def integer_rows(vectors: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that are kept, x = floor(scale * entry) + shift, written to the shared folder."""
    vector = F.col(f"`{vector_col}`")
    kept = vectors.where((F.size(vector) > 0) & finite(vector)).select(F.col(f"`{id_col}`").alias("id"), vector.alias("v"))
    common = kept.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()

    def whole(entry: Column) -> Column:
        error = F.raise_error(F.lit("an entry does not fit the integers of the whitening")).cast("long")
        return F.when(F.abs(entry) <= LARGEST, F.floor(entry.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("long")).otherwise(error)

    rows = kept.where(F.size("v") == (common.dim if common else 0)).select("id", F.transform("v", whole).alias("x"))
    return stored(rows, "integer-vectors")


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension, exactly."""
    found = rows.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(F.count("*").alias("n"), F.sum(F.col("v")).alias("total"))
    by_place = {r.place: (r.n, r.total) for r in found.collect()}  # a row for each dimension
    return (by_place[0][0] if by_place else 0), [by_place[i][1] for i in range(len(by_place))]


def literal(values: list[int], kind: str = "long") -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def centred(rows: DataFrame, n: int, totals: list[int]) -> DataFrame:
    """(id, deviation, c): each row's exact squared deviation, as a decimal, and its centred entries."""
    mean = [(2 * s + n) // (2 * n) for s in totals]
    rest = [s - n * m for s, m in zip(totals, mean, strict=True)]
    y = F.zip_with("x", literal(mean), lambda x, m: x - m)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b).cast(WIDE)

    exact = rows.select("id", y.alias("y"))
    square, product = total(F.transform("y", lambda v: v * v)), total(F.zip_with("y", literal(rest), lambda v, r: v * r))
    n_wide = F.lit(n).cast("decimal(18,0)")
    deviation = (n_wide * (n_wide * square).cast(WIDE)).cast(WIDE) - (F.lit(2 * n).cast("decimal(18,0)") * product).cast(WIDE) + F.lit(str(sum(r * r for r in rest))).cast(WIDE)
    c = F.zip_with("y", literal(rest), lambda v, r: (v * F.lit(n).cast("long") - r).cast("double") / F.lit(float(n)))
    return exact.select("id", deviation.cast(WIDE).alias("deviation"), c.alias("c"))


def components(rows: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances, falling, and unit components (in columns) of the centred rows (.., c)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("c").alias("v")), "v")
    found = RowMatrix(vectors, n).computeSVD(k)
    sigma, v = found.s.toArray(), found.V.toArray()
    sure = sigma**2 > LEAST * sigma[0] ** 2
    return sigma[sure] ** 2 / n, v[:, sure] / np.linalg.norm(v[:, sure], axis=0)


def project(rows: DataFrame, variances: np.ndarray, v: np.ndarray) -> DataFrame:
    """(id, deviation, w) of the centred rows: w has one value of variance 1 for each component."""
    matrix = v / np.sqrt(variances)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                w = np.stack(batch.column(2).to_pandas().to_numpy()) @ matrix
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(w))], names=["id", "deviation", "w"])

    return rows.select("id", "deviation", "c").mapInArrow(run, f"id {kinds['id']}, deviation {WIDE}, w array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of w minus the identity."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get("w", F.lit(i)).alias("a"), F.get("w", F.lit(j)).alias("b")) for i in range(k) for j in range(i, k)
    ]))
    found = rows.select(pairs.alias("p")).select("p.*").groupBy("i", "j").agg(F.covar_pop("a", "b").alias("c"))
    return max(abs(r.c - (r.i == r.j)) for r in found.collect())  # k x k rows


def whiten(
    vectors: DataFrame, k: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each kept row and component, from 1.

    explained: the component's share of the total variance.
    """
    rows = integer_rows(vectors, scale, shift, id_col, vector_col)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, totals = sums(rows)
    nothing = rows.sparkSession.createDataFrame([], schema)
    if not n:
        return nothing
    moved = stored(centred(rows, n, totals), "centred")
    spread = int(moved.agg(F.sum("deviation")).first()[0])
    if not spread:
        return nothing
    variances, v = components(moved, n, min(k, len(totals)))
    white = stored(project(moved, variances, v), "whitened")
    error = identity_error(white, len(variances))
    # the exact total over n ** 3 as a double, divided once
    trace = spread / n**3
    shares = F.array(*[F.lit(float(e / trace)) for e in variances])
    listed = white.select("id", "deviation", F.posexplode("w").alias("place", "whitened"))
    return listed.select(
        "id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened",
        F.get(shares, F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
