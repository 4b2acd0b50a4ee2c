"""Exact cosine search over a collection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facelake.functions import vectors

FIELDS = ("person_id", "image_path", "created_at")
#: Bytes of the vectors of a tile's either side, held as they come; a task holds them as doubles as well.
TILE_BYTES = 16 << 20


def search(collection: DataFrame, query: Sequence[float], k: int = 5, fields: Sequence[str] = FIELDS, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The k rows most similar to query: key, distance (the similarity), fields. Equal ones by key.

    One scan and a top-k per task; zero vectors have no similarity and come last.
    """
    scored = collection.select(key, vectors.cosine_to(F.col(vector), query).alias("distance"), *[f for f in fields if f != key])
    return scored.orderBy(F.desc_nulls_last("distance"), key).limit(k)


def similarities(rows, matrix: np.ndarray) -> np.ndarray:
    """Cosines of an Arrow list array's vectors (columns) to unit vectors (rows); not a number without one."""
    whole, x = vectors_of(rows, matrix.shape[1])
    out = np.full((len(matrix), len(whole)), np.nan)
    length = np.linalg.norm(x, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        out[:, whole] = np.where(length > 0, np.clip((matrix @ x.T) / length, -1, 1), np.nan)
    return out


def vectors_of(rows, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of an Arrow list array's vectors have this length, and those as doubles, null entries as not a number."""
    whole = rows.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim
    values = rows.filter(whole).flatten().to_numpy(zero_copy_only=False)
    return whole, np.asarray(values, np.float64).reshape(int(whole.sum()), dim)


#: Similarities that a task holds at once.
SCORES = 1 << 21


def best_of(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest values of each row, the earlier of equal ones; undefined ones come last."""
    low = -np.nan_to_num(s, nan=-2.0)
    k = min(k, s.shape[1])
    bound = np.partition(low, k - 1, axis=1)[:, k - 1]
    row, column = np.nonzero(low <= bound[:, None])
    order = np.lexsort((column, low[row, column], row))
    row, column = row[order], column[order]
    start = np.searchsorted(row, np.arange(len(s)))
    kept = np.arange(len(row)) - start[row] < k
    return row[kept], column[kept]


def tile_top(k: int, query_key: str, key: str):
    """A function of a tile's queries (place, query_key, vector) and rows (key, vector): the k best rows of each query.

    Queries of each length are multiplied with the tile's rows at once; equal similarities by key.
    """

    def top(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        left, right = left.combine_chunks(), right.combine_chunks()
        schema = pa.schema([left.schema.field("place"), left.schema.field(query_key), right.schema.field(key), pa.field("distance", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.take(pc.sort_indices(right, [(key, "ascending")]))  # of equal similarities the first in this order stays
        asked, held = left.column("vector").combine_chunks(), right.column("vector").combine_chunks()
        lengths = asked.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        queries, rows, scores = [], [], []
        for dim in np.unique(lengths):
            of_length = np.flatnonzero(lengths == dim)
            step = max(1, SCORES // len(held))
            for first in range(0, len(of_length), step):
                own = of_length[first : first + step]
                m = vectors_of(asked.take(pa.array(own)), dim)[1] if dim > 0 else np.full((len(own), 1), np.nan)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = similarities(held, np.where(norm > 0, m / norm, np.nan))
                query, row = best_of(s, k)
                queries.append(own[query])
                rows.append(row)
                scores.append(s[query, row])
        of, at = pa.array(np.concatenate(queries)), pa.array(np.concatenate(rows))
        distance = pa.array(np.concatenate(scores), pa.float64(), from_pandas=True)
        return pa.table([left.column("place").take(of), left.column(query_key).take(of), right.column(key).take(at), distance], schema=schema)

    return top


def dealt(rows: DataFrame, vector: str, tile_bytes: int) -> tuple[Column, int]:
    """A part for each row, so that parts are of about tile_bytes of vectors, and the number of parts."""
    first = rows.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    parts = max(1, -(-rows.count() * 4 * max(first[0] if first else 1, 1) // tile_bytes))
    # a row's place and not its key, which many rows could share
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"), parts


def search_many(
    collection: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "id", query_key: str = "query_id", tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """(query_key, key, distance, rank): the k nearest rows of each row of queries (query_key, vector).

    Both tables are dealt into parts of about tile_bytes of vectors, and each pair of parts, a tile, meets in one task,
    which returns the k best rows of each of its queries; those of a query's tiles are merged by a ranking that Spark cuts
    to k before it moves them. No vector passes the driver, and what moves grows as queries times parts of the
    collection and rows times parts of the queries. Vectors that are null, zero or of another length than the query have no
    similarity and come last, equal ones by key; rows without a key are left out; repeated queries are answered each.
    """
    held = collection.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`"), F.col(f"`{vector}`").alias("vector"))
    asked = queries.select(F.monotonically_increasing_id().alias("place"), F.col(f"`{query_key}`"), F.col(f"`{vector}`").alias("vector"))
    row_part, row_parts = dealt(held, "vector", tile_bytes)
    query_part, query_parts = dealt(asked, "vector", tile_bytes)
    left = asked.withColumn("query_part", query_part).withColumn("row_part", F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1))))
    right = held.withColumn("row_part", row_part).withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    types = {**dict(collection.dtypes), "place": "bigint"}
    schema = f"place bigint, `{query_key}` {dict(queries.dtypes)[query_key]}, `{key}` {types[key]}, distance double"
    tile = ("query_part", "row_part")
    best = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(tile_top(k, query_key, key), schema)
    order = Window.partitionBy("place").orderBy(F.desc_nulls_last("distance"), F.col(f"`{key}`"))
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).drop("place")
