"""Many-query search against loops: several tiles, ties, repeated queries and rows, vectors of other lengths."""

import numpy as np
import pytest

from facelake.operators.search import best_of, search_many

RNG = np.random.default_rng(4)


def plain(rows, queries, k):
    out = []
    for q, v in queries:
        scored = []
        for i, x in rows:
            if i is None:
                continue
            s = None
            if v is not None and x is not None and len(v) == len(x) and None not in v and None not in x and any(v) and any(x):
                a, b = np.array(v, float), np.array(x, float)
                s = float(np.clip(a @ b / np.linalg.norm(a) / np.linalg.norm(b), -1, 1))
            scored.append((s is None, -(s or 0), i, s))
        out += [(q, i, None if s is None else round(s, 5), n + 1) for n, (_, _, i, s) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(found, key):
    return sorted(((r.query_id, r[key], None if r.distance is None else round(r.distance, 5), r["rank"]) for r in found.collect()), key=str)


@pytest.mark.parametrize("tile_bytes", [100, 1000, 1 << 20])
def test_tiles(spark, tile_bytes):
    vectors = RNG.integers(-2, 3, (60, 3)).astype(float).tolist()  # many equal directions, some zero vectors
    rows = [(i % 50, v) for i, v in enumerate(vectors)] + [(100, None), (101, [1.0]), (102, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0])]
    queries = [(i, v) for i, v in enumerate(vectors[:20])] + [(3, [1.0, 0.0, 0.0]), (50, None), (51, [1.0, 2.0]), (52, [])]
    data = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>").repartition(2)
    assert got(search_many(data, asked, 4, tile_bytes=tile_bytes), "id") == plain(rows, queries, 4)


def test_other_keys(spark):
    rows = [(f"k{i}", RNG.normal(size=5).tolist()) for i in range(30)]
    queries = [("q" * (i + 1), rows[i][1]) for i in range(5)]
    data = spark.createDataFrame(rows, "file string, vector array<double>")
    found = search_many(data, spark.createDataFrame(queries, "query_id string, vector array<double>"), 3, vector="vector", key="file", tile_bytes=300)
    assert got(found, "file") == plain(rows, queries, 3) and found.columns == ["query_id", "file", "distance", "rank"]
    assert search_many(data, spark.createDataFrame([], "query_id string, vector array<double>"), 3, vector="vector", key="file").count() == 0
    assert search_many(data.where("false"), spark.createDataFrame(queries, "query_id string, vector array<double>"), 3, vector="vector", key="file").count() == 0


def test_best_of():
    s = np.array([[0.5, 0.5, np.nan, 0.9], [np.nan] * 4, [0.1, 0.2, 0.2, 0.2]])
    row, column = best_of(s, 2)
    assert row.tolist() == [0, 0, 1, 1, 2, 2] and column.tolist() == [3, 0, 0, 1, 1, 2]
    assert [len(x) for x in best_of(s, 10)] == [12, 12]
