"""Lloyd rounds against a plain version in Python's integers."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from facelake.llm import centroids, queries

SF = "/root/testdata/sf0.001"


def plain(rows, k=8, rounds=10, dim=64, scale=1024, seed="3"):
    kept = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    ordered = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [x for _, x in ordered[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in set(own):
            members = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            centres[j] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [(i, *nearest(x)) for i, x in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(queries.op11_centroids(spark, sf)) == plain(rows)


ODD = [
    (1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-0.5, 0.1]), (4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [1.0, float("nan")]),
    (9, [float("-inf"), 0.0]), (None, [0.3, 0.3]), (None, None), (10, [-0.0001, 0.0001]), (11, [1.0, 2.0, 3.0]), ((1 << 60) + 1, [0.5, 0.5]),
]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_odd_rows(spark, k):
    frame = spark.createDataFrame(ODD, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "x", "cluster", "distance")})
    assert got(centroids.cluster(frame, k=k, dim=2)) == plain([(i, x and [None if v is None else float(v) for v in x]) for i, x in as_floats(ODD)], k=k, dim=2)


def as_floats(rows):
    """What 32-bit columns hold."""
    import numpy as np

    return [(i, x and [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows]


def test_wide_values(spark):
    """Differences whose squares do not fit 64 bits on the way."""
    rows = [(i, [float(1 << 40) + i, float(-(1 << 40)) + i * i]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(centroids.cluster(frame, k=4, dim=2)) == plain(rows, k=4, dim=2)
    beyond = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit the integers"):
        centroids.cluster(beyond, k=1, dim=2)


def test_empty(spark):
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert centroids.cluster(nothing).collect() == []
    assert centroids.cluster(spark.createDataFrame(ODD, "vec_id long, embedding array<float>")).collect() == []
