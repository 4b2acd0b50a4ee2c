"""Vector and face expressions against numpy, and properties of the search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facelake.functions import images, vectors
from facelake.operators import faces
from facelake.operators.search import search, search_many

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def collection(spark):
    data = [(i, [float(x) for x in RNG.standard_normal(16)]) for i in range(60)]
    data += [(60, [0.0] * 16), (61, data[3][1]), (62, [2 * x for x in data[3][1]])]
    return spark.createDataFrame(data, "id long, embedding array<float>"), dict(data)


def expected(vecs, q, k):
    q = np.array(q, np.float32).astype(float)
    score = {}
    for i, v in vecs.items():
        v = np.array(v, np.float32).astype(float)
        n = np.linalg.norm(v) * np.linalg.norm(q)
        score[i] = np.clip(v @ q / n, -1, 1) if n else -9
    return sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]


@pytest.mark.parametrize("k", [1, 5, 63, 100])
def test_search_is_exact(collection, k):
    df, vecs = collection
    found = [r["id"] for r in search(df, vecs[3], k, []).collect()]
    assert len(found) == min(k, 63)
    if k > 3:  # among the copies rounding decides
        assert sorted(found) == sorted(expected(vecs, vecs[3], k)) and set(found[:3]) == {3, 61, 62}
    assert found[-1] == 60 if k >= 63 else 60 not in found


def test_search_many_agrees_with_search(collection):
    df, vecs = collection
    q = df.where("id % 7 = 0 and id < 60").select(F.col("id").alias("query_id"), "embedding")
    found = {}
    for r in search_many(df, q, 4).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    assert set(found) == set(range(0, 60, 7))
    for i, ranks in found.items():
        one = [r["id"] for r in search(df, vecs[i], 4, []).collect()]
        assert set(ranks.values()) == set(one) and ranks[1] == one[0]


def test_search_many_without_queries(collection, spark):
    df, _ = collection
    assert search_many(df, spark.createDataFrame([], "query_id long, embedding array<float>")).count() == 0


def test_flip_twice_is_identity(spark):
    df = spark.createDataFrame([([float(i) for i in range(12)],)], "p array<double>")
    once = vectors.flip_rows(F.col("p"), 4)
    row = df.select(once.alias("a"), vectors.flip_rows(once, 4).alias("b"), "p").first()
    assert row["b"] == row["p"] and row["a"][:4] == [3.0, 2.0, 1.0, 0.0]


def test_face_selection(spark):
    def face(x, y, score):
        return ([0.0, 0.0, x, y], [[0.0, 0.0]] * 5, score)

    kind = "id int, faces array<struct<box:array<double>,landmarks:array<array<double>>,score:double>>"
    df = spark.createDataFrame([(1, [face(1.0, 2.0, 0.5), face(2.0, 1.0, 0.7), face(1.0, 1.0, 0.9)]), (2, [face(0.0, 3.0, 0.9)]), (3, []), (4, [face(1.0, 1.0, None), (None, None, 0.9)])], kind)
    f = F.col("faces")
    got = {r["id"]: r for r in df.select("id", faces.largest(f).alias("l"), faces.most_confident(f).alias("c"), F.size(faces.usable(f, 0.6)).alias("n")).collect()}
    assert got[1]["l"]["score"] == 0.7 and got[1]["c"]["score"] == 0.9 and got[1]["n"] == 2
    assert got[2]["l"] is None and got[2]["c"]["score"] == 0.9
    assert got[3]["l"] is None and got[3]["c"] is None and got[4]["n"] == 1


def test_similarity_fit_against_numpy(spark):
    data = [(g, *map(float, RNG.standard_normal(4))) for g in range(8) for _ in range(5)] + [(99, 1.0, 1.0, float(i), 2.0) for i in range(5)]
    df = spark.createDataFrame(data, "g int, x double, y double, u double, v double")
    for r in faces.fit_similarity(df, "g", "x", "y", "u", "v").collect():
        own = np.array([d[1:] for d in data if d[0] == r["g"]])
        want = images.fit_similarity(own[:, :2], own[:, 2:])
        if r["g"] == 99:
            assert r["a"] is None and np.isnan(want).all()
        else:
            assert np.allclose([[r["a"], -r["b"], r["tx"]], [r["b"], r["a"], r["ty"]]], want)


def test_aligned_face_stays():
    points = np.array(faces.reference_points(112))
    image = RNG.integers(0, 255, (112, 112, 3), dtype=np.uint8)
    matrix = images.fit_similarity(points, points)
    assert np.allclose(matrix, [[1, 0, 0], [0, 1, 0]]) and (images.warp(image, matrix, 112) == image).all()


def test_resize_keeps_constant_images():
    assert (images.resize(np.full((31, 17, 3), 77, np.uint8), 112, 112) == 77).all()
    assert images.to_tensor(np.zeros((4, 5, 3), np.uint8)).shape == (3, 4, 5)



@pytest.mark.parametrize("height,width", [(5, 4), (40, 30), (7, 40)])
def test_resize_against_loops(height, width):
    """A triangle filter written out pixel by pixel: as wide as the shrinking, one pixel where an image grows."""
    image = RNG.integers(0, 255, (17, 13, 3), dtype=np.uint8)

    def weights(size_in, size_out, i):
        scale = size_in / size_out
        reach, centre = max(scale, 1.0), (i + 0.5) * scale
        w = [max(0.0, 1 - abs(j + 0.5 - centre) / reach) for j in range(size_in)]
        return [x / sum(w) for x in w]

    got = images.resize(image, height, width)
    for y in range(height):
        rows = weights(17, height, y)
        for x in range(width):
            columns = weights(13, width, x)
            want = sum(rows[j] * columns[i] * image[j, i].astype(float) for j in range(17) for i in range(13) if rows[j] and columns[i])
            assert np.abs(got[y, x] - want).max() <= 0.5 + 1e-6


def test_warp_against_loops():
    """Bilinear sampling at the place that the similarity's inverse gives, black outside."""
    image = RNG.integers(0, 255, (20, 24, 3), dtype=np.uint8)
    source = np.array([[4.0, 5.0], [15.0, 6.0], [9.0, 12.0], [6.0, 16.0], [14.0, 15.0]])
    matrix = images.fit_similarity(source, np.array(faces.reference_points(112)) / 7)
    got, inverse = images.warp(image, matrix, 16), np.linalg.inv(np.vstack([matrix, [0, 0, 1]]))

    def pixel(y, x):
        return image[y, x].astype(float) if 0 <= y < 20 and 0 <= x < 24 else np.zeros(3)

    for y in range(16):
        for x in range(16):
            u, v, _ = inverse @ [x, y, 1]
            if not (-1 < u < 24 and -1 < v < 20):
                assert (got[y, x] == 0).all()
                continue
            i, j = int(np.floor(u)), int(np.floor(v))
            du, dv = u - i, v - j
            want = (pixel(j, i) * (1 - du) + pixel(j, i + 1) * du) * (1 - dv) + (pixel(j + 1, i) * (1 - du) + pixel(j + 1, i + 1) * du) * dv
            assert np.abs(got[y, x] - want).max() <= 0.5 + 1e-6
