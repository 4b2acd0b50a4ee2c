"""Pixels as rows and as arrays against numpy's versions of the same resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facelake.functions import images, sampling
from facelake.operators.faces import reference_points


def grey(seed, height, width):
    return np.random.default_rng(seed).integers(0, 256, (height, width), dtype=np.uint8)


def frame(spark, shapes):
    rows = [(i, h, w, grey(i, h, w).ravel().tolist()) for i, (h, w) in enumerate(shapes)]
    return spark.createDataFrame(rows, "id int, height int, width int, v array<int>")


def plain(i, shape, change):
    return change(np.repeat(grey(i, *shape)[:, :, None], 3, axis=2))[:, :, 0].ravel().tolist()


@pytest.mark.parametrize("size", [(16, 16), (20, 31)])
def test_enlarged(spark, size):
    shapes = [(8, 8), (5, 7), (1, 1), (16, 3), (16, 16)]
    found = sampling.assembled(sampling.enlarged(frame(spark, shapes), *size), ["id"]).collect()
    assert {r.id: r.image for r in found} == {i: plain(i, s, lambda x: images.resize(x, *size)) for i, s in enumerate(shapes)}
    with pytest.raises(Exception, match="larger than"):
        sampling.enlarged(frame(spark, [(40, 2)]), *size).collect()


def test_resized(spark):
    shapes = [(8, 8), (30, 17), (9, 40)]
    found = frame(spark, shapes).select("id", sampling.resized(F.col("v"), F.col("height"), F.col("width"), 12, 10).alias("image")).collect()
    assert {r.id: r.image for r in found} == {i: plain(i, s, lambda x: images.resize(x, 12, 10)) for i, s in enumerate(shapes)}


def test_warped(spark):
    shapes = [(8, 8), (30, 17), (9, 40), (6, 6)]
    rng = np.random.default_rng(9)
    points = [(rng.random((5, 2)) * [w, h]).tolist() for h, w in shapes[:3]] + [[[1.0, 1.0]] * 5]
    target = reference_points(24 * 7)[:5]
    target = [(x / 7, y / 7) for x, y in target]
    marks = spark.createDataFrame(list(enumerate(points)), "id int, points array<array<double>>")
    rows = frame(spark, shapes).join(marks, "id").select("*", sampling.fitted(F.col("points"), target).alias("m"))
    fits = {r.id: r.m for r in rows.select("id", "m").collect()}
    assert fits[3] is None
    for i in range(3):
        m = images.fit_similarity(np.array(points[i]), np.array(target))
        assert np.allclose([fits[i].a, fits[i].b, fits[i].tx, fits[i].ty], [m[0, 0], m[1, 0], m[0, 2], m[1, 2]])
    found = {r.id: r.image for r in sampling.assembled(sampling.warped(rows.drop("points"), 24), ["id"]).collect()}
    want = {i: plain(i, shapes[i], lambda x, i=i: images.warp(x, images.fit_similarity(np.array(points[i]), np.array(target)), 24)) for i in range(3)}
    assert found == want
