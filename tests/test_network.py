"""Layers as joins against numpy's loops, and that only the first dealing moves rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facelake.functions import vectors
from facelake.operators import network

RNG = np.random.default_rng(6)
IMAGES = RNG.normal(size=(3, 2, 6, 6))


def maps(spark):
    rows = [(i, c, y, x, float(IMAGES[i, c, y, x])) for i in range(3) for c in range(2) for y in range(6) for x in range(6)]
    return spark.createDataFrame(rows, "image int, c int, y int, x int, v double")


def table(spark, array, *names):
    return spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(array) for at in [at]], ", ".join(f"{n} int" for n in names) + ", w double")


def as_array(found, shape):
    out = np.full(shape, np.nan)
    for r in found.collect():
        out[(r.image, r.c, r.y, r.x)] = r.v
    return out


def plain(images, w, stride, padding, depthwise):
    n, c, h, _ = images.shape
    k = w.shape[-1]
    padded = np.pad(images, ((0, 0), (0, 0), (padding, padding), (padding, padding)))
    size = (h + 2 * padding - k) // stride + 1
    out = np.zeros((n, len(w), size, size))
    for o in range(len(w)):
        for y in range(size):
            for x in range(size):
                part = padded[:, :, y * stride : y * stride + k, x * stride : x * stride + k]
                out[:, o, y, x] = (part[:, o] * w[o]).sum(axis=(1, 2)) if depthwise else (part * w[o]).sum(axis=(1, 2, 3))
    return out


@pytest.mark.parametrize("stride,padding,kernel", [(1, 1, 3), (2, 1, 3), (2, 0, 2), (1, 0, 1), (1, 0, 6), (2, 2, 5)])
@pytest.mark.parametrize("depthwise", [False, True])
def test_conv2d(spark, stride, padding, kernel, depthwise):
    w = RNG.normal(size=(2, kernel, kernel) if depthwise else (4, 2, kernel, kernel))
    weights = table(spark, w, *(("o", "ky", "kx") if depthwise else ("o", "i", "ky", "kx")))
    want = plain(IMAGES, w, stride, padding, depthwise)
    assert np.allclose(as_array(network.conv2d(maps(spark), weights, 6, stride, padding, kernel, depthwise), want.shape), want)


def test_gate_and_residual(spark):
    first, second = (RNG.normal(size=(1, 2)), RNG.normal(size=1)), (RNG.normal(size=(2, 1)), RNG.normal(size=2))

    def layer(w, b):
        return table(spark, w, "o", "i"), table(spark, b, "c").withColumnRenamed("w", "b")

    found = network.squeeze_excite(maps(spark), layer(*first), layer(*second), vectors.hard_sigmoid)
    hidden = np.maximum(IMAGES.mean(axis=(2, 3)) @ first[0].T + first[1], 0)
    gate = np.clip((hidden @ second[0].T + second[1]) / 6 + 0.5, 0, 1)
    want = IMAGES * gate[:, :, None, None]
    assert np.allclose(as_array(found, want.shape), want)
    assert np.allclose(as_array(network.added(maps(spark), found), want.shape), IMAGES + want)


def test_one_dealing(spark):
    """A convolution, its normalisation and a slope group by places of an image, which is where the rows are."""
    images = spark.createDataFrame([(i, IMAGES[i, 0].ravel().tolist()) for i in range(3)], "id int, v array<double>")
    found = network.conv2d(network.maps_of(images, "id", "v", 6), table(spark, RNG.normal(size=(2, 1, 3, 3)), "o", "i", "ky", "kx"), 6, 1, 1, 3)
    norm = spark.createDataFrame([(c, 1.0, 0.0, 0.0, 1.0) for c in range(2)], "c int, gamma double, beta double, mean double, var double")
    found = network.activated(network.batch_norm(found, norm), vectors.hard_swish)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == 1 and found.agg(F.count("*")).first()[0] == 3 * 2 * 36


def test_tasks_get_bounded_parts(spark, monkeypatch):
    """More images make more parts, not larger ones."""
    monkeypatch.setattr(network, "TASK_ROWS", 640)
    rows = spark.range(100).select("id", F.array(*[F.lit(0.5)] * 64).alias("v"))
    found = network.maps_of(rows, "id", "v", 8)
    assert found.count() == 6400
    assert found.select(F.spark_partition_id().alias("p"), "image").distinct().groupBy("p").count().agg(F.max("count")).first()[0] <= 30
