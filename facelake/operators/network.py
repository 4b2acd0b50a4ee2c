"""Layers of convolutional networks as joins and sums over rows (image, c, y, x, v), with weights from tables.

A layer's weights are a network's, not the data's, so they are broadcast; `maps_of` deals the rows by image once, and every later
grouping and join holds the image, so that no layer moves rows again. Meant for checking and for small networks in SQL; whole networks
run as batched inference (`embed`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("image", "c", "y", "x")


#: Rows of maps that a task gets: its sums and sorts hold some hundred bytes for each row and channel.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows (image, ..) by image, as many parts as n_rows rows of maps need, so that a task's memory doesn't grow with the input."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n_rows // TASK_ROWS)), "image")


def maps_of(images: DataFrame, image: str, values: str, width: int) -> DataFrame:
    """One-channel rows (image, c, y, x, v) of images whose values are an array, row by row."""
    rows = images.select(F.col(image).alias("image"), F.posexplode(values).alias("p", "v"))
    rows = dealt(rows, images.count() * width * width)
    return rows.select("image", F.lit(0).alias("c"), F.floor(F.col("p") / width).cast("int").alias("y"), (F.col("p") % width).alias("x"), F.col("v").cast("double").alias("v"))


def conv2d(maps: DataFrame, weights: DataFrame, size: int, stride: int = 1, padding: int = 0, kernel: int = 1, depthwise: bool = False) -> DataFrame:
    """A convolution of square maps of a size, without bias. weights: (o, i, ky, kx, w); depthwise: (o, ky, kx, w), a kernel a channel."""
    out = (size + 2 * padding - kernel) // stride + 1
    met = maps.join(F.broadcast(weights), F.col("c") == F.col("o" if depthwise else "i"))
    y, x = F.col("y") + padding - F.col("ky"), F.col("x") + padding - F.col("kx")
    inside = (y >= 0) & (x >= 0) & (y % stride == 0) & (x % stride == 0) & (y < out * stride) & (x < out * stride)
    placed = met.where(inside).select("image", F.col("o").alias("c"), (y / stride).cast("int").alias("y"), (x / stride).cast("int").alias("x"), (F.col("v") * F.col("w")).alias("v"))
    return placed.groupBy(*KEYS).agg(F.sum("v").alias("v"))


def batch_norm(maps: DataFrame, params: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Normalisation by stored statistics. params: (c, gamma, beta, mean, var); maps need not have places."""
    value = (F.col("v") - F.col("mean")) / F.sqrt(F.col("var") + eps) * F.col("gamma") + F.col("beta")
    return maps.join(F.broadcast(params), "c").select(*[k for k in KEYS if k in maps.columns], value.alias("v"))


def prelu(maps: DataFrame, slopes: DataFrame) -> DataFrame:
    """max(0, v) plus the channel's slope (c, slope) times min(0, v)."""
    v = F.col("v")
    return maps.join(F.broadcast(slopes), "c").select(*KEYS, F.when(v >= 0, v).otherwise(v * F.col("slope")).alias("v"))


def activated(maps: DataFrame, function: Callable[[Column], Column]) -> DataFrame:
    return maps.withColumn("v", function(F.col("v")))


def linear(vectors: DataFrame, weights: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """(image, c, v) of vectors (image, c, v): weights (o, i, w), bias (c, b)."""
    met = vectors.join(F.broadcast(weights), F.col("c") == F.col("i"))
    out = met.groupBy("image", F.col("o").alias("c")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out if bias is None else out.join(F.broadcast(bias), "c").select("image", "c", (F.col("v") + F.col("b")).alias("v"))


def squeeze_excite(maps: DataFrame, first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], gate: Callable[[Column], Column]) -> DataFrame:
    """Each channel times a gate from all channels' means: two linear layers (weights, bias) with a ramp between them."""
    pooled = maps.groupBy("image", "c").agg(F.avg("v").alias("v"))
    hidden = activated(linear(pooled, *first), lambda v: F.greatest(v, F.lit(0.0)))
    scale = activated(linear(hidden, *second), gate).withColumnRenamed("v", "scale")
    return maps.join(scale, ["image", "c"]).select(*KEYS, (F.col("v") * F.col("scale")).alias("v"))


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of two maps of the same shape, a residual."""
    return a.join(b.withColumnRenamed("v", "other"), list(KEYS)).select(*KEYS, (F.col("v") + F.col("other")).alias("v"))


def inverted_residual(maps: DataFrame, block: dict, size: int, stride: int, kernel: int, act: Callable[[Column], Column], gate: Callable[[Column], Column]) -> DataFrame:
    """Expansion, depthwise convolution, gate and projection, each convolution normalised; the input is added where its shape is the
    output's (`residual`). block: tables by name (expand, deep, project and their _norm; first, second if gated)."""
    wide = activated(batch_norm(conv2d(maps, block["expand"], size), block["expand_norm"]), act)
    deep = conv2d(wide, block["deep"], size, stride, (kernel - 1) // 2, kernel, depthwise=True)
    deep = activated(batch_norm(deep, block["deep_norm"]), act)
    if "first" in block:
        deep = squeeze_excite(deep, block["first"], block["second"], gate)
    out = batch_norm(conv2d(deep, block["project"], (size - 1) // stride + 1), block["project_norm"])
    return added(out, maps) if block.get("residual") and stride == 1 else out


def head(maps: DataFrame, deep: DataFrame, deep_norm: DataFrame, weights: DataFrame, norm: DataFrame, size: int) -> DataFrame:
    """(image, c, v): a depthwise kernel as large as the map, normalised, a linear layer without bias, normalised."""
    vector = batch_norm(conv2d(maps, deep, size, kernel=size, depthwise=True), deep_norm).select("image", "c", "v")
    return batch_norm(linear(vector, weights), norm)
