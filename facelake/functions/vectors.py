"""Vector arithmetic as column expressions, in double precision throughout."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_of_halves(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Cosine of (a, b) and (c, d) put together, with the halves held apart; null where one is zero."""
    product = F.sqrt(dot(a, a) + dot(b, b)) * F.sqrt(dot(c, c) + dot(d, d))
    return F.when(product > 0, clamp((dot(a, c) + dot(b, d)) / F.nullif(product, F.lit(0.0))))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity in [-1, 1]; null where a vector is zero."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    product = na * nb
    return F.when(product > 0, clamp(dot(a, b) / F.nullif(product, F.lit(0.0))))


def cosine_to(a: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to a fixed vector, whose norm is taken once."""
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    return cosine(a, literal(query), norm_b=F.lit(length))


def with_flip(embedding: Column, flipped: Column) -> Column:
    """The stored vector of test-time augmentation: both halves, one after the other."""
    return F.concat(embedding, flipped)


def normalise_pixels(pixels: Column) -> Column:
    """0..255 to -1..1."""
    return F.transform(pixels, lambda v: (v.cast("double") / 255.0 - 0.5) / 0.5)


def flip_rows(pixels: Column, width: int) -> Column:
    """A row-major image with each row reversed."""
    starts = F.sequence(F.lit(1), F.size(pixels), F.lit(width))
    return F.flatten(F.transform(starts, lambda s: F.reverse(F.slice(pixels, s, width))))


def hard_sigmoid(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / 6.0 + 0.5))


def hard_swish(x: Column) -> Column:
    return x * hard_sigmoid(x)


def prelu(x: Column, slope: float = 0.25) -> Column:
    return F.when(x >= 0, x).otherwise(x * slope)


def squeeze_excite(channels: Column, width: int) -> Column:
    """Each channel of so many values times the hard sigmoid of its mean."""
    starts = F.sequence(F.lit(1), F.size(channels), F.lit(width))

    def scaled(s: Column) -> Column:
        own = F.slice(channels, s, width)
        mean = F.aggregate(own, F.lit(0.0), lambda t, x: t + x.cast("double")) / width
        return F.transform(own, lambda x: x.cast("double") * hard_sigmoid(mean))

    return F.flatten(F.transform(starts, scaled))


def rounded_channels(value: Column, divisor: int = 8) -> Column:
    """Channel counts rounded to a multiple of divisor, never below nine tenths of the value."""
    near = F.greatest(F.lit(divisor), F.floor((value + divisor / 2.0) / divisor) * divisor)
    return F.when(near < 0.9 * value, near + divisor).otherwise(near).cast("long")
