"""Resampling of grey images held as arrays of values, row by row.

A new image's pixels are rows of its own, worked out in generated code from the four sources around them; where an image shrinks,
a pixel has more sources, and `resized` folds them by array functions. Nothing moves between tasks until pixels are put together.
The numpy versions in `images` give the same pixels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def whole(value: Column) -> Column:
    """A pixel's value: the nearest whole number, halves to the even one, whatever the last digits of the sums."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.bround(F.round(value, 6), 0)))


def sources(size_in: Column, size_out: Column) -> Column:
    """For each place of an axis, the first source and the weights of it and those behind it; the triangle widens when an image shrinks."""
    scale = size_in / size_out
    reach = F.greatest(scale, F.lit(1.0))

    def place(i: Column) -> Column:
        centre = (i + 0.5) * scale
        first = F.greatest(F.lit(0), F.ceil(centre - reach - 0.5).cast("int"))
        last = F.least(size_in.cast("int") - 1, F.floor(centre + reach - 0.5).cast("int"))
        raw = F.transform(F.sequence(first, last), lambda s: F.greatest(F.lit(0.0), 1 - F.abs(s + 0.5 - centre) / reach))
        return let(raw, lambda w: F.struct(first.alias("first"), let(total(w), lambda t: F.transform(w, lambda x: x / t)).alias("weights")))

    return F.transform(F.sequence(F.lit(0), size_out.cast("int") - 1), place)


def resized(values: Column, height: Column, width: Column, size_y: int, size_x: int) -> Column:
    """The values of an image of height x width at size_y x size_x."""
    n = F.lit(size_x)

    def along(rows: Column, ways: Column) -> Column:
        """Each row at the new width."""

        def pixel(p: Column) -> Column:
            way = F.get(ways, F.pmod(p, n))
            start = F.floor(p / n).cast("int") * width.cast("int") + way["first"]
            return total(F.transform(way["weights"], lambda w, j: w * F.get(rows, start + j)))

        return F.transform(F.sequence(F.lit(0), height.cast("int") * n - 1), pixel)

    def down(rows: Column, ways: Column) -> Column:
        def pixel(p: Column) -> Column:
            way = F.get(ways, F.floor(p / n).cast("int"))
            return whole(total(F.transform(way["weights"], lambda w, j: w * F.get(rows, (way["first"] + j) * n + F.pmod(p, n)))))

        return F.transform(F.sequence(F.lit(0), F.lit(size_y * size_x - 1)), pixel)

    doubles = F.transform(values, lambda v: v.cast("double"))
    wide = let(F.struct(doubles.alias("v"), sources(width, n).alias("s")), lambda z: along(z["v"], z["s"]))
    return let(F.struct(wide.alias("v"), sources(height, F.lit(size_y)).alias("s")), lambda z: down(z["v"], z["s"]))


def fitted(points: Column, target: list[tuple[float, float]]) -> Column:
    """struct(a, b, tx, ty) of the similarity that maps points, an array of (x, y), to as many target points best; null where
    the points coincide."""
    n = float(len(target))
    mean_u, mean_v = sum(u for u, _ in target) / n, sum(v for _, v in target) / n
    places = F.array(*[F.struct(F.lit(u - mean_u).alias("u"), F.lit(v - mean_v).alias("v")) for u, v in target])

    def axis(p: Column, i: int) -> Column:
        return F.transform(p, lambda q: F.get(q, F.lit(i)).cast("double"))

    def fit(m: Column) -> Column:
        centred = F.zip_with(points, places, lambda q, t: F.struct((F.get(q, F.lit(0)) - m["x"]).alias("x"), (F.get(q, F.lit(1)) - m["y"]).alias("y"), t["u"].alias("u"), t["v"].alias("v")))

        def sums(c: Column) -> Column:
            square = total(F.transform(c, lambda q: q["x"] * q["x"] + q["y"] * q["y"]))
            along, across = total(F.transform(c, lambda q: q["x"] * q["u"] + q["y"] * q["v"])), total(F.transform(c, lambda q: q["x"] * q["v"] - q["y"] * q["u"]))
            return F.when(square > 1e-12, F.struct((along / square).alias("a"), (across / square).alias("b")))

        return let(let(centred, sums), lambda s: F.when(s.isNotNull(), F.struct(
            s["a"].alias("a"), s["b"].alias("b"), (mean_u - s["a"] * m["x"] + s["b"] * m["y"]).alias("tx"), (mean_v - s["b"] * m["x"] - s["a"] * m["y"]).alias("ty"),
        )))

    return let(F.struct((total(axis(points, 0)) / n).alias("x"), (total(axis(points, 1)) / n).alias("y")), fit)


def pixel_rows(images: DataFrame, size_y: int, size_x: int) -> DataFrame:
    """A row (.., p) for each pixel of the new images, row by row; columns of one stage, which carries no image from row to row."""
    return images.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(size_y * size_x - 1))))


def mixed(values: Column, height: Column, width: Column, top: Column, left: Column, dv: Column, du: Column, edge: bool) -> Column:
    """A pixel from its four sources, the first at (top, left); edge: those outside repeat the image's edge, else they are black."""
    h, w = height.cast("int"), width.cast("int")

    def source(y: Column, x: Column) -> Column:
        inner_y, inner_x = (F.greatest(F.lit(0), F.least(v, n - 1)) for v, n in ((y, h), (x, w)))
        found = F.get(values, inner_y * w + inner_x).cast("double")
        return found if edge else F.when((y == inner_y) & (x == inner_x), found).otherwise(0.0)

    upper = source(top, left) * (1 - du) + source(top, left + 1) * du
    lower = source(top + 1, left) * (1 - du) + source(top + 1, left + 1) * du
    return whole(upper * (1 - dv) + lower * dv)


def enlarged(images: DataFrame, size_y: int, size_x: int, values: str = "v", height: str = "height", width: str = "width") -> DataFrame:
    """(.., p, value): the pixels of images (.., values, height, width) at a size that is no smaller on either axis."""
    rows = pixel_rows(images, size_y, size_x)
    y, x = F.floor(F.col("p") / size_x), F.pmod("p", F.lit(size_x))
    at = {"v_at": (y + 0.5) * (F.col(height) / size_y) - 0.5, "u_at": (x + 0.5) * (F.col(width) / size_x) - 0.5}
    rows = rows.withColumns(at).withColumns({"top": F.floor("v_at").cast("int"), "left": F.floor("u_at").cast("int")})
    value = mixed(F.col(values), F.col(height), F.col(width), F.col("top"), F.col("left"), F.col("v_at") - F.col("top"), F.col("u_at") - F.col("left"), edge=True)
    fits = F.when((F.col(height) <= size_y) & (F.col(width) <= size_x), value).otherwise(F.raise_error(F.lit("an image is larger than what it should become")).cast("double"))
    return rows.withColumn("value", fits).drop("v_at", "u_at", "top", "left", values)


def warped(images: DataFrame, size: int, similarity: str = "m", values: str = "v", height: str = "height", width: str = "width") -> DataFrame:
    """(.., p, value): the pixels of the square images that similarities struct(a, b, tx, ty) map images (.., values, height, width)
    to, black outside; images without a similarity are left out."""
    rows = pixel_rows(images.where(F.col(similarity).isNotNull()), size, size)
    a, b, tx, ty = (F.col(f"{similarity}.{n}") for n in ("a", "b", "tx", "ty"))
    x, y, square = F.pmod("p", F.lit(size)) - tx, F.floor(F.col("p") / size) - ty, a * a + b * b
    # far outside there is nothing to find, and whole numbers have no room
    at = {
        "u_at": F.greatest(F.lit(-2.0), F.least((a * x + b * y) / square, F.col(width) + 1.0)),
        "v_at": F.greatest(F.lit(-2.0), F.least((a * y - b * x) / square, F.col(height) + 1.0)),
    }
    rows = rows.withColumns(at).withColumns({"top": F.floor("v_at").cast("int"), "left": F.floor("u_at").cast("int")})
    value = mixed(F.col(values), F.col(height), F.col(width), F.col("top"), F.col("left"), F.col("v_at") - F.col("top"), F.col("u_at") - F.col("left"), edge=False)
    return rows.withColumn("value", value).drop("v_at", "u_at", "top", "left", values, similarity)


def assembled(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, image): pixel rows (keys, p, value) as arrays, row by row."""
    found = pixels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "value"))).alias("image"))
    return found.select(*keys, F.transform("image", lambda q: q["value"]).alias("image"))
