"""Selecting, measuring and aligning detected faces, as column expressions over arrays of structs.

A face is struct(box array<double>(4), landmarks array<array<double>>(5 x 2), score double).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACE = T.StructType([
    T.StructField("box", T.ArrayType(T.DoubleType())), T.StructField("landmarks", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("score", T.DoubleType()),
])


#: The five reference landmarks of a 112 x 112 face.
REFERENCE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))


def usable(faces: Column, confidence: float) -> Column:
    """Faces with box, five landmark points and enough confidence; a missing score counts as 1."""

    def keep(f: Column) -> Column:
        points = (F.size(f["landmarks"]) == 5) & F.forall(f["landmarks"], lambda p: F.size(p) == 2)
        return f["box"].isNotNull() & F.coalesce(points, F.lit(False)) & (F.coalesce(f["score"], F.lit(1.0)) >= confidence)

    return F.filter(faces, keep)


def area(f: Column) -> Column:
    b = f["box"]
    return (b[2] - b[0]) * (b[3] - b[1])


def _best(faces: Column, rank) -> Column:
    """The face with the greatest rank, the earlier of equal ones."""
    keyed = F.transform(faces, lambda f, i: F.struct(rank(f).alias("key"), (-i).alias("place"), f.alias("face")))
    return F.array_max(F.transform(keyed, lambda k: F.struct(k["key"], k["place"])))["place"]


def largest(faces: Column) -> Column:
    """The face with the largest positive area, then score, then place; null if there is none."""
    rated = F.transform(
        faces, lambda f, i: F.struct(area(f).alias("area"), F.coalesce(f["score"], F.lit(1.0)).alias("score"), (-i).alias("place"))
    )
    best = F.array_max(F.filter(rated, lambda r: r["area"] > 0))
    return F.get(faces, -best["place"])


def most_confident(faces: Column) -> Column:
    """The face with the highest score, the earlier of equal ones."""
    return F.get(faces, -_best(faces, lambda f: F.coalesce(f["score"], F.lit(1.0))))


def best_rows(rows: DataFrame, key: str, rank: list[Column], values: list[Column]) -> DataFrame:
    """(key, values) of each image's face with the greatest rank, of rows that hold one face each; folded before it moves."""
    best = F.max_by(F.struct(*values), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("best")
    return rows.groupBy(key).agg(best).select(key, "best.*")


def ranked(faces: Column) -> Column:
    """Faces by falling score, equal ones in their order."""
    keyed = F.transform(faces, lambda f, i: F.struct((-F.coalesce(f["score"], F.lit(1.0))).alias("s"), i.alias("i")))
    return F.transform(F.sort_array(keyed), lambda k: F.get(faces, k["i"]))


def reference_points(size: int) -> list[tuple[float, float]]:
    """The reference landmarks for a square image of a size: multiples of 128 keep a margin of 8 on either side."""
    if size % 112 and size % 128 == 0:
        ratio, shift = size / 128.0, 8.0 * size / 128.0
    else:
        ratio, shift = size / 112.0, 0.0
    return [(x * ratio + shift, y * ratio) for x, y in REFERENCE]


def reference_array(size: Column) -> Column:
    """reference_points of a size that is a column: an array of five (x, y)."""
    wide = (size % 112 != 0) & (size % 128 == 0)
    ratio = F.when(wide, size / 128.0).otherwise(size / 112.0)
    shift = F.when(wide, F.lit(8.0)).otherwise(F.lit(0.0)) * size / 128.0
    return F.array(*[F.array(x * ratio + shift, y * ratio) for x, y in REFERENCE])


def fit_similarity(points: DataFrame, key: str, x: str, y: str, u: str, v: str) -> DataFrame:
    """(key, n, a, b, tx, ty): the similarity [[a, -b, tx], [b, a, ty]] that maps (x, y) to (u, v) best.

    Least squares in closed form from covariances, one aggregation for all groups, which large coordinates
    do not upset; n is the number of points; null where all of a group's points coincide.
    """
    c = {n: F.col(f"`{n}`").cast("double") for n in (x, y, u, v)}
    sums = points.groupBy(key).agg(
        F.count("*").alias("n"),
        *[F.avg(c[n]).alias(f"m_{i}") for i, n in enumerate((x, y, u, v))],
        (F.covar_pop(c[x], c[u]) + F.covar_pop(c[y], c[v])).alias("dot"),
        (F.covar_pop(c[x], c[v]) - F.covar_pop(c[y], c[u])).alias("cross"),
        (F.var_pop(c[x]) + F.var_pop(c[y])).alias("spread"),
    )
    spread = F.when(F.col("spread") > 0, F.col("spread"))
    fitted = sums.select(key, "n", "m_0", "m_1", "m_2", "m_3", (F.col("dot") / spread).alias("a"), (F.col("cross") / spread).alias("b"))
    return fitted.select(
        key,
        "n",
        "a",
        "b",
        (F.col("m_2") - F.col("a") * F.col("m_0") + F.col("b") * F.col("m_1")).alias("tx"),
        (F.col("m_3") - F.col("b") * F.col("m_0") - F.col("a") * F.col("m_1")).alias("ty"),
    )


def parsed(boxes: dict[str, Column], points: dict[str, Column], scores: dict[str, Column]) -> Column:
    """A face from a detector's output whose fields go by several names: the first that is given of each.

    boxes and points: flat arrays or arrays of points by name, tried in this order; scores: numbers, 1 without one.
    """
    box, score = F.coalesce(*boxes.values()), F.coalesce(*scores.values(), F.lit(1.0))
    marks = F.coalesce(*[F.when(F.size(p) > 0, p) for p in points.values()])
    return F.when(box.isNotNull(), F.struct(box.cast("array<double>").alias("box"), marks.cast("array<array<double>>").alias("landmarks"), score.cast("double").alias("score")))


def explode_faces(images: DataFrame, confidence: float = 0.0) -> DataFrame:
    """One row for each usable face of images (.., faces): its place by falling score, box, area, landmarks and score."""
    found = ranked(usable(F.col("faces"), confidence))
    rest = [c for c in images.columns if c not in ("faces", "data")]
    rows = images.select(*rest, F.posexplode(found).alias("face_no", "f"))
    return rows.select(*rest, "face_no", "f.box", area(F.col("f")).alias("area"), "f.landmarks", "f.score")


def landmark_points(values: Column) -> Column:
    """The first ten numbers of a flat array as five points."""
    first = F.slice(values, 1, 10)
    return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.slice(first, 2 * i + 1, F.lit(2)))
