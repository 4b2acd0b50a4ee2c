"""Faces from the raw outputs of an anchor-based detector: prior boxes, decoding, non-maximum suppression.

Such a network gives, for each prior box, four box offsets, a score and ten landmark offsets. The prior of an index follows
from the image's size by arithmetic, so nothing is joined; an image's outputs are arrays of one row, so nothing moves, or rows of
candidates, which are decoded before they gather.
Offsets are decoded only where the score reaches the confidence.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facelake.functions.sampling import let
from facelake.operators import faces

#: Fixed values of the published single-stage face detector: stride and box sizes of each level, variances.
LEVELS = ((8, (16, 32)), (16, (64, 128)), (32, (256, 512)))
VARIANCES = (0.1, 0.2)


def prior_count(height: int, width: int, levels: Sequence = LEVELS) -> int:
    return sum(math.ceil(height / stride) * math.ceil(width / stride) * len(sizes) for stride, sizes in levels)


def prior_box(prior: Column, height: Column, width: Column, levels: Sequence = LEVELS) -> Column:
    """struct(cx, cy, w, h), in shares of the image, of a prior's index: by level, row, column and size."""
    found = F.lit(None)
    start: Column = F.lit(0).cast("long")
    bounds = []
    for stride, sizes in levels:
        columns = F.ceil(width / stride)
        bounds.append((start, columns, stride, sizes))
        start = start + F.ceil(height / stride) * columns * len(sizes)
    for first, columns, stride, sizes in bounds:  # the last level that begins before the prior
        place = prior - first
        cell = F.floor(place / len(sizes))
        size = F.element_at(F.array(*[F.lit(float(s)) for s in sizes]), (F.pmod(place, F.lit(len(sizes))) + 1).cast("int"))
        box = F.struct(
            ((F.pmod(cell, columns) + 0.5) * stride / width).alias("cx"), ((F.floor(cell / columns) + 0.5) * stride / height).alias("cy"),
            (size / width).alias("w"), (size / height).alias("h"),
        )
        found = F.when(prior >= first, box).otherwise(found)
    return F.when((prior >= 0) & (prior < start), found)


def decoded(candidate: Column, height: Column, width: Column, levels: Sequence = LEVELS, variances: Sequence[float] = VARIANCES) -> Column:
    """The face, in pixels, of a candidate struct(prior, score, loc array(4), marks array(10))."""
    return let(prior_box(candidate["prior"], height, width, levels), lambda p: placed(candidate, p, height, width, variances))


def placed(candidate: Column, p: Column, height: Column, width: Column, variances: Sequence[float] = VARIANCES) -> Column:
    """The face, in pixels, of a candidate whose prior box is p."""
    centre, spread = variances

    def at(values: Column, i: int) -> Column:
        return F.get(values, F.lit(i)).cast("double")

    loc, marks = candidate["loc"], candidate["marks"]
    x, y = p["cx"] + at(loc, 0) * centre * p["w"], p["cy"] + at(loc, 1) * centre * p["h"]
    w, h = p["w"] * F.exp(at(loc, 2) * spread), p["h"] * F.exp(at(loc, 3) * spread)
    points = [
        F.array((p["cx"] + at(marks, 2 * i) * centre * p["w"]) * width, (p["cy"] + at(marks, 2 * i + 1) * centre * p["h"]) * height) for i in range(5)
    ]
    return F.struct(
        F.array((x - w / 2) * width, (y - h / 2) * height, (x + w / 2) * width, (y + h / 2) * height).alias("box"),
        F.array(*points).alias("landmarks"), candidate["score"].cast("double").alias("score"),
    )


def spans(face: Column, border: float) -> Column:
    """struct(x0, y0, x1, y1, area, face) of a face: what it takes to compare boxes, worked out once."""
    x0, y0, x1, y1 = (F.get(face["box"], F.lit(i)) for i in range(4))
    own = F.greatest(F.lit(0.0), x1 - x0 + border) * F.greatest(F.lit(0.0), y1 - y0 + border)
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), own.alias("area"), face.alias("face"))


def overlap(a: Column, b: Column, border: float = 1.0) -> Column:
    """Intersection over union of two spans whose last pixels belong to them (border 1) or not (border 0)."""
    sides = [F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]) + border) for low, high in (("x0", "x1"), ("y0", "y1"))]

    def share(both: Column) -> Column:
        union = a["area"] + b["area"] - both
        return F.when(union > 0, both / union).otherwise(F.lit(0.0))

    return let(sides[0] * sides[1], share)


def unlike(ordered: Column, most: float = 0.4, border: float = 1.0) -> Column:
    """Those of an array of spans that overlap no earlier one that stays by more than `most`."""

    def step(kept: Column, span: Column) -> Column:
        hit = F.exists(kept, lambda other: overlap(other, span, border) > most)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(span)))

    return let(ordered, lambda o: F.aggregate(F.slice(o, 2, F.size(o)), F.slice(o, 1, 1), step))


def suppressed(found: Column, most: float = 0.4, border: float = 1.0) -> Column:
    """Greedy non-maximum suppression: faces by falling score, equal ones in their order, without those that overlap a
    better one that stays by more than `most`. The array holds one image's faces, whose number its priors bound."""
    return F.transform(unlike(F.transform(let(found, faces.ranked), lambda f: spans(f, border)), most, border), lambda k: k["face"])


def candidates(loc: Column, scores: Column, marks: Column, confidence: float) -> Column:
    """The candidates of one image's flat outputs (4, 1 and 10 numbers a prior) whose score reaches the confidence."""
    sure = F.filter(F.transform(scores, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda c: c["s"] >= confidence)
    return F.transform(
        sure,
        lambda c: F.struct(
            c["i"].cast("long").alias("prior"), c["s"].cast("double").alias("score"),
            F.slice(loc, c["i"] * 4 + 1, F.lit(4)).alias("loc"), F.slice(marks, c["i"] * 10 + 1, F.lit(10)).alias("marks"),
        ),
    )


def detect(found: Column, height: Column, width: Column, confidence: float = 0.35, most: float = 0.4, border: float = 1.0, levels: Sequence = LEVELS) -> Column:
    """An image's faces, by falling score, from its candidates: decoded and suppressed. Candidates without a prior of the
    image, or without a score, are none."""
    sure = F.filter(found, lambda c: F.coalesce(c["score"] >= confidence, F.lit(False)))
    boxes = F.filter(F.transform(sure, lambda c: decoded(c, height, width, levels)), lambda f: f["box"].isNotNull() & F.get(f["box"], F.lit(0)).isNotNull())
    return suppressed(boxes, most, border)


def detect_rows(
    rows: DataFrame, key: str, height: Column, width: Column, confidence: float = 0.35, most: float = 0.4, border: float = 1.0, levels: Sequence = LEVELS,
    variances: Sequence[float] = VARIANCES, ties: Sequence[str] = (),
) -> DataFrame:
    """(key, face_no, box, landmarks, score) of the faces in candidates as rows (key, prior, score, loc, marks, ..), which `detect`
    takes as arrays: a row for each face, by falling score; equal scores go by the columns `ties`, then by prior, loc and marks.

    Priors and boxes are worked out a row at a time by short steps of generated code; only suppression needs an image's boxes together,
    and landmarks are those of the faces that stay. Rows that are dealt by key don't move.
    """
    centre, spread = variances
    order = [f"t{i}" for i in range(len(ties))]
    given = [F.col(n).alias(f"t{i}") for i, n in enumerate(ties)]
    # conditions on what is given alone: one on a box would be worked out, box and all, below the shuffle
    there = F.get("loc", F.lit(0)).isNotNull() & F.get("loc", F.lit(2)).isNotNull()
    c = rows.where((F.col("score") >= confidence) & there).select(F.col(key).alias("key"), *given, "prior", F.col("score").cast("double"), "loc", "marks", height.alias("h"), width.alias("w"))
    ends = [F.lit(0).cast("long")]
    for stride, sizes in levels:
        ends.append(ends[-1] + F.ceil(F.col("h") / stride) * F.ceil(F.col("w") / stride) * len(sizes))
    c = c.withColumns({f"end{i}": end for i, end in enumerate(ends)}).where((F.col("prior") >= 0) & (F.col("prior") < F.col(f"end{len(levels)}")))

    def by_level(values: Sequence[Column]) -> Column:
        """The value of the last level that begins before the prior."""
        found = values[0]
        for i, value in enumerate(values[1:], 1):
            found = F.when(F.col("prior") >= F.col(f"end{i}"), value).otherwise(found)
        return found

    c = c.withColumns({
        "stride": by_level([F.lit(stride) for stride, _ in levels]), "n": by_level([F.lit(len(sizes)) for _, sizes in levels]),
        "sizes": by_level([F.array(*[F.lit(float(x)) for x in sizes]) for _, sizes in levels]),
        "place": F.col("prior") - by_level([F.col(f"end{i}") for i in range(len(levels))]),
    })
    c = c.withColumns({"cell": F.floor(F.col("place") / F.col("n")), "size": F.get("sizes", F.pmod("place", "n").cast("int")), "columns": F.ceil(F.col("w") / F.col("stride"))})
    c = c.withColumns({
        "cx": (F.pmod("cell", "columns") + 0.5) * F.col("stride") / F.col("w"), "cy": (F.floor(F.col("cell") / F.col("columns")) + 0.5) * F.col("stride") / F.col("h"),
        "pw": F.col("size") / F.col("w"), "ph": F.col("size") / F.col("h"),
    })

    def at(values: str, i: int) -> Column:
        return F.get(values, F.lit(i)).cast("double")

    c = c.withColumns({
        "x": F.col("cx") + at("loc", 0) * centre * F.col("pw"), "y": F.col("cy") + at("loc", 1) * centre * F.col("ph"),
        "bw": F.col("pw") * F.exp(at("loc", 2) * spread), "bh": F.col("ph") * F.exp(at("loc", 3) * spread),
    })
    c = c.withColumns({f"{v}{i}": (F.col(v) + (2 * i - 1) * F.col(f"b{side}") / 2) * F.col(side) for i in (0, 1) for v, side in (("x", "w"), ("y", "h"))})
    own = [F.greatest(F.lit(0.0), F.col(f"{v}1") - F.col(f"{v}0") + border) for v in "xy"]
    c = c.withColumn("area", own[0] * own[1])
    span = F.struct((-F.col("score")).alias("falling"), *order, "prior", "loc", "marks", "score", "x0", "y0", "x1", "y1", "area", "cx", "cy", "pw", "ph", "h", "w")
    images = c.select("key", span.alias("span")).groupBy("key").agg(F.sort_array(F.collect_list("span")).alias("ordered"))
    kept = images.select("key", F.posexplode(unlike(F.col("ordered"), most, border)).alias("face_no", "f")).select("key", "face_no", "f.*")
    points = [
        F.array((F.col("cx") + at("marks", 2 * i) * centre * F.col("pw")) * F.col("w"), (F.col("cy") + at("marks", 2 * i + 1) * centre * F.col("ph")) * F.col("h")) for i in range(5)
    ]
    return kept.select(F.col("key").alias(key), "face_no", F.array("x0", "y0", "x1", "y1").alias("box"), F.array(*points).alias("landmarks"), "score")


Outputs = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def network_detector(make: Callable[[], Outputs], size: int, confidence: float = 0.35, most: float = 0.4, batch: int = 16) -> Callable[[DataFrame], DataFrame]:
    """A detector backend: a function of images (.., height, width, channels, data, status) that adds `faces`.

    make builds, once a worker, a function from images (n, 3, size, size) to box offsets (n, priors, 4), scores
    (n, priors) and landmark offsets (n, priors, 10). Images go through it at size x size, and faces come back in their own pixels;
    images that cannot be decoded have none.
    """
    from facelake.functions.layers import loaded
    from facelake.operators.embed import inferred

    key = uuid.uuid4().hex

    def build():
        network = loaded("detector", key, lambda _: make())

        def predict(x: np.ndarray):
            return {n: v.reshape(len(x), -1) for n, v in zip(("loc", "scores", "marks"), network(x), strict=True)}

        return predict

    def run(images: DataFrame) -> DataFrame:
        rest = [c for c in images.columns if c != "faces"]
        outputs = dict.fromkeys(("loc", "scores", "marks"), T.DoubleType())
        out = inferred(images.select(F.struct(*rest).alias("whole"), "height", "width", "channels", "data", "status"), size, build, outputs, batch)
        side = F.lit(size)
        found = detect(candidates(F.col("loc"), F.col("scores"), F.col("marks"), confidence), side, side, confidence, most)
        x, y = F.col("whole.width") / size, F.col("whole.height") / size
        own = F.transform(
            found,
            lambda f: F.struct(
                F.transform(f["box"], lambda v, i: v * F.when(i % 2 == 0, x).otherwise(y)).alias("box"),
                F.transform(f["landmarks"], lambda p: F.array(p[0] * x, p[1] * y)).alias("landmarks"), f["score"].alias("score"),
            ),
        )
        return out.select("whole", F.coalesce(own, F.array().cast(T.ArrayType(faces.FACE))).alias("faces")).select("whole.*", "faces")

    return run
