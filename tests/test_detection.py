"""Raw detector outputs against plain loops: priors, decoding, suppression with ties and touching boxes, a network."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facelake.functions import images
from facelake.operators import detection
from facelake.operators.faces import FACE
from facelake.session import ship
from facelake.sources.images import read_images


def priors(height, width):
    out = []
    for stride, sizes in detection.LEVELS:
        for y in range(math.ceil(height / stride)):
            for x in range(math.ceil(width / stride)):
                for s in sizes:
                    out.append(((x + 0.5) * stride / width, (y + 0.5) * stride / height, s / width, s / height))
    return out


@pytest.mark.parametrize("height,width", [(64, 96), (50, 33), (8, 8)])
def test_priors(spark, height, width):
    want = priors(height, width)
    assert detection.prior_count(height, width) == len(want)
    box = detection.prior_box(F.col("id"), F.lit(float(height)), F.lit(float(width)))
    got = spark.range(-1, len(want) + 1).select("id", box.alias("b")).orderBy("id").collect()
    assert got[0].b is None and got[-1].b is None
    assert np.allclose([tuple(r.b) for r in got[1:-1]], want)


def overlap(a, b):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0]) + 1) * max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
    return both / ((a[2] - a[0] + 1) * (a[3] - a[1] + 1) + (b[2] - b[0] + 1) * (b[3] - b[1] + 1) - both)


def kept(found, most=0.4):
    out = []
    for box, score in sorted(found, key=lambda f: -f[1]):
        if all(overlap(box, other) <= most for other, _ in out):
            out.append((box, score))
    return out


CASES = {
    "none": [],
    "one": [([0.0, 0.0, 9.0, 9.0], 0.5)],
    "equal": [([0.0, 0.0, 9.0, 9.0], 0.5), ([0.0, 0.0, 9.0, 9.0], 0.5), ([0.0, 0.0, 9.0, 9.0], 0.9)],
    "tie": [([0.0, 0.0, 9.0, 9.0], 0.5), ([1.0, 1.0, 10.0, 10.0], 0.5), ([40.0, 0.0, 49.0, 9.0], 0.5)],
    "touching": [([0.0, 0.0, 9.0, 9.0], 0.9), ([9.0, 0.0, 18.0, 9.0], 0.8), ([10.0, 0.0, 19.0, 9.0], 0.7)],
    "chain": [([0.0, 0.0, 9.0, 9.0], 0.9), ([3.0, 0.0, 12.0, 9.0], 0.8), ([6.0, 0.0, 15.0, 9.0], 0.7)],  # the third stays, as the second goes
    "bound": [([0.0, 0.0, 9.0, 6.0], 0.9), ([0.0, 3.0, 9.0, 9.0], 0.8)],  # an overlap of 0.4 exactly is none
    "inside": [([0.0, 0.0, 99.0, 99.0], 0.9), ([10.0, 10.0, 20.0, 20.0], 0.95)],
}


def test_suppression(spark):
    marks = [[0.0, 0.0]] * 5
    rng = np.random.default_rng(3)
    cases = dict(CASES)
    for i in range(10):
        at = rng.integers(0, 30, (40, 2)).astype(float)
        cases[f"random {i}"] = [([x, y, x + w, y + h], s) for (x, y), w, h, s in zip(at.tolist(), rng.integers(5, 30, 40).tolist(), rng.integers(5, 30, 40).tolist(), (rng.integers(0, 9, 40) / 9).tolist(), strict=True)]
    rows = [(n, [(list(map(float, b)), marks, s) for b, s in found]) for n, found in cases.items()]
    frame = spark.createDataFrame(rows, f"name string, faces array<{FACE.simpleString()}>")
    got = {r.name: [(list(f.box), f.score) for f in r.faces] for r in frame.select("name", detection.suppressed(F.col("faces")).alias("faces")).collect()}
    assert got == {n: kept(found) for n, found in cases.items()}
    apart = frame.select("name", detection.suppressed(F.col("faces"), border=0.0).alias("faces")).where("name = 'touching'").first()
    assert [f.score for f in apart.faces] == [0.9, 0.8]
    assert frame.select(detection.suppressed(F.lit(None).cast(f"array<{FACE.simpleString()}>")).alias("f")).first().f is None


def plain(loc, scores, marks, height, width, confidence):
    found = []
    for i, (cx, cy, w, h) in enumerate(priors(height, width)):
        if scores[i] >= confidence:
            x, y = cx + loc[i][0] * 0.1 * w, cy + loc[i][1] * 0.1 * h
            bw, bh = w * math.exp(loc[i][2] * 0.2), h * math.exp(loc[i][3] * 0.2)
            box = [(x - bw / 2) * width, (y - bh / 2) * height, (x + bw / 2) * width, (y + bh / 2) * height]
            points = [[(cx + marks[i][2 * j] * 0.1 * w) * width, (cy + marks[i][2 * j + 1] * 0.1 * h) * height] for j in range(5)]
            found.append((box, float(scores[i]), points))
    of = {(tuple(b), s): p for b, s, p in found}
    return [(b, s, of[tuple(b), s]) for b, s in kept([(b, s) for b, s, _ in found])]


class Stub:
    """Outputs that follow from an image's mean brightness."""

    def __init__(self, size):
        n, rng = detection.prior_count(size, size), np.random.default_rng(1)
        self.loc, self.scores, self.marks = rng.normal(size=(n, 4)), rng.random(n), rng.normal(size=(n, 10))

    def __call__(self, x):
        light = (x.mean(axis=(1, 2, 3)) + 1) / 2
        return np.stack([self.loc] * len(x)), light[:, None] * self.scores, np.stack([self.marks] * len(x))


def test_network(spark, tmp_path):
    ship(spark)
    light = {"a": 250, "b": 120, "c": 10}
    for name, value in light.items():
        (tmp_path / f"{name}.png").write_bytes(images.png(np.full((32, 128, 3), value, np.uint8)))
    (tmp_path / "d.png").write_bytes(b"no image")
    size, stub = 64, Stub(64)

    def detector(batch):
        return detection.network_detector(lambda: stub, size, confidence=0.4, batch=batch)

    rows = read_images(spark, str(tmp_path))
    got = {r.path.split("/")[-1][0]: r for r in detector(2)(rows).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["d"].faces == [] and got["d"].status == "decode_error" and got["c"].faces == []
    assert len(got["a"].faces) > len(got["b"].faces) > 0 and got["a"].data is not None
    for name in "ab":
        mean = (np.float32(light[name]) / 255 - 0.5) / 0.5
        want = plain(stub.loc, (mean + 1) / 2 * stub.scores, stub.marks, size, size, 0.4)
        assert len(want) == len(got[name].faces)
        for (box, score, points), face in zip(want, got[name].faces, strict=True):
            assert np.allclose(np.array(box) * [2, 0.5, 2, 0.5], face.box) and abs(score - face.score) < 1e-5
            assert np.allclose(np.array(points) * [2, 0.5], face.landmarks)
    again = {r.path.split("/")[-1][0]: r for r in detector(64)(rows).collect()}
    assert all(np.allclose([f.score for f in got[n].faces], [f.score for f in again[n].faces]) for n in got)


def test_candidates_as_rows(spark):
    """Rows and arrays give the same faces; priors outside the image, unsure scores and missing offsets are none."""
    rng = np.random.default_rng(5)
    data = [
        (i % 9, i, int(rng.integers(-2, 262)), None if i % 17 == 0 else float(rng.integers(0, 8)) / 8, [None if i % 13 == 0 else float(x) for x in rng.normal(size=4)], [float(x) for x in rng.normal(size=10)])
        for i in range(200)
    ]
    rows = spark.createDataFrame(data, "image long, place long, prior long, score double, loc array<double>, marks array<double>")
    height, width = F.lit(64.0), F.lit(64.0) + 32 * (F.col("image") % 2)
    got = detection.detect_rows(rows, "image", height, width, 0.3, ties=("place",))
    arrays = rows.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("place", "prior", "score", "loc", "marks"))).alias("found"))
    want = arrays.select("image", F.posexplode(detection.detect(F.col("found"), height, width, 0.3)).alias("face_no", "f")).select("image", "face_no", "f.*")
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect()) and got.count() > 20


def test_boxes_are_worked_out_behind_the_shuffle(spark):
    """No box is worked out for a condition before rows are dealt; a line moves as its five numbers."""
    from facelake.plans.catalogue import QUERIES

    plan = QUERIES["detect_raw_outputs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "EXP(" in above and "EXP(" not in below
