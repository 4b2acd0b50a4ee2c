"""Checkpoints in their three forms, as archives and as tables; strict names; weights that reach the workers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facelake.config import EngineConfig
from facelake.functions import images
from facelake.operators.embed import embed
from facelake.session import ship
from facelake.sources import checkpoints
from facelake.sources.images import read_images

RNG = np.random.default_rng(2)
WEIGHTS = {"weight": RNG.normal(size=(4, 3 * 8 * 8)).astype(np.float32), "bias": RNG.normal(size=4).astype(np.float32)}
FORMS = {
    "model": {f"model/module.{n}": v for n, v in WEIGHTS.items()} | {"state_dict/other": np.zeros(1), "epoch": np.array(3)},
    "state_dict": {f"state_dict/{n}": v for n, v in WEIGHTS.items()} | {"optimizer/x": np.zeros(2)},
    "raw": {f"module.{n}": v for n, v in WEIGHTS.items()},
}


def as_dict(weights):
    return {r["name"]: np.array(r["values"], np.float32).reshape(r["shape"]) for r in weights.collect()}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("kind", ["npz", "parquet"])
def test_forms(spark, tmp_path, form, kind):
    ship(spark)
    path = str(tmp_path / f"weights.{kind}")
    if kind == "npz":
        np.savez(path, **FORMS[form])
    else:
        rows = [(n.split("/"), list(v.shape), v.astype(np.float32).ravel().tolist()) for n, v in FORMS[form].items()]
        spark.createDataFrame(rows, checkpoints.ENTRIES).write.parquet(path)
    found = as_dict(checkpoints.read_weights(spark, path))
    assert set(found) == set(WEIGHTS) and all((found[n] == WEIGHTS[n]).all() for n in WEIGHTS)


def test_errors(spark, tmp_path):
    for name in ("none.npz", "none.parquet"):
        with pytest.raises(FileNotFoundError, match="no weights at"):
            checkpoints.read_weights(spark, str(tmp_path / name))
    weights = spark.createDataFrame([("weight", [2, 2], [1.0] * 4), ("extra", [1], [1.0])], "name string, shape array<int>, values array<float>")
    assert checkpoints.checked(weights, {"weight": (2, 2), "extra": (1,)}) is weights
    with pytest.raises(ValueError, match=r"bias: wanted \[2\], found None; extra: wanted None, found \[1\]; weight: wanted \[4, 1\], found \[2, 2\]"):
        checkpoints.checked(weights, {"weight": (4, 1), "bias": (2,)})
    with pytest.raises(ValueError, match="exceed"):
        checkpoints.ship_weights(weights, "big", most_bytes=10)


def test_shipped(spark, tmp_path):
    ship(spark)
    np.savez(str(tmp_path / "head.npz"), **FORMS["model"])
    weights = checkpoints.checked(checkpoints.read_weights(spark, str(tmp_path / "head.npz")), {n: v.shape for n, v in WEIGHTS.items()})
    file = checkpoints.ship_weights(weights, "head")
    image = RNG.integers(0, 256, (8, 8, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(images.png(image))
    done = embed(read_images(spark, str(tmp_path)), "linear_head", EngineConfig(face_detection=False, image_size=8, use_tta=False), weights=file)
    row = done.select("embedding", F.col("status")).first()
    want = WEIGHTS["weight"].astype(float) @ images.to_tensor(image).ravel() + WEIGHTS["bias"]
    assert row.status == "ok" and np.allclose(row.embedding, want, atol=1e-4)
