"""Request shapes, names, loader options, detection and what is drawn."""

import json

import numpy as np
import pytest
from detectors import bright_detector
from pyspark.sql import functions as F

from facelake import cli
from facelake.config import EngineConfig, ModelSpec
from facelake.functions import images, strings
from facelake.functions.layers import REGISTRY
from facelake.operators import faces
from facelake.operators.collections import Collection
from facelake.operators.embed import embed, tensors
from facelake.operators.search import search_many
from facelake.service import Service, matching_files
from facelake.session import scratch, ship
from facelake.sources.images import list_images, one_source, read_images, write_drawn

LIGHT, DARK = np.full((16, 12, 3), 200, np.uint8), np.full((16, 12, 3), 20, np.uint8)
CONFIG = EngineConfig(models=(ModelSpec("pixels", "faces_pixels"),), base_dim=3 * 112 * 112, confidence=0.5)


@pytest.fixture
def folder(tmp_path, spark):
    ship(spark)
    for name, image in (("ann", LIGHT), ("bob", DARK)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.png").write_bytes(images.png(image))
    (tmp_path / "ann" / "broken.jpg").write_bytes(b"no image")
    return tmp_path


@pytest.fixture(scope="module")
def service(spark):
    return Service(spark, CONFIG, detector=lambda df: bright_detector(df, 0.3))


def test_answers_are_json(service):
    assert json.loads(service.handle("nowhere")) == {"status": 404, "error": "no such endpoint"}
    assert json.loads(service.handle("health"))["status"] == "healthy"
    assert json.loads(service.handle("embedding", 5, 6, 7))["status"] == 500
    answer = json.loads(service.handle("embedding", ("x.png", images.png(LIGHT)), "pixels"))
    assert answer["success"] and len(answer["embedding"]) == CONFIG.dim
    faceless = json.loads(service.handle("embedding", ("x.png", images.png(DARK)), "pixels"))
    assert faceless["status"] == 422 and faceless["message"] == "no_face"
    assert json.loads(service.handle("embedding", ("x.png", b"none"), "pixels"))["status"] == 500
    big = Service(service.spark, EngineConfig(models=CONFIG.models, max_upload_bytes=10))
    assert big.embedding(("x.png", bytes(20)), "pixels")["status"] == 413
    batch = json.loads(service.handle("embeddings_batch", [("../a b.png", images.png(LIGHT)), ("d.png", images.png(DARK)), ("e.txt", b"1")], "pixels"))
    assert (batch["successful"], batch["failed"], batch["no_face_detected"]) == (1, 2, 1)
    assert batch["results"][0]["filename"] == "a_b.png"


NAMES = ["../../etc/passwd", "My Photo.JPG", "é à ñ.png", "ﬁle ½.png", "..", "", "日本.png", "a\\b c\t.png", "__x__", "é.bmp", "Ⅷ㎏.tiff", "a/b"]


def test_safe_names(spark):
    frame = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {r.name: r.safe for r in frame.select("name", strings.secure_filename(F.col("name")).alias("safe")).collect()}
    assert got == {n: strings.safe_name(n) for n in NAMES}
    assert got["../../etc/passwd"] == "etc_passwd" and got["é à ñ.png"] == "e_a_n.png" and got["ﬁle ½.png"] == "file_12.png"


def test_one_source(spark):
    row = spark.sql("SELECT 'a' AS a, 'b' AS b, cast(null AS string) AS c").select(one_source(F.col("a"), F.col("c")).alias("x"), one_source(F.col("a"), F.col("b")).alias("y"), one_source(F.col("c")).alias("z")).first()
    assert tuple(row) == (True, False, False)


def test_registered_embedders_reach_the_tasks(spark, folder):
    REGISTRY.register("corner", lambda weights: lambda x: x[:, :, 0, 0] + float(weights or 0))
    done = embed(read_images(spark, str(folder)), "corner", EngineConfig(face_detection=False, use_tta=False), weights="10").where("status = 'ok'").collect()
    assert len(done) == 2 and all(len(r.embedding) == 3 and 9 <= r.embedding[0] <= 11 for r in done)
    with pytest.raises(KeyError, match="unknown model"):
        embed(read_images(spark, str(folder)), "missing", EngineConfig(face_detection=False))
    assert {"mobilenetv3_large", "mobilenetv3_large_iti", "cosface_resnet50", "onnx"} <= set(REGISTRY.names())


def test_detection_and_information(spark, folder):
    found = bright_detector(read_images(spark, str(folder)), 0.3)
    listed = {r.path.split("/")[-2]: r for r in faces.explode_faces(found).collect()}
    assert set(listed) == {"ann"} and listed["ann"].box == [0.0, 0.0, 12.0, 16.0] and listed["ann"].area == 192.0
    done = {(r.path.split("/")[-2], r.status): r for r in embed(found, "pixels", CONFIG).collect()}
    assert set(done) == {("ann", "ok"), ("ann", "decode_error"), ("bob", "no_face")}
    row = done["ann", "ok"]
    assert row.was_aligned and row.num_faces == 1 and abs(row.face_score - 200 / 255) < 1e-9 and row.face_box == [0.0, 0.0, 12.0, 16.0]


def test_drawn_files(spark, folder):
    where = scratch(spark, "drawn-images")
    where = where if ":" in where else f"file://{where}"
    files = write_drawn(bright_detector(read_images(spark, str(folder)), 0.3), where)
    assert sorted(r.num_faces for r in files.collect()) == [0, 1]
    again = {r.height: r for r in read_images(spark, where).collect()}
    assert set(again) == {16}
    one = images.draw(np.zeros((40, 60, 3), np.uint8), [[2, 3, 50, 30]], [[[20, 10]]], [0.987])
    assert (one[3, 2:50] == (0, 255, 0)).all() and (one[10, 20] == (0, 255, 0)).all() and one[6:11, 5:30].any()
    assert images.label(0.5).shape == (5, 20)


def test_tensors_of_bad_images(spark, folder):
    got = {r.status: r.tensor for r in tensors(read_images(spark, str(folder)).where("path not like '%bob%'"), 8).collect()}
    assert got["decode_error"] is None and len(got["ok"]) == 192


def test_loader_options(spark, folder):
    def run(*more):
        a = cli.parser().parse_args(["ingest", "--model", "pixels", "--dir", str(folder), *more])
        done = cli.embedded(spark, a, cli.config_of(a), lambda df: bright_detector(df, 0.3))
        return sorted((r.path.split("/")[-2], r.status) for r in done.collect())

    assert run("--skip-no-face") == [("ann", "decode_error"), ("ann", "ok"), ("bob", "no_face")]
    assert run() == [("ann", "decode_error"), ("ann", "ok"), ("bob", "no_face")]  # never stored without a face
    assert run("--embed-faceless") == [("ann", "decode_error"), ("ann", "ok"), ("bob", "ok")]
    assert run("--no-face-detection", "--batch-size", "1") == [("ann", "decode_error"), ("ann", "ok"), ("bob", "ok")]
    assert run("--face-conf", "0.9", "--skip-no-face") == [("ann", "decode_error"), ("ann", "no_face"), ("bob", "no_face")]
    assert run("--limit", "1") == [("ann", "ok")]
    config = cli.config_of(cli.parser().parse_args(["ingest", "--no-tta", "--no-select-largest", "--face-conf", "0.7"]))
    assert (config.use_tta, config.select_largest, config.confidence) == (False, False, 0.7)


def test_command_line(spark, folder, capsys):
    args = ["--model", "pixels", "--collection", "cli_faces", "--dir", str(folder), "--no-tta"]
    Collection(spark, "cli_faces", 512).drop()
    with pytest.raises(Exception):  # pixels are no vectors of 512 values
        cli.main(["ingest", *args])
    Collection(spark, "cli_faces", 512).drop()
    assert cli.main(["ingest", "--model", "seeded_projection", *args[2:], "--recreate"]) == 0
    assert "2 rows inserted" in capsys.readouterr().out
    assert cli.main(["stats", *args]) == 0 and "'row_count': 2" in capsys.readouterr().out
    hits = Collection(spark, "cli_faces", 512).query(limit=5)
    files = matching_files(hits, list_images(spark, str(folder))).collect()
    assert len(files) == 2 and all(r.length > 0 for r in files)
    Collection(spark, "cli_faces", 512).drop()


def test_many_files_and_names(service):
    """A batch has no limit of its own; a single file's name is checked as it was given."""
    many = service.embeddings_batch([(f"{i}.txt", b"1") for i in range(150)], "pixels")
    assert (many["total"], many["failed"]) == (150, 150)
    assert service.embedding(("日本.png", images.png(LIGHT)), "pixels")["success"]
    assert not service.embeddings_batch([("日本.png", images.png(LIGHT))], "pixels")["successful"]  # whose safe name has no extension


def test_loaded_state(spark, service, folder):
    """Models are built in workers; the driver knows of it after a job, and not after a clearing."""
    REGISTRY.clear()
    listed = lambda: {m["name"]: m["loaded"] for m in service.models()["models"]}
    assert listed() == {"pixels": False}
    assert service.embedding(("x.png", images.png(LIGHT)), "pixels")["success"]
    assert listed() == {"pixels": True} and not REGISTRY.is_loaded("pixels", "other weights")
    REGISTRY.clear()
    assert listed() == {"pixels": False}
    built = spark.sparkContext.accumulator(0)

    def make(weights):
        built.add(1)
        return lambda x: x[:, :, 0, 0]

    REGISTRY.register("counted", make)
    config = EngineConfig(face_detection=False, use_tta=False)
    image = read_images(spark, str(folder)).where("status = 'ok'").coalesce(1)
    for turn in (1, 2):
        assert embed(image, "counted", config).count() == 2 and len(embed(image, "counted", config).collect()) == 2
    before = built.value
    assert before >= 1 and REGISTRY.is_loaded("counted")
    REGISTRY.clear()
    embed(image, "counted", config).collect()
    assert built.value > before


def test_search_with_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [1.0]), (3, [0.0, 0.0]), (4, [0.0, 2.0]), (5, [3.0, 0.0]), (6, [1.0, None]), (None, [1.0, 0.0])]
    data = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = spark.createDataFrame([(10, [2.0, 0.0]), (11, None), (12, [0.0, 1.0])], "query_id long, embedding array<float>")
    got = {}
    for r in search_many(data, queries, 3).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.distance))
    assert got[10][:2] == [(0, 1.0), (5, 1.0)] and got[12][0] == (4, 1.0) and len(got[11]) == 3
    assert all(d is None for _, d in got[11])
