"""Collections, images and the service over a temporary warehouse."""

import struct
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from facelake.config import EngineConfig, ModelSpec
from facelake.operators.collections import Collection, condition
from facelake.operators.embed import embed
from facelake.service import Service
from facelake.sources.images import list_images, read_images
from facelake.streaming.ingest import stream_folder


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of an RGB image."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


IMAGES = {n: np.random.default_rng(i).integers(0, 255, (16, 12, 3), dtype=np.uint8) for i, n in enumerate(("a", "b", "c"))}
CONFIG = EngineConfig(models=(ModelSpec("seeded_projection", "faces_test"), ModelSpec("onnx", "faces_other")), face_detection=False)


@pytest.fixture
def folder(tmp_path):
    for n, p in IMAGES.items():
        (tmp_path / n).mkdir()
        (tmp_path / n / "1.png").write_bytes(png(p))
    (tmp_path / "a" / "broken.png").write_bytes(b"no image")
    (tmp_path / "a" / "note.txt").write_text("x")
    return tmp_path


def test_insert_query_drop(spark):
    c = Collection(spark, "people", 2)
    c.recreate()
    rows = spark.createDataFrame([([1.0, 0.0], "ann", "p/1"), ([0.0, 1.0], None, "p/2"), ([1.0, 1.0], 'o"hara', "p/3")], "embedding array<float>, person_id string, image_path string").repartition(3)
    assert c.insert(rows) == 3 and c.insert_single([0.5, 0.5], "ann", "p/4") == 1
    assert sorted(r["id"] for r in c.read().collect()) == [1, 2, 3, 4]
    assert c.query_by_person('o"hara').count() == 1 and c.query_by_person("None").count() == 1
    assert c.query('person_id == "ann" && id > 0').count() == 2 and c.query(limit=2).count() == 2
    assert c.stats()["row_count"] == 4
    assert {r["image_path"] for r in c.search([1.0, 1.0], 2).collect()} == {"p/3", "p/4"}
    with pytest.raises(Exception, match="does not have 2 values"):
        c.insert_single([1.0], "x", "y")
    with pytest.raises(ValueError, match="holds vectors"):
        Collection(spark, "people", 3)
    c.drop()
    assert not spark.catalog.tableExists("people")


def test_condition_keeps_quoted_text(spark):
    df = spark.createDataFrame([("a == b [x]", 1), ("c", 2)], "s string, n int")
    assert df.where(condition('s == "a == b [x]" || n in [2]')).count() == 2


def test_listing_and_decoding(spark, folder):
    assert [r["path"].split("/")[-2:] for r in list_images(spark, str(folder)).collect()] == [["a", "1.png"], ["a", "broken.png"], ["b", "1.png"], ["c", "1.png"]]
    assert list_images(spark, str(folder), 2).count() == 2 and list_images(spark, str(folder), 0).count() == 4
    done = {tuple(r["path"].split("/")[-2:]): r for r in embed(read_images(spark, str(folder)), "seeded_projection", CONFIG).collect()}
    assert done["a", "broken.png"]["status"] == "decode_error" and done["a", "broken.png"]["embedding"] is None
    assert len(done["b", "1.png"]["embedding"]) == 1024 and not done["b", "1.png"]["was_aligned"]


def test_batch_size_does_not_matter(spark, folder):
    images = read_images(spark, str(folder)).where("status = 'ok'")
    one, many = (embed(images, "seeded_projection", CONFIG, batch=b).orderBy("path").collect() for b in (1, 64))
    assert all(np.allclose(x["embedding"], y["embedding"]) for x, y in zip(one, many, strict=True))


def test_service(spark):
    s = Service(spark, CONFIG)
    file = ("1.png", png(IMAGES["a"]))
    assert s.health()["status"] == "healthy" and s.models()["models"][0]["embedding_dim"] == 1024
    assert s.embedding(None, "seeded_projection")["status"] == 400 and s.embedding(file, "none")["status"] == 400
    assert s.embedding(("x.txt", b"1"), "seeded_projection")["status"] == 400
    assert s.embedding(file, "seeded_projection")["embedding_dim"] == 1024
    batch = s.embeddings_batch([file, ("x.txt", b"1"), ("y.png", b"1")], "seeded_projection")
    assert (batch["total"], batch["successful"], batch["failed"]) == (3, 1, 2)
    assert s.insert([file], "seeded_projection", None)["status"] == 400
    assert s.insert([file], "seeded_projection", "ann", "[")["status"] == 400
    done = s.insert([file, ("y.png", b"1")], "seeded_projection", "ann", '["there/1.png"]')
    assert done["inserted_count"] == 1 and len(done["errors"]) == 1
    found = s.search(file, "seeded_projection", "3")
    assert found["results"][0]["image_path"] == "there/1.png" and found["results"][0]["distance"] > 0.999
    assert s.search(file, "seeded_projection", "x")["status"] == 400
    assert s.stats()["collections"]["seeded_projection"]["row_count"] == 1
    assert s.face_detection_status() == {"enabled": False, "available": False, "confidence": 0.35, "select_largest": True}


def test_no_face(spark, folder):
    none = "array<struct<box:array<double>,landmarks:array<array<double>>,score:double>>"
    images = read_images(spark, str(folder)).where("status = 'ok'").withColumn("faces", F.array().cast(none))
    config = EngineConfig(face_detection=True)
    assert {r["status"] for r in embed(images, "seeded_projection", config).collect()} == {"no_face"}


def test_stream(spark, folder):
    c = Collection(spark, "streamed", 1024)
    c.recreate()
    for _ in range(2):
        q = stream_folder(spark, str(folder), c, "seeded_projection", CONFIG, str(folder.parent / f"{folder.name}-check"))
        q.awaitTermination(120)
    c.refreshed()
    assert {r["person_id"] for r in c.read().collect()} == {"a", "b", "c"} and c.read().count() == 3
    assert sorted(r["id"] for r in c.read().collect()) == [1, 2, 3]
    c.drop()


def test_config():
    c = EngineConfig.from_env({"USE_TTA": "false", "FACE_DETECTION_CONF_THRESHOLD": "0.5", "EMBEDDING_DIM": "256"})
    assert (c.use_tta, c.confidence, c.dim) == (False, 0.5, 256) and EngineConfig().dim == 1024
    assert CONFIG.collection("nobody") == "face_embeddings"


def rows_of(spark, n, name):
    return spark.range(n).select(F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.lit(name).alias("person_id"), F.col("id").cast("string").alias("image_path"))


def test_parallel_inserts(spark):
    """Several writers at a time get consecutive ids of their own, and lose no rows."""
    c = Collection(spark, "shared_people", 2)
    c.recreate()
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda i: c.within(spark.newSession()).insert(rows_of(spark, 10 + i, f"w{i}").repartition(3)), range(6)))
    assert done == [10 + i for i in range(6)]
    rows = c.refreshed().read().collect()
    assert sorted(r.id for r in rows) == list(range(1, sum(done) + 1))
    for i in range(6):
        own = sorted(r.id for r in rows if r.person_id == f"w{i}")
        assert own == list(range(own[0], own[0] + 10 + i))
    assert c.insert(rows_of(spark, 0, "none")) == 0
    c.drop()


def test_batch_is_appended_once(spark):
    c = Collection(spark, "keyed_people", 2)
    c.recreate()
    assert c.insert(rows_of(spark, 5, "a"), key="stream 1") == 5 and c.insert(rows_of(spark, 5, "a"), key="stream 1") == 0
    assert c.read().count() == 5
    # a run that was lost between its rows and its mark is replaced
    ledger = c.ledger()
    ledger.fs.delete(ledger._path(ledger._mark("stream 1")), False)
    assert c.insert(rows_of(spark, 4, "a"), key="stream 1") == 4 and c.read().count() == 4
    assert c.insert(rows_of(spark, 2, "b"), key="stream 2") == 2 and len({r.id for r in c.read().collect()}) == 6
    with pytest.raises(Exception, match="exceeds 256 characters"):
        c.insert(rows_of(spark, 1, "x" * 257))
    assert c.read().count() == 6
    c.drop()
