"""From images to embeddings: align or resize, normalise, run the network, with or without the flipped image."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facelake.config import EngineConfig
from facelake.functions.layers import REGISTRY
from facelake.operators import faces

#: A function from tensors (n, 3, size, size) to values (n, d) by name.
Network = Callable[[np.ndarray], dict[str, np.ndarray]]


#: Bytes of tensors that a task holds at a time where nothing else bounds them.
PIECE = 1 << 23


def select_face(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """rows with `face` chosen from `faces`, `num_faces`, and status no_face where detection finds none."""
    if not config.face_detection or "faces" not in rows.columns:
        return rows.withColumns({"face": F.lit(None).cast(faces.FACE), "num_faces": F.lit(None).cast("int")})
    found = faces.usable(F.col("faces"), config.confidence)
    rows = rows.withColumn("num_faces", F.coalesce(F.size(found), F.lit(0)))
    chosen = faces.largest(found) if config.select_largest else faces.most_confident(found)
    with_face = rows.withColumn("face", chosen)
    missing = (F.col("status") == "ok") & F.col("face").isNull()
    return with_face.withColumn("status", F.when(missing, "no_face").otherwise(F.col("status")))


def _decoded(batch, size: int, reference: np.ndarray):
    """(tensors, whether they were aligned, statuses) of rows (row, height, width, channels, data, marks, status)."""
    from facelake.functions import images as im

    out, aligned, states = [], [], []
    for height, width, channels, data, points, status in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
        tensor, moved = None, False
        if status == "ok":
            try:
                image = im.from_row(height, width, channels, data)
                matrix = im.fit_similarity(np.array(points, float), reference) if points else None
                moved = matrix is not None and bool(np.isfinite(matrix).all())
                if moved:
                    image = im.warp(image, matrix, size)
                elif image.shape[:2] != (size, size):
                    image = im.resize(image, size, size)
                tensor = im.to_tensor(image)
            except (ValueError, IndexError, TypeError, np.linalg.LinAlgError):
                status, moved = "decode_error", False
        out.append(tensor)
        aligned.append(moved)
        states.append(status)
    return out, aligned, states


def inferred(images: DataFrame, size: int, make: Callable[[], Network], outputs: dict[str, T.DataType], batch: int = 64, landmarks: str | None = None) -> DataFrame:
    """images (.., height, width, channels, data, status) with a network's `outputs`, arrays of numbers by name, and `was_aligned` in
    place of the image; null outputs and decode_error where it cannot be decoded.

    make builds a function from tensors (n, 3, size, size) to values (n, d) by name. A tensor is some thousand times larger than
    what a row is else, so images are decoded and go through the network `batch` at a time, and no tensor leaves the task.
    landmarks: a column of five points that are moved to a face's reference points; where it is null, or its points
    coincide, the whole image is resized.
    """
    keep = [c for c in images.columns if c not in ("data", "height", "width", "channels", "was_aligned", "status", *outputs)]
    marks = F.col(landmarks) if landmarks else F.lit(None).cast("array<array<double>>")
    # an empty struct cannot be sent, so the status goes along
    rows = images.select(F.struct(*keep, "status").alias("row"), "height", "width", "channels", "data", marks.alias("marks"), "status")
    reference = np.array(faces.reference_points(size))
    schema = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), *(T.StructField(n, T.ArrayType(t)) for n, t in outputs.items()),
        T.StructField("was_aligned", T.BooleanType()), T.StructField("status", T.StringType()),
    ])

    def run(batches):
        import pyarrow as pa

        network = make()
        kinds = {n: pa.float32() if isinstance(t, T.FloatType) else pa.float64() for n, t in outputs.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                decoded, aligned, states = _decoded(part, size, reference)
                seen = [x for x in decoded if x is not None]
                found = network(np.stack(seen)) if seen else {}
                columns = [part.column(0)]
                for name, kind in kinds.items():
                    values = iter(np.asarray(found.get(name, ())).astype(kind.to_pandas_dtype()))
                    columns.append(pa.array([None if x is None else next(values) for x in decoded], pa.list_(kind)))
                yield pa.record_batch([*columns, pa.array(aligned, pa.bool_()), pa.array(states, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in keep], "status", *outputs, "was_aligned")


def tensors(images: DataFrame, size: int, landmarks: str | None = None) -> DataFrame:
    """images (.., height, width, channels, data, status) with `tensor`, channels first, and `was_aligned` in place of the
    image; a null tensor and decode_error where it cannot be decoded. landmarks: as of `inferred`."""
    batch = max(1, PIECE // (12 * size * size))
    return inferred(images, size, lambda: lambda x: {"tensor": x.reshape(len(x), -1)}, {"tensor": T.FloatType()}, batch, landmarks)


def embedder(context, model: str, weights: str, use_tta: bool) -> Callable[[], Network]:
    """A registered model for `inferred`, as `embedding`; a worker builds it once. With test-time augmentation the mirrored image goes
    through it as well, and its vector follows the image's."""
    build = REGISTRY.builder(context, model, weights)

    def make() -> Network:
        network = build()

        def predict(x: np.ndarray) -> dict[str, np.ndarray]:
            found = network(x)
            return {"embedding": np.concatenate([found, network(np.ascontiguousarray(x[..., ::-1]))], axis=1) if use_tta else found}

        return predict

    return make


def embed(images: DataFrame, model: str, config: EngineConfig, weights: str = "", batch: int = 64) -> DataFrame:
    """images (path, height, width, channels, data, status, optionally faces) with embedding, was_aligned, and the
    face that was taken (`face_box`, `face_score`) of `num_faces`.

    Rows whose status is not ok keep a null embedding; a bad image never ends the job, an unknown model does
    before it starts. Images are decoded once.
    """
    rows = select_face(images, config)
    network = embedder(images.sparkSession.sparkContext, model, weights, config.use_tta)
    rows = rows.withColumns({"face_box": F.col("face.box"), "face_score": F.col("face.score"), "landmarks": F.col("face.landmarks")})
    shaped = rows.select(*[c for c in rows.columns if c not in ("faces", "face", "embedding", "was_aligned")])
    sized = ("height", "width", "channels")
    kept = shaped.withColumn("shape", F.struct(*sized))
    done = inferred(kept, config.image_size, network, {"embedding": T.FloatType()}, batch, "landmarks")
    fields = [F.col("shape").getField(c).alias(c) if c in sized else F.col(c) for c in shaped.columns if c not in ("data", "landmarks", "status")]
    return done.select(*fields, "embedding", "was_aligned", "status")
