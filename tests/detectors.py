"""A stand-in for a detector."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from facelake.operators.faces import FACE, REFERENCE


def arrow_face():
    """FACE as an Arrow type."""
    import pyarrow as pa

    return pa.struct([("box", pa.list_(pa.float64())), ("landmarks", pa.list_(pa.list_(pa.float64()))), ("score", pa.float64())])


def bright_detector(images: DataFrame, least: float = 0.3) -> DataFrame:
    """images with `faces`, a detector backend without weights: an image whose mean brightness is `least` of the
    greatest or more is one face of its own size, scored by the brightness."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n in ("height", "width", "data", "status")}
            out = []
            for height, width, data, status in zip(col["height"], col["width"], col["data"], col["status"], strict=True):
                score = float(np.frombuffer(data, np.uint8).mean()) / 255 if status == "ok" and data else 0.0
                marks = [[x * width / 112, y * height / 112] for x, y in REFERENCE]
                out.append([{"box": [0.0, 0.0, float(width), float(height)], "landmarks": marks, "score": score}] if score >= least else [])
            yield pa.record_batch([*batch.columns, pa.array(out, pa.list_(arrow_face()))], names=[*batch.schema.names, "faces"])

    schema = T.StructType([*images.drop("faces").schema.fields, T.StructField("faces", T.ArrayType(FACE))])
    return images.drop("faces").mapInArrow(run, schema)
