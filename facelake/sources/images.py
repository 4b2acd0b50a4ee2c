"""Listing and decoding image files with Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facelake.session import stored

GLOB = "*.{jpg,JPG,jpeg,JPEG,png,PNG,bmp,BMP,tiff,TIFF}"


def list_images(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(path, modificationTime, length) of the images below a folder, by path components; limit 0 or None: all."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(folder).drop("content")
    )
    ordered = found.orderBy(F.split("path", "/"))
    return ordered.limit(limit) if limit else ordered


def path_of(origin: Column) -> Column:
    """An image's path in the form that listings have."""
    return F.regexp_replace(origin, "^file:/+", "file:/")


def one_source(*sources: Column) -> Column:
    """Whether exactly one of an image's sources is given."""
    return sum((s.isNotNull().cast("int") for s in sources), F.lit(0)) == 1


def read_images(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """(path, height, width, channels, data, status): decoded images below a folder, or those of some paths; status
    decode_error for broken ones."""
    rows = (
        spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(folder)
    )
    i = F.col("image")
    return rows.select(
        path_of(i["origin"]).alias("path"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"),
        F.when(i["height"] < 1, "decode_error").otherwise("ok").alias("status"),
    )


def write_drawn(images: DataFrame, folder: str) -> DataFrame:
    """Writes images (.., path, height, width, channels, data, status, faces) with their faces drawn, as PNG files
    below a folder that the executors share, and returns (path, file, num_faces) of those written."""

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        from facelake.functions import images as im

        filesystem, base = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for path, height, width, channels, data, status, faces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if status != "ok":
                    continue
                image = im.from_row(height, width, channels, data)
                faces = [f for f in faces or [] if f["box"]]
                drawn = im.draw(np.ascontiguousarray(image), [f["box"] for f in faces], [f["landmarks"] or [] for f in faces], [1.0 if f["score"] is None else f["score"] for f in faces])
                file = f"{uuid.uuid4().hex}.png"
                with filesystem.open_output_stream(f"{base}/{file}") as stream:
                    stream.write(im.png(drawn))
                out.append((path, file, len(faces)))
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], names=["path", "file", "num_faces"])

    written = images.select("path", "height", "width", "channels", "data", "status", "faces").mapInArrow(run, "path string, file string, num_faces int")
    return stored(written, "drawn")  # the files are written once
