"""Continuous ingest of image folders into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facelake.config import EngineConfig
from facelake.functions.strings import person_id
from facelake.operators.collections import Collection
from facelake.operators.embed import embed
from facelake.sources.images import GLOB, path_of

IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def named(done: DataFrame, base: str) -> DataFrame:
    """Collection rows (embedding, person_id, image_path) of embedded images."""
    ok = done.where("status = 'ok'")
    return ok.select("embedding", person_id(F.col("path"), base).alias("person_id"), F.col("path").alias("image_path"))


def to_rows(images: DataFrame, base: str, model: str, config: EngineConfig, weights: str = "") -> DataFrame:
    """Collection rows (embedding, person_id, image_path) of the images that could be embedded."""
    return named(embed(images, model, config, weights), base)


def stream_folder(spark: SparkSession, folder: str, collection: Collection, model: str, config: EngineConfig, checkpoint: str, weights: str = "") -> StreamingQuery:
    """Appends each new image below folder once; the checkpoint remembers which were seen.

    A micro-batch is keyed by the checkpoint and its number, so that one that is run again after its append adds
    nothing. The batch has a session of its own; the collection's session sees the rows once it is refreshed, which the
    caller's `collection.refreshed()` does.
    """
    files = spark.readStream.format("image").schema(IMAGE).option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(folder)
    images = files.select(
        path_of(F.col("image.origin")).alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"), F.lit("ok").alias("status"),
    )

    def append(batch: DataFrame, number: int) -> None:
        collection.within(batch.sparkSession).insert(to_rows(batch, folder, model, config, weights), key=f"{checkpoint} {number}")

    return images.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
