"""Weights of networks as a table (name, shape, values), read from checkpoints and shipped to the workers.

A checkpoint is a Parquet table (path array<string>, shape array<int>, values array<float>) or a numpy archive (.npz) whose
names have a slash where a checkpoint is nested. What training wrote around the weights is taken off: they are what lies below `model`,
else below `state_dict`, else the whole; parallel training's "module." goes from the names.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "path array<string>, shape array<int>, values array<float>"
#: The containers that are looked for, in this order.
WRAPPERS = ("model", "state_dict")
#: Bytes of weights that may be shipped; they pass the driver, as a network's file does.
MOST_BYTES = 4 << 30


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a checkpoint, as they are stored."""
    from pyspark.errors import AnalysisException

    def entries(batches):
        import io

        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    for name in archive.files:  # an entry at a time
                        value = archive[name]
                        yield pa.record_batch(
                            [pa.array([name.split("/")]), pa.array([list(value.shape)], pa.list_(pa.int32())), pa.array([value.astype(np.float32).ravel()], pa.list_(pa.float32()))],
                            names=["path", "shape", "values"],
                        )

    try:
        if path.endswith(".npz"):
            return spark.read.format("binaryFile").load(path).select("content").mapInArrow(entries, ENTRIES)
        return spark.read.schema(ENTRIES).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no weights at {path}") from None
        raise


def unwrapped(entries: DataFrame) -> DataFrame:
    """(name, shape, values) of a checkpoint's weights."""
    first = F.when(F.size("path") > 1, F.get("path", F.lit(0)))
    found = {r[0] for r in entries.select(first).where(first.isin(*WRAPPERS)).distinct().collect()}  # two names at most
    wrapper = next((w for w in WRAPPERS if w in found), None)
    if wrapper:
        entries = entries.where(first == wrapper).withColumn("path", F.slice("path", 2, F.size("path")))
    name = F.replace(F.array_join("path", "."), F.lit("module."), F.lit(""))
    return entries.select(name.alias("name"), "shape", "values")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(name, shape, values) of a checkpoint; a missing one is an error at once."""
    return unwrapped(read_entries(spark, path))


def checked(weights: DataFrame, wanted: Mapping[str, Sequence[int]]) -> DataFrame:
    """weights, if they are just those that a network wants, of its shapes; else an error that lists what is wrong."""
    spark = weights.sparkSession
    asked = spark.createDataFrame([(n, list(s)) for n, s in wanted.items()], "name string, wanted array<int>")
    both = asked.join(weights.select("name", "shape"), "name", "full").where(~F.col("wanted").eqNullSafe(F.col("shape")))
    wrong = [f"{r['name']}: wanted {r.wanted}, found {r.shape}" for r in both.orderBy("name").limit(20).collect()]
    if wrong:
        raise ValueError("weights do not fit the network: " + "; ".join(wrong))
    return weights


def ship_weights(weights: DataFrame, name: str, most_bytes: int = MOST_BYTES) -> str:
    """Sends weights to all workers as one file of the session; returns the name that load_weights takes."""
    size = weights.agg(F.coalesce(F.sum(F.size("values").cast("long")), F.lit(0))).first()[0] * 4
    if size > most_bytes:
        raise ValueError(f"{size} bytes of weights exceed {most_bytes}")
    folder = tempfile.mkdtemp(prefix="facelake-weights-")  # where addFile reads it; the workers fetch it from the driver
    file = os.path.join(folder, f"{name}.npz")
    np.savez(file, **{r["name"]: np.array(r["values"], np.float32).reshape(r["shape"]) for r in weights.toLocalIterator()})
    weights.sparkSession.sparkContext.addFile(file)
    return os.path.basename(file)


def load_weights(file: str) -> dict[str, np.ndarray]:
    """Shipped weights by name, in a worker."""
    with np.load(SparkFiles.get(file), allow_pickle=False) as archive:
        return {n: archive[n] for n in archive.files}
