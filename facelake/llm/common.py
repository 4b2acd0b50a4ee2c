"""What the operators share: table reading, the cluster's shared folder, row preparation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facelake import session
from facelake.session import scratch, stored  # noqa: F401  the operators take them from here

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table below sf_dir; the session's workers get this package's code on the way."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(df: DataFrame, column: str = "text"):
    """The column as a string, null as the empty string."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias(column)


def raw_bytes(array) -> list[bytes]:
    """The UTF-8 bytes of each value of an Arrow string array."""
    import pyarrow as pa

    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()


def spans_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


#: Rows of an Arrow batch at most: a worker holds a batch several times over, as columns and as objects.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers and bounds the batches that they get by BATCH_ROWS
    where the session allows more."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    session.ship(spark)
