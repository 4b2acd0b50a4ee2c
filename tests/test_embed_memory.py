"""What embedding holds at a time."""

import threading
import time

import numpy as np
import psutil
from pyspark.sql import functions as F

from facelake.config import EngineConfig
from facelake.functions.layers import REGISTRY
from facelake.operators.embed import embed


class Watch(threading.Thread):
    """The most MB that one of this process's Python workers has meanwhile."""

    def __init__(self):
        super().__init__(daemon=True)
        self.most, self.over = 0.0, False

    def run(self):
        while not self.over:
            for p in psutil.Process().children(recursive=True):
                try:
                    if "java" not in p.name():
                        self.most = max(self.most, p.memory_info().rss / 2**20)
                except psutil.Error:
                    pass
            time.sleep(0.05)


def counted(_):
    """A network that gives the number of its images as the vector."""
    return lambda x: np.full((len(x), 1), len(x))


def test_tensors_are_held_a_batch_at_a_time(spark):
    """4,000 images are 600 MB of tensors; rows that cannot be decoded come back without a vector."""
    REGISTRY.register("counted", counted)
    image = F.unhex(F.lpad(F.hex("id"), 128, "0"))
    rows = spark.range(4000).coalesce(1).select(
        F.col("id").cast("string").alias("path"), F.lit(8).alias("height"), F.when(F.col("id") % 1000 == 7, 9).otherwise(8).alias("width"),
        F.lit(1).alias("channels"), image.alias("data"), F.lit("ok").alias("status"),
    )
    watch = Watch()
    watch.start()
    found = embed(rows, "counted", EngineConfig(face_detection=False, use_tta=False), batch=32).select("path", "status", F.col("embedding").alias("e")).collect()
    watch.over = True
    bad = {r.path for r in found if r.status == "decode_error"}
    assert len(found) == 4000 and bad == {"7", "1007", "2007", "3007"} == {r.path for r in found if r.e is None}
    assert max(r.e[0] for r in found if r.e) <= 32
    assert watch.most < 500
