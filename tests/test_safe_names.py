"""Names of long texts: as of one name, and in time that follows their length."""

import time

from pyspark.sql import functions as F

from facelake.functions import strings


def test_as_of_one_name(spark):
    names = ["plain name.png", "", None, "caf\u00e9/\u65e5\u672c \ufb01x.png", "\u65e5 \u672c", "\u00bd \u2460\u246a \u2474", "a \u65e5 b", "._x_.", "stra\u00dfe \u01c4", "\U0001f101 \U0001f1e6\u0308e"]
    frame = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {r.id: r.name for r in frame.select("id", strings.secure_filename(F.col("name")).alias("name")).collect()}
    assert got == {i: None if n is None else strings.safe_name(n) for i, n in enumerate(names)}


def test_one_odd_character_in_long_texts(spark):
    """A character without an ASCII form must not send every other one through the table of forms."""
    text = F.concat(F.repeat(F.lit("a long text of words "), 10_000), F.lit("\u65e5"))
    frame = spark.range(40).coalesce(1).select(text.alias("name"))
    frame.limit(1).select(strings.secure_filename(F.col("name")).alias("n")).collect()
    began = time.time()
    found = frame.select(strings.secure_filename(F.concat("name", F.lit("x"))).alias("n")).agg(F.sum(F.length("n"))).collect()
    assert found[0][0] == 40 * 210_001 and time.time() - began < 20
