"""The digest index against a plain dictionary; filters that overflow, shards that double, lost runs."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from facelake.llm import cuckoo, queries
from facelake.llm.common import scratch


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).digest()


def plain(rows):
    groups = defaultdict(list)
    for place, (i, text) in enumerate(rows):
        groups[digest(text)].append((i is None, i or 0, place))
    out = []
    for place, (i, text) in enumerate(rows):
        group = sorted(groups[digest(text)])
        out.append((i, None if group[0][0] else group[0][1], len(group), (i is None, i or 0, place) == group[0], digest(text).hex()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op13_exact_dedup(spark, "/root/testdata/sf0.001")
    assert got(found.withColumnRenamed("doc_id", "id")) == plain(rows) and any(not r.kept for r in found.collect())


ODD = [(5, "a b"), (3, "a \t\n b"), (3, "a b"), (None, "a b"), (1, None), (2, ""), (None, "x"), (None, "x"), (7, "é日本 " * 50_000), (8, "é日本 " * 50_000), (9, " "), (4, "a b")]


def test_odd_rows(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1).withColumns({c: F.lit("x") for c in ("id", "at", "digest", "first", "n", "shard", "hit")})
    assert got(cuckoo.deduplicate(frame, scratch(spark, "index"))) == plain(ODD)
    assert cuckoo.deduplicate(frame.where("false"), scratch(spark, "index")).collect() == []


def state(index):
    """(digest, n, first id) of the live digests, from log and content, which must agree."""
    log = index.log().groupBy("digest").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    columns = ("digest", "n", F.col("first.id"))
    by_log, by_content = (sorted((bytes(r[0]), r[1], r[2]) for r in df.select(*columns).collect()) for df in (log, index.content()))
    assert by_log == by_content
    return by_content


def held(index):
    """The number of fingerprints in the filters, and how many buckets the largest has."""
    tables = [cuckoo.table_of(r["filter"]) for r in index.filters().collect()]
    return sum(int((t > 0).sum()) for t in tables), max(map(len, tables), default=0)


def test_batches(spark, monkeypatch):
    rng = random.Random(5)
    folder = scratch(spark, "index")
    live: list[tuple[int, str]] = []
    monkeypatch.setattr(cuckoo, "LEAST_SHARDS", 2)
    for turn in range(4):
        index = cuckoo.CuckooIndex(spark, folder, buckets=1)  # opened again each time
        batch = [(rng.randrange(10_000), f"text {rng.randrange(400)}") for _ in range(300)]
        if turn == 2:
            monkeypatch.setattr(cuckoo, "SHARD_KEYS", 50)  # shards double, filters are built again
        index.insert(index.rows(spark.createDataFrame(batch, "doc_id long, text string")))
        live += batch
        gone = rng.sample(live, 120) + [(99_999, "text 1"), (1, "never there")]
        index.delete(spark.createDataFrame(gone, "doc_id long, text string"))
        live = [r for r in live if r not in set(gone)]
        want = defaultdict(list)
        for i, text in live:
            want[digest(text)].append(i)
        assert state(index) == sorted((d, len(v), min(v)) for d, v in want.items())
        number, largest = held(index)
        assert number == len(want) and largest > 1
        asked = spark.createDataFrame([(digest(f"text {i}"),) for i in range(450)], "digest binary")
        assert {bytes(r.digest): (r.n, r["first"].id) for r in index.find(asked).collect()} == {d: (len(v), min(v)) for d, v in want.items()}
    assert index.state["shards"] >= 8


def test_lost_run(spark):
    """Files of a run that ended before its state was written are not read."""
    index = cuckoo.CuckooIndex(spark, scratch(spark, "index"))
    rows = index.rows(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    index.insert(rows)
    lost = cuckoo.CuckooIndex(spark, index.folder)
    lost._write(lost.rows(spark.createDataFrame([(2, "b")], "doc_id long, text string")), "log")
    again = cuckoo.CuckooIndex(spark, index.folder)
    again.insert(again.rows(spark.createDataFrame([(3, "a")], "doc_id long, text string")))
    assert state(again) == [(digest("a"), 2, 1)]


@pytest.mark.parametrize("load", [0.5, 0.9])
def test_filter(load):
    buckets = 1024
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(int(load * buckets * cuckoo.SLOTS))]
    table = np.zeros((buckets, cuckoo.SLOTS), "<u2")
    own = cuckoo.fingerprints(digests, buckets)
    assert cuckoo.add(table, *own) and cuckoo.holds(table, *own).all() and int((table > 0).sum()) == len(digests)
    others = cuckoo.fingerprints([hashlib.sha256(f"x{i}".encode()).digest() for i in range(100_000)], buckets)
    assert cuckoo.holds(table, *others).mean() < 0.001
    half = len(digests) // 2
    cuckoo.drop(table, own[0][:half], own[1][:half])
    assert int((table > 0).sum()) == len(digests) - half and cuckoo.holds(table, own[0][half:], own[1][half:]).all()
    with pytest.raises(ValueError, match="not in its filter"):
        cuckoo.drop(np.zeros((4, cuckoo.SLOTS), "<u2"), *cuckoo.fingerprints(digests[:1], 4))
    small = np.zeros((buckets // 4, cuckoo.SLOTS), "<u2")
    assert not cuckoo.add(small, *cuckoo.fingerprints(digests * 3, buckets // 4))
    assert len(cuckoo.built(digests, 1)) in (512, 1024, 2048)
