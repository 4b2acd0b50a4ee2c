"""What the digest cache holds, and what another version or normalisation does to it."""

import random

import llm_brute as brute
import pytest
from pyspark.sql import functions as F

from facelake.llm import token_counts
from facelake.llm.common import scratch

TEXTS = ["one two", None, "", "three  Four", "one two", "é日本 x"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def counts(df):
    return {r.id: r.n_tokens for r in df.collect()}


def cached(spark, path):
    return spark.read.parquet(path)


def test_a_warm_cache_is_used(spark, docs):
    path, want = scratch(spark, "cache"), {d: n for d, _, n, _ in brute.token_counts(list(enumerate(TEXTS)))}
    assert counts(token_counts.token_counts(docs, path)) == want
    assert cached(spark, path).count() == 4  # null counts as empty
    assert counts(token_counts.token_counts(docs, path)) == want and cached(spark, path).count() == 4
    # a hit comes from the cache, whatever it says
    planted = cached(spark, path).withColumn("n_tokens", F.col("n_tokens") + 100)
    other = scratch(spark, "cache")
    planted.write.parquet(other)
    more = docs.unionByName(spark.createDataFrame([(99, "new text"), (None, "new text")], docs.schema))
    got = counts(token_counts.token_counts(more, other))
    assert {k: v for k, v in got.items() if k in want} == {k: v + 100 for k, v in want.items()}
    assert got[99] == got[None] == len(brute.pieces().encode("new text")) and cached(spark, other).count() == 5


def test_another_version_misses(spark, docs):
    path = scratch(spark, "cache")
    first = counts(token_counts.token_counts(docs, path))
    second = counts(token_counts.token_counts(docs, path, "byte_bpe_50k.json"))
    assert first != second and cached(spark, path).count() == 8 and cached(spark, path).select("tokenizer").distinct().count() == 2
    assert counts(token_counts.token_counts(docs, path)) == first


def test_normalised_content_is_what_counts(spark, docs):
    path = scratch(spark, "cache")
    got = counts(token_counts.token_counts(docs, path, normalise=F.lower))
    assert got[3] == len(brute.pieces().encode("three  four"))


def test_a_hot_digest(spark, monkeypatch):
    rows = [(i if i % 2 else None, "the same text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 3300)]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark, "cache"))
    own = brute.pieces()
    assert got.count() == 3300
    assert {(r.n_bytes, r.n_tokens) for r in got.where("n_bytes = 13").collect()} == {(13, len(own.encode("the same text")))}
    assert got.where("n_tokens is null").count() == 0


def test_a_broken_cache_is_an_error(spark, docs, tmp_path):
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        token_counts.token_counts(docs, str(tmp_path / "cache")).collect()


def test_warm_cache_moves_no_text(spark, tmp_path, monkeypatch):
    """What a second run writes to shuffles doesn't grow with the texts; many misses give the same counts."""
    rows = [(i, f"document {i} " + "with a long text " * 500) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cache = str(tmp_path / "cache")
    monkeypatch.setattr(token_counts, "FEW_MISSES", 0)
    cold = {r.id: r.n_tokens for r in token_counts.token_counts(docs, cache).collect()}
    monkeypatch.undo()
    status = spark.sparkContext._jsc.sc().statusStore()

    def written():
        gateway = spark.sparkContext._gateway
        stages = status.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = written()
    warm = {r.id: r.n_tokens for r in token_counts.token_counts(spark.read.parquet(path), cache).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert warm == cold and written() - before < 300 * 2000 < sum(len(t) for _, t in rows) / 4


def test_a_cold_cache_moves_texts_in_proportion(spark, tmp_path):
    """Small and large tables take the same way where all is missing, so that shuffles grow as the texts do."""
    status = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        gateway = spark.sparkContext._gateway
        stages = status.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    def run(n):
        rng = random.Random(n)
        rows = [(i, "".join(rng.choices("abcdefghij klmnop", k=8000))) for i in range(n)]
        path = str(tmp_path / f"docs-{n}")
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
        before = written()
        token_counts.token_counts(spark.read.parquet(path), str(tmp_path / f"cache-{n}")).collect()
        return written() - before

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_counts, "FEW_MISSES", 300)
        small, large = run(200), run(1000)
    assert 3.5 * small < large < 7 * small
