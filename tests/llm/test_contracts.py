"""The registered queries against plain versions over a whole table."""

import os

import llm_brute as brute
import pytest

from facelake.llm import queries

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_token_counts(spark, docs):
    found = queries.op3_token_counts(spark, SF)
    assert rows(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(brute.token_counts(docs))


def test_decontaminate(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = queries.op4_decontaminate(spark, SF)
    got = rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.decontaminate(docs, items))
    assert any(r[-1] for r in got)


def test_rules(spark, docs):
    found = queries.op6_rules(spark, SF).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == sorted(brute.rules(docs))
    assert not any(r.base_failed and r.kept for r in found)


def test_personal_data(spark, docs):
    found = queries.op7_personal_data(spark, SF).collect()
    own = {r[0]: r for r in brute.personal_data(docs)}
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == sorted(r[:-1] for r in own.values())
    # the method adds spans and keeps the base ones
    assert all(set(filter(None, own[r.doc_id][-1].split(","))) <= set(r.spans.split(",")) for r in found)


def test_token_files(spark, docs):
    assert rows(queries.op8_token_files(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute.token_files(docs))


def test_simhash(spark, docs):
    assert rows(queries.op9_simhash(spark, SF), "doc_id", "fingerprint", "component_id") == sorted(brute.simhash_classes(docs))


def test_sentencepiece(spark, docs):
    own = brute.pieces()
    found = {r.doc_id: r for r in queries.op2_sentencepiece(spark, SF).collect()}
    assert len(found) == len(docs)
    assert all(list(found[d].ids) == own.encode(t or "") for d, t in docs)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found.values())


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_line_dedup(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(queries.op5_line_dedup(spark, sf), "doc_id", "text", "n_lines", "n_removed")
    want = sorted(brute.line_dedup(docs))
    assert got == want and sum(r[3] for r in want) > 0


def test_quality(spark):
    """Documents whose labels training left out are told apart."""
    from pyspark.sql import functions as F

    from facelake.llm import quality

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.pmod(F.xxhash64(F.lit("test"), "doc_id"), F.lit(3)) == 0
    model = quality.train(docs, labels.where(~out))
    judged = quality.classify(docs, model).join(labels.where(out), "doc_id").select("p_bad", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).collect()
    bad, good = [r.p_bad for r in judged if r.bad], [r.p_bad for r in judged if not r.bad]
    assert len(bad) > 10 and len(good) > 10
    better = sum((b > g) + (b == g) / 2 for b in bad for g in good) / len(bad) / len(good)
    assert better > 0.9
    assert sum(g < 0.6 for g in good) >= 0.95 * len(good)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_pages(spark, sf):
    """The generated pages hold their article in one flat element."""
    want = {r.page_id: brute.flat_article(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = queries.op10_html_text(spark, sf).collect()
    assert {r.page_id: r.text for r in found} == want and len(found) == len(want)
    assert all(len(r.text) == r.n_chars for r in found)
