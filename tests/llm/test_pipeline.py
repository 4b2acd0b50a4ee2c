"""The stages of the pipeline against plain versions of their decisions, each on what its predecessor kept."""

from itertools import combinations

import llm_brute as brute
import pytest

import corpus_pipeline
from facelake.llm.common import LOWER, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents that enter each stage, and what the last returns."""
    folder = tmp_path_factory.mktemp("stages")
    now, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append([r.asDict() for r in now.collect()])
        stage(spark, now, SF).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
    return [*out, [r.asDict() for r in now.collect()]]


def test_columns(stages):
    assert all(set(r) == set(corpus_pipeline.COLUMNS) for kept in stages[1:-1] for r in kept)


def test_quality_keeps_good_documents(spark, stages):
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 0 or r.toxic == 1}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()} - bad
    kept = {r["doc_id"] for r in stages[1]}
    assert len(kept & good) >= 0.9 * len(good) and len(kept) < len(stages[0])


def test_lines(stages):
    want = {(d, t) for d, t, _, removed in brute.line_dedup([(r["doc_id"], r["text"]) for r in stages[1]]) if not removed or t.strip()}
    assert {(r["doc_id"], r["text"]) for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near_duplicates(stages):
    """Exactly the pairs at a Jaccard of 0.8 or more of five-word shingles link, over all pairs."""

    def shingles(text):
        words = (text or "").encode().translate(LOWER).split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[2]}

    def linked(a, b):
        if not a or not b:
            return a == b
        return min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)

    links = [(a, b) for a, b in combinations(sets, 2) if linked(sets[a], sets[b])]
    assert links and {r["doc_id"] for r in stages[3]} == set(brute.classes(sets, links).values())


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute.decontaminate([(r["doc_id"], r["text"]) for r in stages[3]], items) if r[-1]}
    assert {r["doc_id"] for r in stages[4]} == {r["doc_id"] for r in stages[3]} - hit


def test_pieces(stages):
    own = brute.pieces()
    assert {r["doc_id"] for r in stages[5]} == {r["doc_id"] for r in stages[4]}
    assert all(list(r["ids"]) == own.encode(r["text"]) and r["n_tokens"] == len(r["ids"]) for r in stages[5])
