"""Near copies against brute force over pairs of any similarity from 0.5 on."""

import random

import pytest

import corpus_pipeline
from facelake.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["w%d" % rng.randrange(10**6) for _ in range(n)]


def spread(rng, text, edits):
    """The words with so many replaced, evenly over the text."""
    out = list(text)
    for k in range(edits):
        out[int((k + rng.random()) * len(out) / edits)] = "e%d" % rng.randrange(10**6)
    return out


def similarity(a, b):
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def stage(spark, texts, ids=None):
    texts = list(texts)
    rows = [(i, t, "en", "a", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return corpus_pipeline.by_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(7)
    return [(t := words(rng, rng.randrange(80, 400)), spread(rng, t, max(1, round(len(t) * rng.uniform(0.01, 0.06))))) for _ in range(800)]


def test_edits_spread_over_the_text(spark, pairs):
    """Pairs at 0.8 or more are found, from 0.8 to 0.85 too, and no others."""
    kept = {r.doc_id for r in stage(spark, [" ".join(t) for p in pairs for t in p]).collect()}
    near = [similarity(*p) >= 0.8 for p in pairs]
    just = [k for k, p in enumerate(pairs) if 0.8 <= similarity(*p) < 0.85]
    assert len(just) > 50 and 100 < sum(near) < 700
    assert sum(2 * k + 1 not in kept for k in just) >= 0.99 * len(just)
    assert all((2 * k + 1 not in kept) <= near[k] and 2 * k in kept for k in range(len(pairs)))


def test_large_family_in_blocks(spark, pairs, monkeypatch):
    monkeypatch.setattr(near_copies, "FAMILY", 2000)
    rng = random.Random(1)
    base = words(rng, 200)
    texts = [" ".join(spread(rng, base, 1 + (i > 0))) for i in range(60)]
    assert [r.doc_id for r in stage(spark, texts).collect()] == [0]


def test_template_family_stays(spark):
    """Different texts that share a long passage, at 0.5 to 0.7 of each other, all stay."""
    rng = random.Random(3)
    passage = words(rng, 200)
    texts = [passage + words(rng, rng.randrange(50, 80)) for _ in range(300)]
    assert 0.5 < similarity(texts[0], texts[1]) < 0.75
    assert stage(spark, map(" ".join, texts), range(300)).count() == 300


def test_rows_go_by_themselves(spark):
    """A copy goes, and no other row of its doc_id; repeats of a row and copies without doc_id go too."""
    rng = random.Random(4)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    found = stage(spark, [a, a, b, b, c, c, d, None, " "], [1, 2, 2, None, 3, 3, None, None, 9]).collect()
    assert sorted((r.text, r.doc_id) for r in found) == sorted([(a, 1), (b, 2), (c, 3), (d, None), (" ", 9)])
