"""Lines of a template: segments that all of them share are split by what is left, and nothing is lost."""

import random

import llm_brute as brute
import pytest

from facelake.llm import line_dedup


def found(spark, docs, **given):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in line_dedup.dedup_lines(frame, **given).select("doc_id", "text", "n_lines", "n_removed").collect())


def documents(kind, n, seed=1):
    rng = random.Random(seed)
    words = ["template", "of", "a", "numbered", "line", "with", "some", "length"]
    base = "the common part of a line that goes on for long: "

    def line(i):
        if kind == "sequence":
            return f"{base}{100_000 + i} is its number"
        if kind == "ids":
            return f"{base}{rng.randrange(10**10):010d}"
        if kind == "front":
            return f"{rng.randrange(10**8)} {base}"
        if kind == "edited":  # copies of few lines with up to three edits
            own = list(f"{base}{rng.randrange(5)} ends here")
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz", "é"])
            return "".join(own)
        return " ".join(rng.choice(words) for _ in range(4)) + base[: rng.randrange(5, 30)]  # short: few letters left over

    lines = [line(i) for i in range(n)]
    return [(d, "\n".join(lines[d * n // 10 : (d + 1) * n // 10])) for d in range(10)]


@pytest.mark.parametrize("kind,shared", [("sequence", 50), ("ids", 50), ("front", 50), ("edited", 2), ("words", 50)])
def test_against_all_pairs(spark, monkeypatch, kind, shared):
    monkeypatch.setattr(line_dedup, "SHARED_LINES", shared)
    docs = documents(kind, 300)
    assert found(spark, docs) == sorted(brute.line_dedup(docs))


@pytest.mark.parametrize("edits", [1, 3])  # one edit settles nothing beforehand
def test_other_edits(spark, monkeypatch, edits):
    monkeypatch.setattr(line_dedup, "SHARED_LINES", 3)
    docs = documents("edited", 200, seed=edits)
    assert found(spark, docs, max_edits=edits) == sorted(brute.line_dedup(docs, max_edits=edits))


def test_short_residuals(spark, monkeypatch):
    """Lines that differ in their last characters alone, of which little is left after a cut."""
    monkeypatch.setattr(line_dedup, "SHARED_LINES", 2)
    rng = random.Random(4)
    docs = [(d, "\n".join("a line of text " + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 8))) for _ in range(40))) for d in range(6)]
    assert found(spark, docs) == sorted(brute.line_dedup(docs))


def test_many_numbered_lines(spark):
    """Time grows with the lines, not with their pairs: 40,000 lines would have 800 million."""
    text = "\n".join(f"some numbered line of a long template text {100_000 + i}" for i in range(40_000))
    got = found(spark, [(1, text)])
    assert got[0][2] == 40_000 and got[0][3] == 39_999
    assert got[0][1] == "some numbered line of a long template text 100000"


def test_rows_without_an_open_pair_go(spark):
    """Of a key's rows those stay that are in a pair with an index line whose later line is open."""
    rows = [  # key, place, open, own
        (1, 1, False, True), (1, 2, False, False), (1, 3, True, False), (1, 4, False, True),  # 2 and 3 are both probes; 4 comes after 3
        (2, 1, False, True), (2, 2, False, True),  # none is open
        (3, 1, True, True), (3, 1, True, False), (4, 1, True, False), (4, 2, True, False),  # one line; no index line
        (5, 1, True, False), (5, 2, True, True), (5, 3, False, True),
    ]
    frame = spark.createDataFrame([(k, (a, o, a), w) for k, a, o, w in rows], "key long, id struct<short_id: long, open: boolean, at: long>, own boolean")
    assert sorted((r.key, r.id.at, r.n) for r in line_dedup._leading(frame).collect()) == [(1, 1, 4), (1, 3, 4), (5, 1, 3), (5, 2, 3)]
