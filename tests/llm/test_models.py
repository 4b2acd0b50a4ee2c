"""Unigram lattices against all segmentations, and long words of the BPE fold against the library."""

import itertools
import random

import llm_brute as brute
import numpy as np
import pytest

from facelake.llm import spm_lattice
from facelake.llm.piece_merges import Merges

SCORES = {"▁": -3.1, "a": -2.0, "b": -2.3, "c": -4.0, "ab": -2.7, "bc": -5.1, "abc": -5.0, "▁a": -2.9, "▁ab": -6.0, "ca": -3.3, "aa": -4.4, "cab": -4.9}


@pytest.fixture
def unigram(monkeypatch):
    pieces = {p: (i + 3, s) for i, (p, s) in enumerate(SCORES.items())}
    model = spm_lattice.Model("unigram", pieces, ["<unk>", "<s>", "</s>", *SCORES], [], 0, spm_lattice.WORDS, max(map(len, pieces)))
    monkeypatch.setattr(spm_lattice, "load", lambda name: model)
    return model


def best(word, model):
    """The ids of the segmentation with the greatest sum, over all of them."""
    lowest = min(SCORES.values()) - 10
    found = []
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(p in SCORES or len(p) == 1 for p in parts):
            found.append((sum(SCORES.get(p, lowest) for p in parts), [model.pieces[p][0] if p in SCORES else 0 for p in parts]))
    return max(found)[1]


def test_unigram_lattice(spark, unigram):
    rng = random.Random(3)
    words = sorted({"▁" + "".join(rng.choice("aabbccx") for _ in range(rng.randrange(1, 10))) for _ in range(150)})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: list(r.ids) for r in spm_lattice.encode_words(frame, "toy").collect()}
    want = {w: best(w, unigram) for w in words}
    assert got == want and {w: spm_lattice.best_path(w, unigram) for w in words} == want


def test_bpe_lattice_is_the_fold(spark):
    """The relational lattice, the matrix fold, the heap fold and the library agree."""
    rng = random.Random(4)
    own, kind = brute.pieces(), np.dtype("<u2")
    words = ["▁" + "".join(rng.choice("etaoinshrdluéß日12.,") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    merges = spm_lattice.merges("piece_bpe_32k.model")
    got = {r.word: list(r.ids) for r in spm_lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    for w, packed in zip(words, merges.fold(words, kind), strict=True):
        want = own.encode(w[1:])
        assert got[w] == want == np.frombuffer(packed, kind).tolist() == np.frombuffer(merges._ids(w, merges._long(w), kind), kind).tolist()


def test_long_words():
    own, merges = brute.pieces(), spm_lattice.merges("piece_bpe_32k.model")
    for word in ("a" * 5000, "thing" * 3000, "é日本" * 2000, "ab" * 40 + "\0" + "x" * 90):
        assert np.frombuffer(merges.fold(["▁" + word], np.dtype("<u2"))[0], "<u2").tolist() == own.encode(word)


def test_equal_priorities_go_from_left_to_right():
    pieces = {p: (i, s) for i, (p, s) in enumerate({"a": 0.0, "b": 0.0, "ab": -1.0, "ba": -1.0, "aba": -2.0}.items())}
    merges = Merges(pieces, 5, [], 9)
    for word, want in (("abab", [2, 2]), ("baba", [3, 3]), ("babax", [3, 3, 9])):
        assert np.frombuffer(merges.fold([word], np.dtype("<u2"))[0], "<u2").tolist() == want
