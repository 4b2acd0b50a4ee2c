"""Co-training against a plain version over whole tables, and what a round of exchange teaches."""

import math

import numpy as np
import pytest

from facelake.llm import quality


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class PlainView:
    def __init__(self):
        self.weights, self.prior, self.slope, self.shift = {}, 0.0, 1.0, 0.0

    def score(self, features):
        return self.prior + sum(self.weights.get(f, 0.0) for f in features)

    def odds(self, features):
        return self.slope * self.score(features) + self.shift


def statistic(n0, n1, c0, c1):
    share, total = (c0 + c1) / (n0 + n1), 0.0
    for c, n in ((c0, n0), (c1, n1)):
        for x, expected in ((c, n * share), (n - c, n * (1 - share))):
            total += x * math.log(x / expected) if x > 0 else 0.0
    return 2 * total


def plain_view(labelled, most=512):
    """A view fitted on (features, label) of all documents."""
    n = [sum(y == k for _, y in labelled) for k in (0, 1)]
    view = PlainView()
    if not all(n):
        return view
    counts = {}
    for features, y in labelled:
        for f in features:
            counts.setdefault(f, [0, 0])[y] += 1
    rated = sorted((-statistic(*n, *c), f) for f, c in counts.items() if sum(c) >= 5)
    chosen = sorted(f for s, f in rated if -s >= 15)[:most] if len(rated) <= most else sorted(f for s, f in rated[:most] if -s >= 15)
    x = np.array([[f in features for f in chosen] for features, _ in labelled], float).reshape(len(labelled), len(chosen))
    w = quality.logistic(x, np.array([y for _, y in labelled], float), ridge=1.0)
    view.weights, view.prior = dict(zip(chosen, w[:-1].tolist(), strict=True)), float(w[-1])
    return view


def plain(rows, rounds, sure):
    """p_bad of each row (id, text, lang, source, n_chars, bad, held)."""
    feats = [(set(quality.text_features(r.text.encode()).tolist()), set(quality.meta_features((r.lang, r.source, r.n_chars)).tolist())) for r in rows]
    limit = math.log(sure / (1 - sure))
    views = [plain_view([(f[v], r.bad) for f, r in zip(feats, rows, strict=True) if r.bad is not None and not r.held]) for v in range(2)]
    for _ in range(rounds):
        new = []
        for v in range(2):
            labelled = []
            for f, r in zip(feats, rows, strict=True):
                if r.bad is not None:
                    if not r.held:
                        labelled.append((f[v], r.bad))
                elif abs(z := views[1 - v].odds(f[1 - v])) >= limit:
                    labelled.append((f[v], int(z > 0)))
            new.append(plain_view(labelled))
        views = new
    held = [(f, r.bad) for f, r in zip(feats, rows, strict=True) if r.bad is not None and r.held]
    y = np.array([b for _, b in held], float)
    for v, view in enumerate(views):
        w = quality.logistic(np.array([[view.score(f[v])] for f, _ in held]), y)
        view.slope, view.shift = w
    w = quality.logistic(np.array([[views[v].odds(f[v]) for v in range(2)] for f, _ in held]), y)
    return {r.id: sigmoid(w[0] * views[0].odds(f[0]) + w[1] * views[1].odds(f[1]) + w[2]) for f, r in zip(feats, rows, strict=True)}


@pytest.mark.parametrize("rounds", [0, 2])
def test_against_plain_version(spark, rounds):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = plain(quality._rows(docs, labels, 200_000).collect(), rounds, 0.99)
    model = quality.train(docs, labels, rounds=rounds, sure=0.99)
    got = {r.doc_id: r.p_bad for r in quality.classify(docs, model).collect()}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-5


def test_a_round_teaches_the_other_view(spark):
    """Labels come with texts that tell nothing; only what the metadata are sure of shows the text view its words."""
    rows = [(i, "plain words of no kind", "en", "ab"[i % 2], 20) for i in range(400)]
    rows += [(1000 + i, ("honest report of work", "cheap pills click")[i % 2], "en", "ab"[i % 2], 20) for i in range(400)]
    rows += [(5000, "honest report of work", "en", "new", 20), (5001, "cheap pills click", "en", "new", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    found = {}
    for rounds in (0, 1):
        model = quality.train(docs, labels, rounds=rounds, sure=0.95)
        found[rounds] = {r.doc_id: r for r in quality.classify(docs, model).where("doc_id >= 5000").collect()}, model
    assert not found[0][1].text.weights.any() and found[1][1].text.weights.any()
    before = found[0][0]
    assert before[5000].p_text == before[5001].p_text
    assert found[1][1].text.score(quality.text_features(b"cheap pills click")) > found[1][1].text.score(quality.text_features(b"honest report of work")) + 1
