"""What the quality views are fitted on."""

from facelake.llm import quality


def test_pseudo_labels_thin_no_labels(spark, monkeypatch):
    """The metadata tell the label and the texts nothing: the text view gets many pseudo-labels, the other none."""
    rows = [(i, "same text here", "en", "ab"[i % 2], 14) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    fitted, own = [], quality.logistic
    monkeypatch.setattr(quality, "logistic", lambda x, y, **more: (fitted.append(len(y)), own(x, y, **more))[1])
    quality.train(docs, labels, rounds=1, sure=0.9, max_fit=400)
    # text and metadata in the first fit, then in the second
    usable = fitted[0]
    assert 250 < usable < 400 and fitted[1] == usable
    assert usable + 250 < fitted[2] < usable + 550  # labels and about max_fit pseudo-labels
    assert fitted[3] == usable


def test_packed_features_fit_alike():
    """Features as bits give the weights of features as numbers, and few rows are held as floats at a time."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    x = (rng.random((9000, 203)) < 0.1).astype(np.uint8)
    y = (rng.random(9000) < 1 / (1 + np.exp(1.0 - x[:, :9].sum(axis=1)))).astype(float)
    want, packed = quality.logistic(x, y, 1.0), np.packbits(x, axis=1)
    tracemalloc.start()
    got = quality.logistic(packed, y, 1.0, bits=203)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want, atol=1e-9) and most < 8e6
