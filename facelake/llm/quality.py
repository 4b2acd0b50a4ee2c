"""Quality classifier by co-training of a text view and a page-metadata view.

Each view is a logistic regression over hashed binary features: prefixes of the text's words and
measures of its style, or language, source and length. Features are worked out once and written. In a
round each view's confident predictions on unlabelled documents become labels for the other view. The
features with the most significant association are chosen from counts over all labelled and
pseudo-labelled documents, added up per task and then per feature; their weights are fitted on a bounded
sample of the labelled documents and one of the view's pseudo-labelled ones, each drawn for itself, so
that pseudo-labels thin no labels. At the end the views are calibrated and combined on labelled documents
that no round has learned from, and score all documents.

A document is bad if it is labelled as of low quality or as toxic. Labels are a bounded sample:
about `max_labels` of them at most, drawn by a hash of doc_id, are sent to the tasks. Only the chosen
features and the bounded samples reach the driver.

Defined results: null, empty and blank texts have no word features; very long texts are read whole;
unknown or missing metadata is a value of its own; several labels of a document count as bad if one is;
null labels and labels of other documents are ignored; equal scores are equal probabilities; without both
kinds of labels nothing can be learned and every document is kept with probability 0; repeated rows stay
repeated; an empty table gives an empty result. Columns of the input that are called p_text, p_meta, p_bad
or keep give way to the new ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facelake.llm.common import raw_bytes, stored, text_column

BITS = 18
SIZE = 1 << BITS
#: Lengths in bytes of the word prefixes that are features.
PREFIXES = (6, 5, 4)
SYMBOLS = b"#*$%&|<>"
SHARES = np.array([0.0, 0.01, 0.05, 0.2, 0.5])
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_ASCII_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def _hashed(names) -> np.ndarray:
    return np.unique(np.fromiter(map(crc32, names), np.int64) & (SIZE - 1))


def text_features(text: bytes) -> np.ndarray:
    """The hashed features of a text's words and style."""
    names = {w[: PREFIXES[0]] for w in text.translate(_LETTERS).split()}
    every = set(names)
    for n in PREFIXES[1:]:
        names = {w[:n] for w in names}
        every |= names
    words = text.split()
    n = max(1, len(words))
    letters = max(1, len(text.translate(None, _ASCII_LETTERS)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = (
        (len(text) - len(text.translate(None, SYMBOLS))) / n,
        text.count(b"!") / n,
        len(text.translate(None, _UPPER)) / letters if letters > 20 else 0,
        1 - len(set(words)) / n if n > 20 else 0,
        1 - len(set(lines)) / max(1, len(lines)),
    )
    buckets = np.searchsorted(SHARES, shares)
    every.update(b"\n%d %d" % (i, b) for i, b in enumerate(buckets))
    every.add(b"\nwords %d" % min(len(words), 4096).bit_length())
    return _hashed(every)


def meta_features(values: tuple) -> np.ndarray:
    """The hashed features of (lang, source, n_chars): each, and language and length with the source."""
    lang, source, n_chars = values
    length = "none" if n_chars is None else str(int(max(n_chars, 0)).bit_length())
    names = {f"lang {lang}", f"source {source}", f"chars {length}", f"lang {lang} source {source}", f"chars {length} source {source}"}
    return _hashed(x.encode() for x in names)


@dataclass
class View:
    """A logistic regression over the chosen hashed features of one view, and its calibration."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SIZE, np.float32))
    prior: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def score(self, features: np.ndarray) -> float:
        """Log-odds of a bad document."""
        return self.prior + float(self.weights[features].sum())

    def odds(self, score):
        """Calibrated log-odds."""
        return self.slope * score + self.shift


#: Rows that a fit holds as floats at a time.
FIT_ROWS = 1024


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25, bits: int | None = None) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, the intercept last. bits: x holds so many 0/1 features, packed."""
    n = x.shape[1] if bits is None else bits
    w, ridge = np.zeros(n + 1), np.append(np.full(n, ridge), 1e-3)
    for _ in range(rounds):
        slope, curve = ridge * w, np.diag(ridge)
        for at in range(0, len(x), FIT_ROWS):  # x is held in its own small type
            part = x[at : at + FIT_ROWS] if bits is None else np.unpackbits(x[at : at + FIT_ROWS], axis=1, count=n)
            part = np.column_stack([part, np.ones(len(part))])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope += part.T @ (p - y[at : at + FIT_ROWS])
            curve += (part * (p * (1 - p))[:, None]).T @ part
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Classifier:
    """Two calibrated views and how their log-odds add up."""

    text: View
    meta: View
    combined: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))
    trained: bool = True

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def sigmoid(z):
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        if not self.trained:
            return (np.zeros(len(text)),) * 3
        t, m = self.text.odds(text), self.meta.odds(meta)
        return sigmoid(t), sigmoid(m), sigmoid(self.combined[0] * t + self.combined[1] * m + self.combined[2])


def _rows(docs: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """(id, text, lang, source, n_chars, bad, held): bad is null without a label."""

    def column(name: str, kind: str) -> Column:
        return (F.col(f"`{name}`") if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    known = labels.select(
        F.col("doc_id").cast("long").alias("id"), ((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int").alias("bad")
    ).dropna()
    known = known.groupBy("id").agg(F.max("bad").alias("bad"))
    share = min(1.0, max_labels / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_column(docs), column("lang", "string"), column("source", "string"), column("n_chars", "long"))
    joined = rows.join(F.broadcast(known), "id", "left")  # about max_labels rows of 12 bytes
    return joined.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(5)) == 0)


def _features(batch):
    """(text features, metadata features) of each row of a batch (.., text, lang, source, n_chars)."""
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    meta = zip(*(col[n].to_pylist() for n in ("lang", "source", "n_chars")), strict=True)
    for text, values in zip(raw_bytes(col["text"]), meta, strict=True):
        yield text_features(text), meta_features(values)


def _stored_features(rows: DataFrame) -> DataFrame:
    """(id, bad, held, text, meta) of each row, features as packed 32-bit integers."""

    def compute(batches):
        import pyarrow as pa

        for batch in batches:
            both = [tuple(x.astype("<u4").tobytes() for x in f) for f in _features(batch)]
            new = [pa.array([x[i] for x in both], pa.binary()) for i in range(2)]
            yield pa.record_batch([*(batch.column(i) for i in range(3)), *new], names=["id", "bad", "held", "text", "meta"])

    found = rows.select("id", "bad", "held", "text", "lang", "source", "n_chars").mapInArrow(compute, "id long, bad int, held boolean, text binary, meta binary")
    return stored(found, "features")


def _labels(batches, before, sure: float):
    """(own label, text features, metadata features, label for the text view, label for the metadata view) of each row.

    Without a label of its own a row gets for each view what the other view is sure of, or None.
    """
    limit = math.log(sure / (1 - sure))
    for batch in batches:
        col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for label, *both in zip(col["bad"], col["text"], col["meta"], strict=True):
            text, meta = (np.frombuffer(x, "<u4") for x in both)
            if label is None and before is not None:
                t, m = before[0].odds(before[0].score(text)), before[1].odds(before[1].score(meta))
                yield label, text, meta, int(m > 0) if abs(m) >= limit else None, int(t > 0) if abs(t) >= limit else None
            else:
                yield label, text, meta, label, label


def association(n0, n1, c0, c1) -> Column:
    """The likelihood-ratio statistic of a feature: in c0 of n0 and c1 of n1 documents."""

    def term(c, expected):
        return F.when(c > 0, c * F.ln(c / expected)).otherwise(F.lit(0.0))

    share = (c0 + c1) / (n0 + n1)
    return 2 * sum(term(c, n * share) + term(n - c, n * (1 - share)) for c, n in ((c0, n0), (c1, n1)))


def _choose(rows: DataFrame, sent, sure: float, most: int, least: int = 5, significant: float = 15.0) -> tuple[list[np.ndarray], np.ndarray, int]:
    """The features of either view that are most associated with its labels, the numbers of the documents that
    they were chosen from, and how many of those are labelled, which are the same for both."""

    def count(batches):
        import pyarrow as pa

        counts, totals, known = np.zeros((2, 2, SIZE), np.int64), np.zeros((2, 2), np.int64), np.zeros(2, np.int64)
        for given, text, meta, *labels in _labels(batches, sent.value if sent else None, sure):
            if given is not None:
                known[given] += 1
            for view, (features, label) in enumerate(zip((text, meta), labels, strict=True)):
                if label is not None:
                    counts[view, label, features] += 1
                    totals[view, label] += 1
        # features that a task has seen; place SIZE holds the number of documents, SIZE + 1 that of labelled ones
        for view in range(2):
            at = np.flatnonzero(counts[view].sum(axis=0))
            both = [np.append(counts[view, y][at], [totals[view, y], known[y]]) for y in range(2)]
            yield pa.record_batch([*map(pa.array, (np.full(len(at) + 2, view), np.append(at, [SIZE, SIZE + 1]), *both))], names=["view", "feature", "good", "bad"])

    found = rows.mapInArrow(count, "view long, feature long, good long, bad long")
    table = stored(found.groupBy("view", "feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "feature-counts")
    sums = {(r.view, r.feature - SIZE): (r.good, r.bad) for r in table.where(F.col("feature") >= SIZE).collect()}  # four rows
    chosen = []
    for view in range(2):
        n0, n1 = sums.get((view, 0), (0, 0))
        if not n0 or not n1:
            chosen.append(np.zeros(0, np.int64))
            continue
        value = association(F.lit(float(n0)), F.lit(float(n1)), F.col("good"), F.col("bad"))
        own = table.where((F.col("view") == view) & (F.col("feature") < SIZE) & (F.col("good") + F.col("bad") >= least))
        own = own.select("feature", value.alias("value")).where(F.col("value") >= significant).orderBy(F.desc("value"), "feature").limit(most)
        chosen.append(np.sort(np.array([r.feature for r in own.collect()], np.int64)))  # `most` rows at most
    return chosen, np.array([sum(sums.get((view, 0), (0, 0))) for view in range(2)]), sum(sums.get((0, 1), (0, 0)))


def _learn(rows: DataFrame, sent, sure: float, most: int, max_fit: int) -> tuple[View, View]:
    """One round: both views anew from the labels and from what the other view is sure of."""
    spark = rows.sparkSession
    used = rows.where("not held or bad is null") if sent else rows.where("not held and bad is not null")
    chosen, totals, labelled = _choose(used.select("bad", "text", "meta"), sent, sure, most)
    picked = spark.sparkContext.broadcast(chosen)
    # places of 1 << 20 that enter the fit: of labels, and of each view's pseudo-labels
    label_places, *pseudo_places = (int(min(1.0, max_fit / max(1, int(n))) * (1 << 20)) for n in (labelled, *(totals - labelled)))

    def gather(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            places = batch.column(batch.schema.names.index("place")).to_pylist()
            for place, (given, text, meta, *labels) in zip(places, _labels([batch], sent.value if sent else None, sure), strict=True):
                for view, (features, label) in enumerate(zip((text, meta), labels, strict=True)):
                    if label is not None and (given is not None or place < pseudo_places[view]):
                        out.append((view, label, np.packbits(np.isin(picked.value[view], features, assume_unique=True)).tobytes()))
            view, label, at = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([pa.array(view, pa.int32()), pa.array(label, pa.int32()), pa.array(at, pa.binary())], names=["view", "label", "at"])

    placed = used.withColumn("place", F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 20)))
    sample = placed.where(F.col("place") < F.when(F.col("bad").isNull(), max(pseudo_places)).otherwise(label_places)).select("bad", "text", "meta", "place")
    # about 2 * max_fit rows a view at most, a bit for each chosen feature
    table = sample.mapInArrow(gather, "view int, label int, at binary").toArrow()
    table = table.sort_by([(c, "ascending") for c in ("view", "label", "at")])  # the order in which rows arrive must not count
    views = []
    for view in range(2):
        own = table.filter(np.asarray(table.column("view")) == view)
        y, features = np.asarray(own.column("label"), float), chosen[view]
        model = View()
        if len(y) and 0 < y.mean() < 1:
            x = np.frombuffer(b"".join(own.column("at").to_pylist()), np.uint8).reshape(len(y), (len(features) + 7) // 8)
            w = logistic(x, y, ridge=1.0, bits=len(features))
            model.weights[features], model.prior = w[:-1], float(w[-1])
        views.append(model)
    return views[0], views[1]


def _scored(rows: DataFrame, sent) -> DataFrame:
    """(bad, text, meta) with each view's log-odds, of stored features."""

    def score(batches):
        import pyarrow as pa

        text_view, meta_view = sent.value
        for batch in batches:
            scores = [(text_view.score(t), meta_view.score(m)) for _, t, m, _, _ in _labels([batch], None, 0.5)]
            both = np.array(scores, np.float64).reshape(-1, 2)
            yield pa.record_batch([batch.column(0), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["bad", "text", "meta"])

    return rows.select("bad", "text", "meta").mapInArrow(score, "bad int, text double, meta double")


def train(
    docs: DataFrame, labels: DataFrame, rounds: int = 2, sure: float = 0.99, most: int = 512, max_labels: int = 200_000, max_fit: int = 20_000, max_held: int = 20_000
) -> Classifier:
    """A classifier from docs (doc_id, text, lang, source, n_chars) and labels (doc_id, quality, toxic).

    rounds: exchanges of pseudo-labels. sure: the probability from which a prediction is one.
    most: features of a view. max_labels: about the most labels that are used. max_fit: about the most
    labelled, and the most pseudo-labelled, documents that a view's weights are fitted on; features are chosen from all of them. max_held: about the
    most documents that calibrate.
    """
    spark = docs.sparkSession
    rows = _stored_features(_rows(docs, labels, max_labels))
    views = _learn(rows, None, sure, most, max_fit)
    for _ in range(rounds):
        views = _learn(rows, spark.sparkContext.broadcast(views), sure, most, max_fit)
    known = rows.where("held and bad is not null")
    places = int(min(1.0, max_held / max(1, known.count())) * (1 << 20))
    known = known.where(F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(1 << 20)) < places)
    # about max_held rows of numbers
    table = _scored(known, spark.sparkContext.broadcast(views)).toArrow().sort_by([(c, "ascending") for c in ("bad", "text", "meta")])
    sample = {c: np.asarray(table.column(c), float) for c in ("bad", "text", "meta")}
    model = Classifier(*views)
    y = sample["bad"]
    if not len(y) or y.min() == y.max():
        model.trained = any(v.weights.any() for v in views)
        return model
    for view, name in zip(views, ("text", "meta"), strict=True):
        view.slope, view.shift = logistic(sample[name][:, None], y)
    odds = np.column_stack([v.odds(sample[n]) for v, n in zip(views, ("text", "meta"), strict=True)])
    model.combined = logistic(odds, y)
    return model


def classify(docs: DataFrame, model: Classifier, threshold: float = 0.6) -> DataFrame:
    """docs with `p_text`, `p_meta`, `p_bad` and `keep` (p_bad below threshold) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("p_text", "p_meta", "p_bad", "keep")]

    def column(name: str, kind: str) -> Column:
        return (F.col(f"`{name}`") if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), text_column(docs), column("lang", "string"), column("source", "string"), column("n_chars", "long"))

    def score(batches):
        import pyarrow as pa

        fitted = sent.value
        for batch in batches:
            scores = [(fitted.text.score(t), fitted.meta.score(m)) for t, m in _features(batch)]
            both = np.array(scores, np.float64).reshape(-1, 2)
            found = fitted.probabilities(both[:, 0], both[:, 1])
            yield pa.record_batch([batch.column(0), *map(pa.array, found)], names=["row", "p_text", "p_meta", "p_bad"])

    schema = rows.select("row", *[F.lit(0.0).alias(c) for c in ("p_text", "p_meta", "p_bad")]).schema
    out = rows.mapInArrow(score, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in own], "p_text", "p_meta", "p_bad", (F.col("p_bad") < threshold).alias("keep"))
