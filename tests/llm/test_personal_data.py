"""Revealing terms against a plain version over whole tables, planted ones, and the sanitised texts."""

import math
from collections import Counter, defaultdict

import llm_brute as brute
import pytest
import regex
from pyspark.sql import functions as F

from facelake.llm import pii, queries

TERM = regex.compile(r"[\p{L}\p{N}]{3,}")
WIDER = {"email": lambda v: v.rpartition("@")[2], "ip": lambda v: ".".join(v.split(".")[:3])}


def joined(spans):
    out = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], brute_order(s[0]), s[2])):
        if out and start < out[-1][2]:
            out[-1][2] = max(end, out[-1][2])
        else:
            out.append([kind, start, end])
    return out


def brute_order(kind):
    return [*brute.PATTERNS, "term"].index(kind)


def plain(docs, threshold=0.95, min_support=2, part_support=2):
    """doc: (base spans, term spans with their disclosure)."""
    held = {}
    n_t, n_e, n_te = Counter(), Counter(), Counter()
    for doc, text in docs:
        base, masked = brute.base_spans(text or ""), list(text or "")
        entities = set()
        for kind, start, end in base:
            masked[start:end] = " " * (end - start)
            value = text[start:end]
            digits = regex.sub("[^0-9]", "", value)
            entities |= {("value", kind, value.lower()), ("part", kind, WIDER.get(kind, lambda _, d=digits: d[:-4])(value).lower())}
        masked = "".join(masked)
        terms = {m.lower() for m in TERM.findall(masked)}
        held[doc] = base, entities, masked, terms
        n_t.update(terms)
        n_e.update(entities)
        n_te.update((e, t) for e in entities for t in terms)
    told = defaultdict(dict)
    for (e, t), n in n_te.items():
        p = n_e[e] / len(docs)
        if n >= (part_support if e[0] == "part" else min_support) and p < 1:
            score = 1 - math.log((n + pii.PRIOR * p) / (n_t[t] + pii.PRIOR)) / math.log(p)
            if score >= threshold:
                told[e][t] = score
    out = {}
    for doc, (base, entities, masked, _) in held.items():
        found = []
        for m in TERM.finditer(masked) if entities else ():
            scores = [told[e][m[0].lower()] for e in entities if m[0].lower() in told[e]]
            if scores:
                found.append(("term", m.start(), m.end(), max(scores)))
        out[doc] = base, found
    return out


def labels(spans):
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {doc: labels([*base, *terms]) for doc, (base, terms) in plain(docs).items()}
    got = {r.doc_id: r for r in queries.op7_personal_data(spark, sf).collect()}
    assert {d: r.spans for d, r in got.items()} == want
    if sf.endswith("0.01"):
        assert sum(r.n_term for r in got.values()) > 0


@pytest.fixture(scope="module")
def planted(spark):
    rows = [(i, f"ordinary words again number{i % 7} and ask or please reply") for i in range(200)]
    rows += [(1000 + i, f"please ask zorblax or Zorblax at ann@secret.org now, call {i}") for i in range(6)]
    rows += [(2000, "zorblax@other.org is another one"), (2001, "see zorblaxes"), (3000, None), (3001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_planted_terms(spark, planted):
    found = {r.id: r for r in pii.find_personal_data(planted, min_support=3).collect()}
    for i in range(6):
        own = {s.value for s in found[1000 + i].spans if s.kind == 4}
        # the word in an address of another document does not count, and ordinary words are no spans
        assert own == {"zorblax", "Zorblax", "call", "now"}
    assert [len(found[i].spans) for i in (0, 2000, 2001, 3000, 3001)] == [0, 1, 0, 0, 0]
    want = plain([tuple(r) for r in planted.collect()], min_support=3)
    assert {i: [(s.start, s.end) for s in r.spans] for i, r in found.items()} == {i: [s[1:3] for s in [*b, *t]] for i, (b, t) in want.items()}


def test_sanitised(spark, planted):
    found = pii.find_personal_data(planted, min_support=3)
    texts = {r.id: (r.a, r.b) for r in found.select("id", pii.sanitise(F.col("text"), F.col("spans"), 1.1).alias("a"), pii.sanitise(F.col("text"), F.col("spans"), 0.9).alias("b")).collect()}
    assert texts[1002][0] == "please ask <WORD> or <NAME> at <EMAIL> <WORD>, <WORD> 2"
    assert texts[1002][1] == "please ask  or  at <EMAIL> ,  2"
    assert texts[2000][0] == "<EMAIL> is another one"


def test_overlapping_spans_are_one(spark):
    text = "card 4111 1111 1111 1111 and +4111 1111 1111 111 end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.find_personal_data(df).select("spans", "text", pii.sanitise(F.col("text"), F.col("spans")).alias("s")).first()
    spans = [(pii.ORDER[s.kind], s.start, s.end) for s in row.spans]
    want = text
    for kind, start, end in reversed(joined(spans)):
        want = f"{want[:start]}<{kind.upper()}>{want[end:]}"
    assert row.s == want and "111" not in row.s


def test_many_values_in_one_text(spark):
    """Time grows with the values: a text of 100,000 addresses, and its sanitised form."""
    import time

    text = "é " + " ".join(f"user{i}@host{i % 97}.org" for i in range(100_000))
    frame = spark.createDataFrame([(1, text), (2, "one a@b.org")], "doc_id long, text string")
    began = time.time()
    found = pii.find_personal_data(frame)
    rows = {r.id: r for r in found.select("id", F.size("spans").alias("n"), pii.sanitise(F.col("text"), F.col("spans")).alias("s")).collect()}
    assert rows[1].n == 100_000 and rows[1].s == "é " + " ".join(["<EMAIL>"] * 100_000) and rows[2].s == "one <EMAIL>"
    assert time.time() - began < 120


def test_directory(spark):
    """Thousands of values and names that two pages have in common are one entity to each name."""
    names = [f"surname{i}x" for i in range(3000)]
    page = " ".join(f"{n} {n}@firm{i}.org" for i, n in enumerate(names))
    rows = [(1, page), (2, "again " + page)] + [(10 + i, f"other words here {i}") for i in range(3000)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("id", pii.count_kind(F.col("spans"), "term").alias("n")).collect()
    assert {r.id: r.n for r in found if r.id < 3} == {1: 3000, 2: 3000}
