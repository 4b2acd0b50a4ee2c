"""Verdicts, policies and ablations of the rule ledger against plain versions."""

import re

import duckdb
import llm_brute as brute
import pytest

from facelake.llm import queries, rules

SF = "/root/testdata/sf0.001"


def plain_failures(text):
    text = text or ""
    _, n, chars, symbols, dup, repeated, _ = brute.rules([(0, text)])[0]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters, upper = len(re.findall("[A-Za-z]", text)), len(re.findall("[A-Z]", text))
    marks = len(re.findall(r"[!-@\[-`{-~]", text))
    blocked = sum(w in rules.BLOCKED for w in re.findall("[a-z]+", text.translate(brute.LOWER)))
    return {
        "few_words": n < 50,
        "repeated_windows": 100 * repeated > 50 * n,
        "symbols": 10 * symbols > 3 * n,
        "duplicate_lines": len(lines) >= 4 and 10 * dup > 3 * len(lines),
        "word_length": n > 0 and not 2 * n <= chars <= 15 * n,
        "shouting": letters >= 100 and 10 * upper > 5 * letters,
        "few_letters": chars >= 100 and 10 * (chars - marks) < 6 * chars,
        "blocked_terms": blocked >= 3 or (blocked >= 2 and 100 * blocked > n),
    }


@pytest.fixture(scope="module")
def entries(spark):
    return rules.ledger(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.fixture(scope="module")
def failures(spark):
    return {r.doc_id: plain_failures(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_bits(entries, failures):
    for r in entries.collect():
        assert [name for i, name in enumerate(rules.RULES) if r.failed >> i & 1] == [name for name, bad in failures[r.id].items() if bad]


@pytest.mark.parametrize("version", sorted(rules.POLICIES))
def test_policies(entries, failures, version):
    got = {r.id: r.kept for r in rules.apply_policy(entries, version).collect()}
    assert got == {d: not any(f[x] for x in rules.POLICIES[version]) for d, f in failures.items()}
    assert 0 < sum(got.values()) < len(got)


@pytest.mark.parametrize("version", sorted(rules.POLICIES))
def test_ablations(entries, failures, version):
    policy = rules.POLICIES[version]
    want = {}
    for rule in policy:
        rest = [x for x in policy if x != rule]
        without = [f for f in failures.values() if not any(f[x] for x in rest)]
        want[rule] = (sum(f[rule] for f in failures.values()), sum(f[rule] for f in without), len(without))
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in rules.ablations(entries, version).collect()}
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want.fetchall()) and set(columns) == set(found.columns)


def test_blocked_terms_are_a_parameter(spark):
    docs = spark.createDataFrame([(1, "Foo foo-bar foobar x.y"), (2, "idiot idiots")], "doc_id long, text string")
    assert {r.id: r.n_blocked for r in rules.ledger(docs, ["foo", "x.y"]).collect()} == {1: 3, 2: 0}
    assert {r.id: r.n_blocked for r in rules.ledger(docs, []).collect()} == {1: 0, 2: 0}
    assert {r.id: r.n_blocked for r in rules.ledger(docs).collect()} == {1: 0, 2: 2}
