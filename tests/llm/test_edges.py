"""Nulls, empty, blank and very long texts, ties, repeated rows, empty tables and clashing column names: defined results."""

import llm_brute as brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facelake.llm import decontaminate, html_extract, line_dedup, pii, quality, rules, simhash, spm_lattice, token_counts, token_files
from facelake.llm.common import scratch

LINE = "the same line of text in every one of the documents"
LONG = " ".join(f"word{i % 4099}x{i % 911}" for i in range(60_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, f"{LINE}\nmore", "en", "a", 9),
    (4, f"{LINE}\nmore", "en", "a", 9), (5, f"{LINE}\nother", "de", None, 9), (None, f"{LINE}\nmail x@y.org", None, "b", None),
    (7, "é日本 " * 3000, "fr", "b", 9000), (8, LONG, "en", "b", len(LONG)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = [(1, "in every one of the documents more"), (2, None), (None, "")]
#: Names that the operators use or return themselves.
CLASHING = ("id", "row", "rest", "key", "fp", "decoded", "line", "ids", "p_text", "p_meta", "p_bad", "keep", "n_lines", "n_removed", "main_text", "digest", "spans", "failed", "items")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="module")
def nothing(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, None), (None, 1, 1), (4, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")


def by_key(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def pairs():
    return [(r[0], r[1]) for r in ROWS]


def same(df, want, *columns):
    assert len(set(df.columns)) == len(df.columns)
    assert by_key(df.select(*columns).collect()) == by_key(want)


def test_empty_tables(spark, nothing, items, labels):
    folder = scratch(spark, "files")
    found = [
        quality.classify(nothing, quality.train(nothing, labels, rounds=1)), spm_lattice.decode(spm_lattice.encode(nothing)),
        token_counts.token_counts(nothing, scratch(spark, "cache")), decontaminate.find_windows(nothing, items), line_dedup.dedup_lines(nothing),
        rules.apply_policy(rules.ledger(nothing)), pii.find_personal_data(nothing),
        token_files.read_tokens(token_files.write_tokens(nothing, folder), folder), simhash.near_duplicates(nothing),
        html_extract.extract(nothing.withColumnRenamed("text", "html")),
    ]
    assert [df.count() for df in found] == [0] * 10


def test_empty_other_tables(spark, docs, items, labels):
    same(decontaminate.find_windows(docs, items.where("false")).withColumn("n", F.size("starts")), [(d, 0) for d, _ in pairs()], "id", "n")
    model = quality.train(docs, labels.where("false"))
    same(quality.classify(docs, model), [(d, 0.0, True) for d, _ in pairs()], "doc_id", "p_bad", "keep")


def test_quality(docs, labels):
    found = quality.classify(docs, quality.train(docs, labels, rounds=1))
    rows = found.collect()
    assert len(rows) == len(ROWS) and dict(found.dtypes)["p_text"] == "double" and len(set(found.columns)) == len(found.columns)
    assert all(0 <= r[c] <= 1 for r in rows for c in ("p_text", "p_meta", "p_bad"))
    assert len({(r.p_text, r.p_meta, r.p_bad, r.keep) for r in rows if r.doc_id == 4}) == 1  # repeated rows alike


def test_pieces(docs):
    own = brute.pieces()
    found = spm_lattice.decode(spm_lattice.encode(docs))
    assert by_key((r.doc_id, list(r.ids), r.decoded) for r in found.collect()) == by_key((d, own.encode(t or ""), t or "") for d, t in pairs())


def test_counts(spark, docs):
    want = [r[:3] for r in brute.token_counts(pairs())]
    same(token_counts.token_counts(docs, scratch(spark, "cache")), want, "id", "n_bytes", "n_tokens")


def test_windows(docs, items):
    found = decontaminate.find_windows(docs, items).select("id", "n_words", F.size("items").alias("n"))
    same(found, [(d, n, k) for d, n, _, k, _, _ in brute.decontaminate(pairs(), ITEMS)], "id", "n_words", "n")


def test_lines(docs):
    found = line_dedup.dedup_lines(docs)
    want = [(d, t or "", (t or "").count("\n") + 1, 0) for d, t in pairs()]
    # the row without doc_id comes first; rows that repeat id and text are one document
    want = [(d, t.removeprefix(LINE + "\n"), n, 1) if d in (4, 5) else (d, t, n, k) for d, t, n, k in want]
    same(found, want, "doc_id", "text", "n_lines", "n_removed")


def test_rules(docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    same(rules.ledger(docs), [r[:6] for r in brute.rules(pairs())], "id", *names)


def test_personal_data(docs):
    found = pii.find_personal_data(docs).select("id", pii.label(F.col("base")).alias("base"), F.size("spans").alias("n"))
    at = len(LINE) + 6
    same(found, [(d, f"email:{at}:{at + 7}" if d is None else "", int(d is None)) for d, _ in pairs()], "id", "base", "n")


def test_files(spark, docs):
    folder = scratch(spark, "files")
    found = token_files.read_tokens(token_files.write_tokens(docs, folder), folder)
    want = brute.token_files(pairs())
    assert by_key(found.select("id", "n_tokens", "ids_crc32").collect()) == by_key((d, n, c) for d, _, n, c in want)
    assert sorted(r.start for r in found.collect()) == sorted(r[1] for r in want)


def test_simhash(docs):
    component = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, None: None, 7: 7, 8: 8}
    found = simhash.near_duplicates(docs).select("id", simhash.hex64("fp").alias("fp"), "component")
    same(found, [(d, f"{brute.simhash(t):016x}", component[d]) for d, t in pairs()], "id", "fp", "component")


def test_html(docs):
    found = html_extract.extract(docs.withColumnRenamed("text", "html"))
    same(found, [(d, " ".join((t or "").split())) for d, t in pairs()], "doc_id", "main_text")


@pytest.fixture(scope="module")
def folder(spark, items, labels, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    items.write.parquet(f"{path}/benchmark.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


KEPT = {
    "quality": None,
    "lines": [1, 2, 3, 4, 4, 5, None, 7, 8],
    "near_duplicates": [1, 4, 5, None, 7, 8],  # texts without words are one class, repeated rows as well
    "decontamination": [1, 2, 3, 5, None, 7, 8],
    "pieces": [1, 2, 3, 4, 4, 5, None, 7, 8],
}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, nothing, folder, name, stage):
    columns = [*corpus_pipeline.COLUMNS, *(["n_tokens", "ids"] if name == "pieces" else [])]
    empty, found = stage(spark, nothing, folder), stage(spark, docs, folder)
    assert empty.columns == found.columns == columns and empty.count() == 0
    rows = found.collect()
    if KEPT[name] is not None:
        assert by_key((r.doc_id,) for r in rows) == by_key((d,) for d in KEPT[name])
    else:
        assert len(rows) <= len(ROWS)
