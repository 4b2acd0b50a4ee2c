"""Elias-Fano sequences and token files read document by document."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facelake.llm import token_files
from facelake.llm.common import scratch
from facelake.llm.token_files import EliasFano, TokenFile, pack


@given(st.lists(st.integers(0, 10**9), max_size=400), st.integers(0, 40))
@settings(max_examples=80, deadline=None)
def test_select_is_the_sequence(steps, shift):
    values = np.cumsum(np.array(steps, np.int64) >> shift) if steps else np.zeros(0, np.int64)
    held = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert [held.select(i) for i in range(held.n)] == values.tolist() == held.values().tolist()
    with pytest.raises(IndexError):
        held.select(held.n)


def test_space_is_near_the_minimum():
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 10**8, 50_000))
    bits = 8 * len(EliasFano.encode(values).to_bytes())
    assert bits < len(values) * (2.6 + np.log2(10**8 / len(values)))  # 2 + log2(u / n), and the directory


def test_documents_by_place():
    ids = [np.arange(n, dtype="<u2").tobytes() for n in (3, 0, 5, 1)]
    file = TokenFile(pack([None, -7, 4, 4], ids, 2))
    assert [(d, s, len(x)) for d, s, x in file.documents()] == [(None, 0, 3), (-7, 3, 0), (4, 3, 5), (4, 8, 1)]
    assert file.document(2).tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="not a token file"):
        TokenFile(b"other " + bytes(100))


def test_files_of_any_size_agree(spark):
    rows = [(i % 40 if i % 3 else None, f"text number {i} " * (i % 9)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = []
    for size in (64, 1 << 20):
        folder = scratch(spark, "files")
        manifest = token_files.write_tokens(docs, folder, file_bytes=size)
        got = [tuple(r) for r in token_files.read_tokens(manifest, folder).orderBy("start").collect()]
        assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
        assert [r[0] is not None for r in got] == sorted(r[0] is not None for r in got)
        out.append(sorted((r[0] is None, r[0], r[2], r[3]) for r in got))
    assert out[0] == out[1] and len(out[0]) == 300
