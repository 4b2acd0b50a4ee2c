"""Whitened rows against numpy's eigenvectors of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from facelake.llm import queries, whitening


def plain(rows, k=8, scale=1024, shift=100_000):
    x = [[math.floor(scale * v) + shift for v in row] for _, row in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums, strict=True)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    trace = float(Fraction(sum(deviations), n**3))
    return n, deviations, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / trace


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()]
    n, deviations, white, explained = plain(rows)
    found = queries.op12_whitening(spark, sf).orderBy("vec_id", "component").collect()
    assert len(found) == 8 * n and {r.n for r in found} == {n} and [r.vec_id for r in found[::8]] == [i for i, _ in rows]
    assert [r.deviation for r in found[::8]] == deviations
    assert np.allclose([r.explained for r in found[:8]], explained, rtol=1e-9)
    got = np.array([r.whitened for r in found]).reshape(n, 8)
    signs = np.sign((got * white).sum(axis=0))  # either sign, the same for all rows
    assert np.allclose(got * signs, white, atol=1e-7)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    assert abs(np.cov(got.T, bias=True) - np.eye(8)).max() < 1e-9


ODD = [(1, [0.5, 0.25, 0.0]), (2, [0.1, -0.7, 0.0]), (2, [0.1, -0.7, 0.0]), (None, [0.9, 0.1, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None, 0.0]), (7, [1.0, float("nan"), 0.0]), (8, [float("inf"), 0.0, 0.0])]


def test_odd_rows(spark):
    frame = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "x", "c", "n", "w", "component")})
    found = whitening.whiten(frame).orderBy(F.asc_nulls_last("id"), "component").collect()
    # the third dimension is constant, so there are two components, for each of four rows
    assert [(r.id, r.component) for r in found] == [(1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2), (None, 1), (None, 2)]
    _, deviations, _, explained = plain([r for r in ODD[:4]])
    assert {r.id: r.deviation for r in found} == {1: deviations[0], 2: deviations[1], None: deviations[3]}
    assert np.allclose([found[0].explained, found[1].explained], explained[:2]) and found[0].identity_error < 1e-9


def test_no_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25])] * 3, "vec_id long, embedding array<float>")
    assert whitening.whiten(one).collect() == [] and whitening.whiten(one.where("false")).collect() == []
    assert whitening.whiten(one.where("false")).columns == whitening.whiten(one).columns
