"""Whitening against a plain eigen decomposition."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

import cases
from spanloom.llm import whitening
from spanloom.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, `row.key` string, component string"


def plain(vectors, k=4):
    """n, sums, eigenvalues, components and trace of the distinct whole vectors."""
    whole = [tuple(math.floor(256 * float(c)) for c in v) for v in vectors]
    x = sorted(set(whole))
    sums = [sum(c) for c in zip(*x)]
    c = np.array([[float(a) - s / len(x) for a, s in zip(v, sums)] for v in x])
    values, parts = np.linalg.eigh(c.T @ c / len(x))
    return whole, len(x), sums, values[::-1][:k], parts.T[::-1][:k], float((c * c).sum() / len(x)), c


def check(rows, vectors, k=4):
    """``rows`` by (id, component) against the plain computation; ``vectors`` by id."""
    whole, n, sums, values, parts, trace, c = plain(list(vectors.values()), k)
    assert len(rows) == len(vectors) * len(values)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    for j, (e, u) in enumerate(zip(values, parts)):
        signs = set()
        for (i, _), x in zip(vectors.items(), whole):
            r = by[i, j + 1]
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            want = sum((a - s / n) * w for a, s, w in zip(x, sums, u)) / math.sqrt(e)
            assert r["whitened"] == pytest.approx(want, abs=1e-6) or r["whitened"] == pytest.approx(-want, abs=1e-6)
            if abs(want) > 1e-3:
                signs.add(r["whitened"] * want > 0)
            assert r["explained"] == pytest.approx(e / trace, rel=1e-9) and r["identity_error"] < 1e-9
        assert len(signs) == 1


def test_query_equals_an_eigen_decomposition(spark):
    table = pq.read_table(f"{cases.SF}/embeddings.parquet").to_pylist()
    check(QUERIES["op13_whitening"](spark, cases.SF).collect(), {r["vec_id"]: r["embedding"] for r in table})


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = {i: [float(np.float32(x)) for x in rng.normal(size=5) * (9, 5, 2, 1, .5)] for i in range(60)}
    good |= {100: good[3], 101: good[3], 102: [0.0, -0.0, 0.0, -0.0, 0.0], 103: [-0.0] * 5}
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (None, None)]
    rows = [(i, v, 7, "x", "own") for i, v in [*good.items(), *bad, (3, good[3])]]
    df = spark.createDataFrame(rows, SCHEMA)
    found = whitening.transform(df, whitening.fit(df))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    out = found.collect()
    assert len([r for r in out if r["vec_id"] == 3]) == 8
    once = {(r["vec_id"], r["component"]): r for r in out}
    check(list(once.values()), good)
    assert whitening.transform(df, None).count() == 0


def test_fewer_components_than_asked(spark):
    line = [(i, [float(i), 2.0 * i, -1.0 * i], 0, "", "") for i in range(9)]
    for rows, k in ((line, 1), (line[:1], 0), ([line[2]] * 5, 0), ([], 0), ([(1, None, 0, "", "")], 0)):
        df = spark.createDataFrame(rows, SCHEMA)
        assert {r["component"] for r in whitening.transform(df, whitening.fit(df)).collect()} == set(range(1, k + 1))


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e12 * (i % 7), 3e38, float(i)], 0, "", "") for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n bigint, `row.key` string, component string")
    model = whitening.fit(df)
    whole = {(math.floor(256 * 1e12 * (i % 7)), 1 << 53, 256 * i) for i in range(40)}
    assert model.n == 40 and model.sums == tuple(sum(c) for c in zip(*whole))
    assert whitening.transform(df, model).filter("deviation is not null").count() == 0


def test_factor_and_rotations_give_all_eigenvalues():
    rng = np.random.default_rng(5)
    for d, rank in ((1, 1), (2, 2), (7, 7), (12, 5), (33, 33)):
        a = rng.normal(size=(d, rank)) * np.logspace(0, -6, rank)
        scatter = a @ a.T
        low = whitening.factor(scatter)
        assert np.allclose(low @ low.T, scatter, atol=1e-13 * np.trace(scatter))
        values, parts = whitening.principal(scatter)
        want = np.linalg.svd(a, compute_uv=False) ** 2
        assert np.allclose(values[:rank // 2 + 1], want[:rank // 2 + 1], rtol=1e-9)
        assert np.allclose(parts @ parts.T, np.eye(len(parts)), atol=1e-9)
    assert whitening.principal(np.zeros((3, 3)))[0].size == 0
