"""Whitening against exact integers and a dense eigensolver, through the registered query."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from cutline.llm import catalog, whitening

ROWS = "vec_id long, embedding array<float>, n string, y int"


def expected(values):
    """n, sums, deviations and the dense covariance of the fit list, by plain arithmetic."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in values]
    fit = sorted(set(map(tuple, x)))
    n = len(fit)
    sums = [sum(col) for col in zip(*fit)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    away = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    return n, deviation, away.T @ away / n, np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in x])


def check(got, ids, values, count=16):
    n, deviation, covariance, away = expected(values)
    e, axes = np.linalg.eigh(covariance)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(count, int((e > 1e-9 * max(e[0], 1e-30)).sum()))
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by) == sorted(set(ids))
    for vec, dev, a in zip(ids, deviation, away):
        assert sorted(by[vec]) == list(range(1, k + 1))
        for c, r in by[vec].items():
            assert (r["n"], r["deviation"]) == (n, dev)
            assert r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(e[c - 1] / covariance.trace(), rel=1e-9)
            assert abs(r["whitened"]) == pytest.approx(abs(a @ axes[:, c - 1]) / np.sqrt(e[c - 1]), rel=1e-6, abs=1e-7)


def test_whitening_against_dense(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(120, 20)).astype(np.float32) * np.linspace(2, 0.1, 20, dtype=np.float32)
    values = np.vstack([values, values[:30]])
    rows = [(i, v.tolist(), "clash", i) for i, v in enumerate(values)]
    odd = [(900, None, "x", 0), (901, [1.0] * 19 + [float("nan")], "x", 0), (902, [float("inf")] * 20, "x", 0), (903, [None] + [1.0] * 19, "x", 0), (904, [], "x", 0)]
    got = whitening.whiten(spark.createDataFrame(rows + odd, ROWS).repartition(7)).collect()
    assert len(got) == 150 * 16
    check(got, range(150), values)


def test_whitening_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = catalog.queries()["op13_embedding_whitening"](spark, sf_dir).collect()
    check(got, [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_equal_roots_low_rank_and_small_tables(spark):
    cross = [[float(s if j == i else 0) for j in range(4)] for i in range(3) for s in (1, -1)]
    rows = [(i, v, "x", 0) for i, v in enumerate(cross)]
    got = whitening.whiten(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 6 * 3 and max(r["identity_error"] for r in got) < 1e-12
    assert {round(r["explained"], 12) for r in got} == {round(1 / 3, 12)}
    w = np.zeros((6, 3))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.allclose(w.T @ w / 6, np.eye(3))
    assert whitening.whiten(spark.createDataFrame(rows[:1] * 3, ROWS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], ROWS)).count() == 0
    two = [(1, [1.0], "x", 0), (None, [3.0], "x", 0), (2, [1.0, 0.0], "x", 0), (3, [0.0, 1.0], "x", 0), (3, [0.0, 1.0], "x", 0)]
    got = whitening.whiten(spark.createDataFrame(two, ROWS)).collect()
    assert sorted((str(r["vec_id"]), r["n"], round(abs(r["whitened"]), 9)) for r in got) == [("1", 2, 1.0), ("2", 2, 1.0), ("3", 2, 1.0), ("3", 2, 1.0), ("None", 2, 1.0)]


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e16, 0.0], "x", 0), (2, [-1e16, 1.0], "x", 0), (3, [5.0, 1e30], "x", 0)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, y int")).collect()
    y = [[64 * 10**16, 0], [-64 * 10**16, 64], [320, 1 << 62]]
    sums = [sum(c) for c in zip(*y)]
    assert {r["vec_id"]: int(r["deviation_digits"] or r["deviation"]) for r in got} == {i + 1: sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(y)}
    assert max(r["identity_error"] for r in got) < 1e-9


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(8)
    m = rng.integers(-9, 9, (7, 5))
    a = (m.T @ m).tolist()
    c = whitening.polynomial(spark, a)
    assert c[5] == 1 and c[4] == -sum(a[i][i] for i in range(5))
    assert np.allclose(np.poly(np.array(a, float))[::-1], [float(v) for v in c], rtol=1e-8)
    # Cayley-Hamilton, in whole numbers.
    power, total = np.eye(5, dtype=object) * 1, np.zeros((5, 5), object)
    for v in c:
        total = total + power * v
        power = power.dot(np.array(a, object))
    assert not total.any()
