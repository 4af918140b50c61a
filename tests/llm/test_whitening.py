import math

import numpy as np
import pytest

from furrow.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors):
    """vec_id -> exact deviation and whitened row up to signs, with n, explained shares and directions."""
    xs = {}
    for key, v in vectors:
        if v is not None and v and all(c is not None and math.isfinite(c) for c in v):
            xs.setdefault(key, []).append([math.floor(256 * float(np.float32(c))) for c in v])
    fit = sorted({tuple(x) for rows in xs.values() for x in rows})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[(n * x[k] - s[k]) / n for k in range(d)] for x in fit])
    cover = centred.T @ centred / n
    e, v = np.linalg.eigh(cover)
    e, v = e[::-1][:4], v[:, ::-1][:, :4]
    out = {}
    for key, rows in xs.items():
        for x in rows:
            dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
            z = (np.array(x) - np.array(s) / n) @ v / np.sqrt(e)
            out.setdefault(key, []).append((dev, z))
    return n, e, e / np.trace(cover), out


def check(got, vectors):
    n, e, share, want = brute(vectors)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(by) == set(want)
    signs = np.zeros(len(e))
    for key, rows in want.items():
        for k in range(len(e)):
            found = by[key][k + 1]
            assert len(found) == len(rows) and {r.n for r in found} == {n}
            assert sorted(r.deviation for r in found) == sorted(dev for dev, _ in rows)
            assert all(abs(r.explained - share[k]) < 1e-9 and r.identity_error < 1e-8 and r.residual < 2e-14 for r in found)
            assert abs(found[0].eigenvalue / e[k] - 1) < 1e-10
            if len(rows) == 1 and abs(rows[0][1][k]) > 1e-3:
                sign = np.sign(found[0].whitened * rows[0][1][k])
                assert signs[k] in (0, sign)
                signs[k] = sign
            if signs[k]:
                assert np.allclose(sorted(r.whitened for r in found), sorted(signs[k] * z[k] for _, z in rows), atol=1e-6)


def made(n, d, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d)) * (1 + np.arange(d)[::-1]) * 0.1
    return [(i, [float(c) for c in row]) for i, row in enumerate(base)]


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 0) for k, v in vectors], SCHEMA)


@pytest.mark.parametrize("d", [4, 9, 32])
def test_against_dense_solution(spark, d):
    vectors = made(200, d)
    check(W.whitening_report(frame(spark, vectors).repartition(5)).collect(), vectors)


def test_query(spark):
    from furrow.llm.registry import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check(QUERIES["op11_whiten_jacobi_davidson"](spark, "/root/testdata/sf0.001").collect(), [(r.vec_id, r.embedding) for r in rows])


def test_bad_and_repeated_vectors(spark):
    """Unusable vectors go, copies have no weight in the fit but rows of their own."""
    good = made(60, 6, seed=3)
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [nan] * 6), (904, [inf] + [0.0] * 5), (905, [1e30] * 6), (906, [1.0] * 5)]
    copies = [(1000 + k, good[7][1]) for k in range(300)]
    vectors = good + bad + copies
    want = [(k, v) for k, v in vectors if k not in (905, 906)]
    got = W.whitening_report(frame(spark, vectors).repartition(4)).collect()
    assert {r.n for r in got} == {60}
    check(got, want)


def test_few_vectors(spark):
    one = W.whitening_report(frame(spark, [(1, [0.5, 0.25, 1.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 1, 0, None, None, None) for k in (1, 2, 3)]
    same = W.whitening_report(frame(spark, [(k, [0.5, 0.25]) for k in range(5)])).collect()
    assert len(same) == 10 and all(r.whitened is None and r.n == 1 for r in same)
    line = W.whitening_report(frame(spark, [(k, [k * 1.0, 0.0, 0.0]) for k in range(5)])).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-12 for r in line)
    assert W.whitening_report(frame(spark, []).limit(0)).collect() == []
    assert W.whitening_report(frame(spark, [(1, None)])).collect() == []


def test_clashing_columns_and_large_entries(spark):
    from pyspark.sql import functions as F

    vectors = [(k, [float(2**40 + 2**20 * ((k * j) % 7)) for j in range(1, 6)]) for k in range(20)]
    df = frame(spark, vectors).withColumns({c: F.lit(f"own {c}") for c in ("x", "n", "component", "whitened", "deviation", "d", "c")})
    got = W.whitening_report(df).collect()
    assert len(got) == 80 and {r.n for r in got} == {len({tuple(v) for _, v in vectors})}


def test_sums_in_many_tasks(spark, monkeypatch):
    vectors = made(90, 5)
    want = W.principal_axes(W.integer_vectors(frame(spark, vectors)).select("x").distinct().repartition(3))
    monkeypatch.setattr(W, "COLLECTED", 4)
    got = W.principal_axes(W.integer_vectors(frame(spark, vectors)).select("x").distinct().repartition(23))
    assert got.sums == want.sums and got.n == want.n and np.allclose(got.variances, want.variances, rtol=1e-12)


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 3, 3, 1, 1, 1], [1] * 12, [9, 1e-3, 1e-6, 0, 0, 0, 0, 0, 0, 0], list(0.8 ** np.arange(60))])
def test_solver_reaches_double_precision(spectrum):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((len(spectrum), len(spectrum))))[0]
    a = q @ np.diag(spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors, errors = W.largest_pairs(lambda b: a @ b, len(a), 4, float(np.trace(a)))
    assert np.allclose(values, sorted(spectrum, reverse=True)[:4], atol=1e-13 * spectrum[0])
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 2e-14 * max(spectrum)


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(4)
    b = rng.standard_normal((30, 30))
    a, q = b @ b.T, np.linalg.qr(rng.standard_normal((30, 3)))[0]
    project = lambda v: v - q @ (q.T @ v)
    rhs = rng.standard_normal(30)
    solver = W.minres(1.5, project, rhs, 60, 1e-13)
    v = next(solver)
    try:
        while True:
            v = solver.send(a @ v)
    except StopIteration as end:
        t = end.value
    assert np.allclose(q.T @ t, 0, atol=1e-9)
    assert np.linalg.norm(project(a @ t - 1.5 * t) - project(rhs)) < 1e-8 * np.linalg.norm(rhs)
