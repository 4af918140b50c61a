"""Properties that hold whatever the data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import solvers as S
from furrow.operators import forest, linear
from furrow.operators import validate as V
from furrow.operators.gram import gram, sum_matrices, training_matrices
from furrow.operators.loess import loess_trend
from furrow.operators.panel_models import fit_panel_trend, fit_random_coef, panel_features, random_effects
from furrow.operators.quality import gof
from furrow.operators.robust import fit_huber
from furrow.operators.scenario import detrend, rebase_after
from furrow.operators.spline import smooth, spline_trend
from furrow.operators.trend import poly_trend
from furrow.plans.inputs import month_panel

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    rows = []
    for g in ("g1", "g2", "g3"):
        x = rng.normal(size=(60, 3))
        x[:, 2] += 0.5 * x[:, 0]
        y = 2.0 + x @ [1.0, -0.5, 0.0] + 0.3 * rng.normal(size=60)
        rows += [(g, i, 1990 + i % 12, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return rows


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data, "g string, i int, year int, a double, b double, c double, y double")


def dense(data, g):
    m = np.array([r[3:] for r in data if r[0] == g])
    return m[:, :3], m[:, 3]


def matrix(x, y):
    z = np.c_[np.ones(len(x)), x, y]
    return z.T @ z


def by_group(df, *cols):
    return {r[0]: r[1:] for r in df.select("g", *cols).collect()}


def test_gram_is_the_sum_of_products(rows, data):
    got = by_group(gram(rows.repartition(7), ["g"], FEATURES, "y"), "rows", "m", "c")
    for g, (n, m, c) in got.items():
        x, y = dense(data, g)
        z = np.c_[x, y]
        assert n == 60
        np.testing.assert_allclose(S.unpack(m), matrix(x, y), rtol=1e-10)
        moments = S.Moments(c)
        np.testing.assert_allclose(moments.mean, z.mean(axis=0), rtol=1e-13, atol=1e-13)
        np.testing.assert_allclose(moments.co, (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)), rtol=1e-11, atol=1e-10)


def test_gram_keeps_large_and_null_keys(spark):
    big = 9007199254740993
    data = [(k, float(i), float(i * i % 7), float(i % 5)) for k in (big, big - 1, None) for i in range(8)]
    df = spark.createDataFrame(data, "g long, a double, b double, y double")
    one = by_group(gram(df.coalesce(1), ["g"], ["a", "b"], "y"), "rows", "m")
    many = by_group(gram(df.repartition(11), ["g"], ["a", "b"], "y"), "rows", "m")
    assert set(one) == set(many) == {big, big - 1, None}
    for g in one:
        assert one[g][0] == many[g][0] == 8
        np.testing.assert_allclose(one[g][1], many[g][1])


def test_many_groups_per_task_are_merged(spark, monkeypatch):
    """Keys of two columns, more groups than a task holds, batches that end inside a group."""
    data = [(i % 700, str(i % 3), float(i % 17), float(i * i % 23)) for i in range(9000)]
    df = spark.createDataFrame(data, "g int, h string, a double, y double").repartition(5)
    monkeypatch.setattr("furrow.operators.gram.HELD", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "128")
    try:
        got = {(r.g, r.h): r for r in gram(df, ["g", "h"], ["a"], "y").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 2100 and gram(df.limit(0), ["g", "h"], ["a"], "y").collect() == []
    for key in ((0, "0"), (699, "2"), (350, "1")):
        z = np.array([(1.0, a, y) for g, h, a, y in data if (g, h) == key])
        np.testing.assert_allclose(S.unpack(got[key].m), z.T @ z, rtol=1e-12)
        assert got[key].rows == len(z)


@pytest.mark.parametrize("far", [0.0, 1e6, 1e8])
def test_fits_do_not_depend_on_the_level(spark, far):
    """Slopes to 1e-6 whatever the mean, also where folds and groups lie far apart, for all models."""
    rng = np.random.default_rng(12)
    data, level_free = [], {}
    for g, level in enumerate((far, -3 * far)):
        x = rng.normal(size=(400, 2))
        y = 2 * x[:, 0] - 3 * x[:, 1] + 0.01 * rng.normal(size=400)
        exact = np.linalg.lstsq(np.c_[np.ones(400), x], y, rcond=None)[0]
        pieces = [matrix(x[k::5], y[k::5]) for k in range(5)]
        for model in ("ridge", "lasso"):
            lam = linear._best_penalty(sum(pieces), pieces, linear.PENALISED[model])
            level_free[g, model] = S.elastic_net(sum(pieces), linear.PENALISED[model], [lam])[1][0]
        data += [(g, i, *(x[i] + level).tolist(), float(y[i] + 7 * level), i % 5, *exact.tolist()) for i in range(400)]
    df = spark.createDataFrame(data, "g int, i int, a double, b double, y double, inner int, e0 double, ea double, eb double").repartition(6)
    tol = 1e-6
    want = {r.g: (r.ea, r.eb) for r in df.select("g", "ea", "eb").distinct().collect()}
    table = gram(df, ["g"], ["a", "b"], "y")
    for g, coef in by_group(linear.fit_ols(table, ["g"]), "coef").items():
        np.testing.assert_allclose(coef[0], want[g], atol=tol)
    for g, intercept, coef in [(r.g, r.intercept, r.coef) for r in linear.fit_ols(table, ["g"]).collect()]:
        level = (far, -3 * far)[g]
        assert abs(intercept - (7 * level - sum(c * level for c in coef))) < 1e-3 + 1e-6 * abs(level)
    folds = gram(df, ["g", "inner"], ["a", "b"], "y")
    found = {(r.g, r.model): r for r in linear.fit_models(folds, ["g"], ["ols", "pls", "bayes", "ridge", "lasso"]).collect()}
    near = {k: r.coef for k, r in found.items()}
    for g in want:
        for model in ("ols", "pls", "bayes"):
            np.testing.assert_allclose(near[g, model], want[g], atol=tol)
        for model in ("ridge", "lasso"):
            np.testing.assert_allclose(near[g, model], level_free[g, model], atol=tol)
    table = {(r.g, r.term): r for r in linear.coef_table(gram(df, ["g"], ["a", "b"], "y"), ["g"], ["a", "b"]).collect()}
    assert all(abs(table[g, "a"].se - 0.01 / 20) < 1e-4 for g in want)
    trained = training_matrices(folds, ["g"], "inner", list(range(5)))
    rest = gram(df.where("inner <> 3"), ["g"], ["a", "b"], "y")
    by = {r.g: r.c for r in rest.collect()}
    for r in trained.where("inner = 3").collect():
        np.testing.assert_allclose(S.Moments(r.c).co, S.Moments(by[r.g]).co, rtol=1e-6, atol=1e-3)


@pytest.mark.parametrize("far", [0.0, 1e8])
def test_panel_slopes_do_not_depend_on_the_level(spark, far):
    rng = np.random.default_rng(3)
    data = [(g, t / 10, far * g + v, 5 * far - far * g + 0.3 * t + 2 * v) for g in range(4) for t, v in enumerate(rng.normal(size=50).tolist())]
    got = fit_panel_trend(spark.createDataFrame(data, "g int, t double, a double, y double"), "g", "t", ["a"], "y").collect()
    assert len(got) == 4 and all(abs(r.coef[2] - 2) < 1e-6 and abs(r.coef[0] - 3) < 1e-4 for r in got)


def test_leave_one_out_is_a_fit_to_the_others(rows, data):
    got = {(r.g, r.ncomp): r for r in linear.loo_pls_errors(rows.repartition(5), ["g"], FEATURES, "y", 3).collect()}
    for g in ("g1", "g2", "g3"):
        x, y = dense(data, g)
        errors = []
        for i in range(len(y)):
            rest = np.arange(len(y)) != i
            a, b = S.partial_least_squares(matrix(x[rest], y[rest]), 3)
            errors.append(y[i] - a - b @ x[i])
        errors = np.array(errors)
        for k in range(4):
            assert got[g, k].rows == 60
            np.testing.assert_allclose(got[g, k].rmsep, np.sqrt((errors[:, k] ** 2).mean()), rtol=1e-9)
            np.testing.assert_allclose(got[g, k].se, errors[:, k].std(ddof=1) / np.sqrt(60), rtol=1e-9)
    pooled = linear.loo_pls_errors(rows, [], FEATURES, "y", 2).collect()
    assert {r.ncomp for r in pooled} == {0, 1, 2} and {r.rows for r in pooled} == {180}


def _mixed(seed, groups, sizes, far=0.0):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        u = rng.multivariate_normal([0, 0], [[1.0, 0.3], [0.3, 0.5]])
        for _ in range(sizes(g)):
            t, x = rng.normal(size=2)
            out.append((g, float(t), float(x + far), float(1 + u[0] + (2 + u[1]) * t - 0.7 * x + 0.5 * rng.normal())))
    return out


def _log_likelihood(data, q, cover, sigma2, reml):
    """From the dense covariance of every group."""
    xx, xy, yy, det, n = np.zeros((3, 3)), np.zeros(3), 0.0, 0.0, len(data)
    for g in {r[0] for r in data}:
        m = np.array([(1.0, r[1], r[2], r[3]) for r in data if r[0] == g])
        v = sigma2 * np.eye(len(m)) + m[:, :q] @ cover @ m[:, :q].T
        inv = np.linalg.inv(v)
        xx, xy, yy = xx + m[:, :3].T @ inv @ m[:, :3], xy + m[:, :3].T @ inv @ m[:, 3], yy + m[:, 3] @ inv @ m[:, 3]
        det += np.linalg.slogdet(v)[1]
    value = -0.5 * (det + yy - xy @ np.linalg.solve(xx, xy))
    return value - 0.5 * np.linalg.slogdet(xx)[1] if reml else value


@pytest.mark.parametrize("reml,q", [(True, 2), (False, 2), (True, 1)])
def test_mixed_model_is_at_the_maximum(spark, reml, q):
    data = _mixed(6, 12, lambda g: 5 + g)
    df = spark.createDataFrame(data, "g int, t double, x double, y double")
    fit = random_effects(gram(df, ["g"], ["t", "x"], "y").select("g", "rows", "c"), q, 3, reml)
    assert fit.converged and fit.passes < 40
    # the covariance is that of terms counted from the point, where t is not zero
    moved = [(g, t - fit.point[0], x - fit.point[1], y) for g, t, x, y in data]
    best = _log_likelihood(moved, q, fit.cover, fit.sigma2, reml)
    rng = np.random.default_rng(1)
    for _ in range(40):
        step = rng.normal(size=(q, q)) * 0.02
        worse = _log_likelihood(moved, q, fit.cover + (step + step.T) / 2, fit.sigma2 * (1 + 0.02 * rng.normal()), reml)
        assert worse <= best + 1e-9


def test_balanced_random_intercepts_have_a_closed_form(spark):
    rng = np.random.default_rng(8)
    u = rng.normal(size=9)
    t = rng.normal(size=7)
    data = [(g, float(a), float(3 + u[g] + 0.5 * a + 0.4 * rng.normal())) for g in range(9) for a in t]
    y = np.array([r[2] for r in data]).reshape(9, 7)
    slope = ((t - t.mean()) * (y - y.mean())).sum() / (9 * ((t - t.mean()) ** 2).sum())
    left = y - slope * (t - t.mean())
    within = ((left - left.mean(axis=1, keepdims=True)) ** 2).sum() / (9 * 6 - 1)
    between = 7 * ((left.mean(axis=1) - left.mean()) ** 2).sum() / 8
    df = spark.createDataFrame(data, "g int, t double, y double")
    fit = random_effects(gram(df, ["g"], ["t"], "y").select("g", "rows", "c"), 1, 2)
    np.testing.assert_allclose([fit.sigma2, fit.cover[0, 0]], [within, (between - within) / 7], rtol=1e-6)
    shrunk = 1 - within / between
    for r in fit_random_coef(df, "g", "t", [], "y", quadratic=False, random=1).collect():
        want = left.mean() + shrunk * (left[r.g].mean() - left.mean()) - slope * t.mean()
        np.testing.assert_allclose([r.intercept, r.coef[0]], [want, slope], rtol=1e-6)
        assert r.converged


def test_no_variance_between_groups_and_tiny_tables(spark):
    """The best covariance lies on the border; one group, and no row."""
    rng = np.random.default_rng(5)
    data = [(g, float(t), float(1 + 2 * t + e)) for g in range(6) for t, e in zip(range(10), rng.permutation(np.tile([-1.0, 1.0], 5)))]
    df = spark.createDataFrame(data, "g int, t double, y double")
    got = fit_random_coef(df, "g", "t", [], "y", quadratic=False, random=1).collect()
    assert len(got) == 6 and all(r.converged for r in got)
    assert fit_random_coef(df.where("g = 0"), "g", "t", [], "y", quadratic=False, random=1).count() == 1
    assert fit_random_coef(df.limit(0), "g", "t", [], "y").collect() == []


def test_huber_stops_each_group_by_itself(spark):
    rng = np.random.default_rng(2)
    data = [(0, float(i), 1 + 2.0 * i) for i in range(30)]  # exact at once
    data += [(1, float(i), float(5 - i + rng.standard_t(2))) for i in range(80)]
    df = spark.createDataFrame(data, "g int, x double, y double").repartition(4)
    got = {r.g: r for r in fit_huber(df, ["g"], ["x"], "y").collect()}
    x, y = np.array([r[1] for r in data if r[0] == 1]), np.array([r[2] for r in data if r[0] == 1])
    w = np.ones(80)
    for _ in range(500):
        z = np.c_[np.ones(80), x]
        b = np.linalg.solve(z.T @ (w[:, None] * z), z.T @ (w * y))
        left = np.abs(y - z @ b)
        w = np.minimum(1, 1.345 * np.median(left) / 0.6745 / left)
    np.testing.assert_allclose([got[1].intercept, *got[1].coef], b, rtol=1e-6)
    assert got[0].converged and got[1].converged and got[0].passes < got[1].passes
    short = {r.g: r for r in fit_huber(df, ["g"], ["x"], "y", passes=2).collect()}
    assert not short[1].converged and short[1].passes == 2 and len(short) == 2
    assert fit_huber(df, [], ["x"], "y", passes=1).count() == 1


def test_penalised_fits_are_optima():
    rng = np.random.default_rng(4)
    t = rng.normal(15, 3, (60, 4))
    x = np.c_[t, t * t]  # columns and their squares: nearly collinear
    y = x @ np.r_[np.linspace(-1, 1, 4), np.full(4, 0.02)] + rng.normal(0, 1, 60)
    g = matrix(x, y)
    path = S.penalty_path(g, 1.0)
    intercepts, coefs, done = S.elastic_net(g, 1.0, path)
    assert len(path) == 100 and done.all()
    sx = x.std(axis=0)
    for a, b, lam in zip(intercepts, coefs, path):
        slope = (x - x.mean(axis=0)).T @ (y - a - x @ b) / len(y) / sx
        assert (np.abs(slope) <= lam * (1 + 1e-6) + 1e-8).all()
        on = b != 0
        np.testing.assert_allclose(slope[on], lam * np.sign(b[on]), rtol=1e-5, atol=1e-8)


def test_weighted_and_pooled_gram(rows, data):
    pooled = gram(rows.withColumn("w", F.lit(2.0)), [], FEATURES, "y", "w").first()
    x = np.array([r[3:6] for r in data])
    y = np.array([r[6] for r in data])
    np.testing.assert_allclose(S.unpack(pooled["m"]), 2 * matrix(x, y), rtol=1e-10)


def test_fold_matrices_sum_to_total(rows):
    folded = V.block_folds(rows, "year")
    parts = gram(folded, ["g", "fold"], FEATURES, "y")
    train = {(r["g"], r["fold"]): r for r in training_matrices(parts, ["g"], "fold", ["Y1", "Y2"]).collect()}
    held = {(r["g"], r["fold"]): r for r in parts.collect()}
    total = by_group(sum_matrices(parts, ["g"]), "m")
    assert len(train) == 6
    for k, r in train.items():
        np.testing.assert_allclose(np.array(r["m"]) + np.array(held[k]["m"]), total[k[0]][0], rtol=1e-9)


def test_ols_matches_lstsq_and_aliases_later_columns(rows, data):
    extended = rows.withColumn("d", F.col("a") + F.col("b"))
    got = by_group(linear.fit_ols(gram(extended, ["g"], [*FEATURES, "d"], "y"), ["g"]), "intercept", "coef", "rank")
    for g, (intercept, coef, rank) in got.items():
        x, y = dense(data, g)
        want = np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)[0]
        np.testing.assert_allclose([intercept, *coef[:3]], want, atol=1e-8)
        assert coef[3] is None and rank == 4


def test_penalty_zero_is_ols_and_ridge_closed_form(data):
    x, y = dense(data, "g1")
    g = matrix(x, y)
    fit = S.least_squares(g)
    _, b, _ = S.elastic_net(g, 1.0, [0.0])
    np.testing.assert_allclose(b[0], fit["coef"], atol=1e-6)
    n, sx, sy = len(y), x.std(0), y.std()
    zx, zy = (x - x.mean(0)) / sx, (y - y.mean()) / sy
    lam = 0.2
    want = np.linalg.solve(zx.T @ zx / n + lam / sy * np.eye(3), zx.T @ zy / n) * sy / sx
    np.testing.assert_allclose(S.elastic_net(g, 0.0, [lam])[1][0], want, atol=1e-7)


def test_lasso_optimality(data):
    x, y = dense(data, "g2")
    lam, n, sx = 0.1, len(y), x.std(0)
    a, b, _ = S.elastic_net(matrix(x, y), 1.0, [lam])
    gradient = ((x - x.mean(0)) / sx).T @ (y - a[0] - x @ b[0]) / n
    for grad, coef in zip(gradient, b[0]):
        assert abs(grad - np.sign(coef) * lam) < 1e-6 if coef else abs(grad) <= lam + 1e-6


def test_penalised_cv_picks_from_path(rows):
    table = gram(V.inner_folds(rows, ["g", "i"], 10), ["g", "inner"], FEATURES, "y")
    got = by_group(linear.cv_elastic_net(table, ["g"], 1.0), "lambda", "coef")
    for lam, coef in got.values():
        assert lam > 0 and abs(coef[0] - 1.0) < 0.2 and abs(coef[1] + 0.5) < 0.2


def test_cv_errors_from_matrices_equal_errors_from_rows(data):
    x, y = dense(data, "g1")
    parts = [np.arange(60) % 4 == k for k in range(4)]
    pieces = [matrix(x[p], y[p]) for p in parts]
    errors = linear.tune(sum(pieces), pieces, S.partial_least_squares, 3)
    for p, row in zip(parts, errors):
        a, b = S.partial_least_squares(matrix(x[~p], y[~p]), 3)
        want = [np.sum((y[p] - a[k] - x[p] @ b[k]) ** 2) for k in range(4)]
        np.testing.assert_allclose(row, want, rtol=1e-7)


def test_pls_with_all_components_is_ols(data):
    g = matrix(*dense(data, "g3"))
    np.testing.assert_allclose(S.partial_least_squares(g, 3)[1][3], S.least_squares(g)["coef"], atol=1e-7)


def test_flat_prior_is_ols(data):
    g = matrix(*dense(data, "g3"))
    fit = S.least_squares(g)
    np.testing.assert_allclose(S.flat_posterior(g, 1e-10)["mean"], [fit["intercept"], *fit["coef"]], atol=1e-6)


def test_panel_trend_equals_dummies(rows, data):
    timed = rows.withColumn("t", (F.col("year") - 1995) / 3.0)
    fits = fit_panel_trend(timed, "g", "t", FEATURES, "y")
    with_terms, names = panel_features(timed, "t", FEATURES)
    pred = {(r["g"], r["i"]): r["pred"] for r in linear.predict(fits, with_terms, ["g"], names).collect()}
    t = np.array([(r[2] - 1995) / 3.0 for r in data])
    dummies = np.array([[r[0] == g for g in ("g1", "g2", "g3")] for r in data], float)
    x = np.c_[dummies, dummies * t[:, None], dummies * (t**2)[:, None], [r[3:6] for r in data]]
    y = np.array([r[6] for r in data])
    want = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    np.testing.assert_allclose([pred[(r[0], r[1])] for r in data], want, atol=1e-7)


def test_random_coef_shrinks_to_ols_without_group_effects(rows, data):
    timed = rows.withColumn("t", (F.col("year") - 1995) / 3.0)
    got = by_group(fit_random_coef(timed, "g", "t", FEATURES, "y"), "coef")
    for (coef,) in got.values():
        np.testing.assert_allclose(coef[2:], [1.0, -0.5, 0.0], atol=0.15)
        assert abs(coef[0]) < 0.1 and abs(coef[1]) < 0.1


def test_huber_ignores_outliers(spark):
    points = [("g", float(i), 3.0 + 2.0 * i + (0.01 if i % 2 else -0.01)) for i in range(30)]
    points += [("g", 5.0, 500.0), ("g", 20.0, -700.0)]
    df = spark.createDataFrame(points, "g string, x double, y double")
    coef = fit_huber(df, ["g"], ["x"], "y", passes=5).first()
    assert abs(coef["coef"][0] - 2.0) < 0.2


def test_predict_draws_is_mean_prediction(spark):
    draws = spark.createDataFrame([(1, "k", 1.0), (2, "k", 3.0), (1, "x", 0.5), (2, "x", 1.5)], "draw int, term string, value double")
    design = spark.createDataFrame([(7, "k", 1.0), (7, "x", 4.0)], "row int, term string, x double")
    assert linear.predict_draws(draws, design, ["row"]).first()["pred"] == pytest.approx(2.0 + 1.0 * 4.0)


def test_forest_repeats_and_beats_mean(rows):
    folded = V.block_folds(rows, "year")
    run = lambda: {
        (r["g"], r["i"]): (r["pred"], r["y"])
        for r in forest.cross_validate_forest(folded, FEATURES, "y", "fold", ["Y1", "Y2"], "g", n_trees=15, mtry=3, max_depth=5).collect()
    }
    one, two = run(), run()
    assert one == two and len(one) == 180
    pred, y = np.array(list(one.values())).T
    assert np.mean((pred - y) ** 2) < 0.7 * np.var(y)


def test_forest_grows_without_a_limit_of_depth(spark):
    # one value each, so that a tree without bagging ends only at single rows
    n = 300
    train = spark.range(n).select(F.col("id").cast("double").alias("x"), F.pow(F.lit(1.05), F.col("id")).alias("y"))
    score = forest.fit_forest(train, ["x"], "y", n_trees=1, mtry=1, min_leaf=1, bootstrap=False)
    got = score(train.select("x", F.col("y").alias("seen"))).collect()
    assert len(got) == n and all(r.pred == pytest.approx(r.seen, rel=1e-6, abs=1e-4) for r in got)


def test_forest_edges(spark):
    schema = "g string, x double, y double, t boolean"
    some = [("a", float(i), float(i > 4), True) for i in range(10)] + [("a", 1.0, None, True), ("a", None, 1.0, True), ("a", 2.0, float("nan"), True)]
    asked = [("a", 0.0, None, False), ("a", 9.0, None, False), ("b", 1.0, None, False), ("a", None, None, False), (None, 1.0, None, False)]
    options = dict(n_trees=3, min_leaf=2, bootstrap=False)
    rows = spark.createDataFrame(some + asked, schema)
    got = {(r.g, r.x): r.pred for r in forest.forest_predictions(rows, ["x"], "y", F.col("t"), ["g"], **options).where("not t").collect()}
    assert got == {("a", 0.0): pytest.approx(0.0, abs=1e-9), ("a", 9.0): pytest.approx(1.0), ("b", 1.0): None, (None, 1.0): None}
    flat = spark.createDataFrame([("a", 1.0, 5.0, True), ("a", 2.0, 5.0, True), ("a", 3.0, None, False)], schema)
    assert [r.pred for r in forest.forest_predictions(flat, ["x"], "y", F.col("t"), ["g"], **options).collect()] == [5.0]
    assert forest.forest_predictions(rows.limit(0), ["x"], "y", F.col("t"), ["g"], **options).count() == 0
    binned = forest.forest_predictions(rows, ["x"], "y", F.col("t"), ["g"], bins=4, **options).where("g = 'a' and not t").collect()
    assert sorted(r.pred for r in binned)[0] < 0.3 and sorted(r.pred for r in binned)[1] > 0.7


def test_cross_validation_covers_every_row_once_per_model(rows):
    quality, pred = V.cross_validate(rows, ["g"], FEATURES, "y", ("ols", "lasso", "pls"), row_keys=["g", "i"], response_is_log=False)
    assert {r["model"]: r["count"] for r in pred.groupBy("model").count().collect()} == {"ols": 180, "lasso": 180, "pls": 180}
    assert all(r["R2"] > 0.8 for r in quality.collect())


def test_cross_validation_leaves_out_unseen_groups(rows):
    lone = rows.where("g <> 'g3' or year = 1990")
    _, pred = V.cross_validate(lone, ["g"], FEATURES, "y", ("ols",), row_keys=["g", "i"], response_is_log=False)
    assert {r["g"] for r in pred.select("g").distinct().collect()} == {"g1", "g2"}


def test_perfect_fit_scores(rows):
    r = gof(rows.withColumn("s", F.col("y")), [], "s", "y").first()
    assert r["RMSE"] == 0 and r["NSE"] == 1 and r["KGE"] == pytest.approx(1) and r["d"] == 1 and r["bR2"] == pytest.approx(1)


def test_spline_limits():
    x = np.arange(30.0)
    y = np.sin(x / 4) + 0.1 * np.cos(5 * x)
    w = np.ones(30)
    line = np.polyval(np.polyfit(x, y, 1), x)
    np.testing.assert_allclose(smooth(x, y, w, 0.0, lam=1e4), line, atol=1e-3)
    np.testing.assert_allclose(smooth(x, y, w, 0.0, lam=1e-12), y, atol=1e-4)
    fitted = smooth(x, np.sin(x / 4), w, 0.0)
    np.testing.assert_allclose(fitted, np.sin(x / 4), atol=1e-2)


def test_long_spline_uses_fewer_knots():
    x = np.arange(400.0)
    fitted = smooth(x, np.sin(x / 40), np.ones(400), 0.0)
    np.testing.assert_allclose(fitted, np.sin(x / 40), atol=1e-3)


def series(spark, fn, n=24):
    return spark.createDataFrame([("s", 1990 + i, float(fn(i))) for i in range(n)], "k string, year int, v double")


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_polynomials_are_exact_on_polynomials(spark, degree):
    df = series(spark, lambda i: 5 + 2 * i - 0.3 * i**degree)
    assert poly_trend(df, ["k"], "year", "v", degree).agg(F.max(F.abs("resid"))).first()[0] < 1e-7


def test_loess_is_exact_on_a_parabola_and_takes_duplicates(spark):
    df = series(spark, lambda i: 5 + 2 * i - 0.3 * i * i)
    assert loess_trend(df, ["k"], "year", "v").agg(F.max(F.abs("resid"))).first()[0] < 0.2
    twice = df.unionByName(df)
    assert loess_trend(twice, ["k"], "year", "v").count() == 48


def test_detrended_line_is_flat_after_base_year(spark):
    trend = detrend(series(spark, lambda i: 3 + 0.5 * i), ["k"], "year", "v", ["lin"])
    out = {(r["type"], r["year"]): r["value"] for r in rebase_after(trend, ["k", "method"], "year", "v", [1999, 2005]).collect()}
    assert out[("y1999", 1995)] == out[("OBS", 1995)]
    assert out[("y1999", 2010)] == pytest.approx(out[("OBS", 1999)])
    assert out[("y2005", 2004)] == out[("OBS", 2004)] and out[("y2005", 2013)] == pytest.approx(out[("OBS", 2005)])


def test_spline_trend_skips_short_and_flat(spark):
    rows = [("long", i, float(i % 4)) for i in range(12)] + [("short", i, float(i)) for i in range(4)] + [("flat", i, 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, x int, v double")
    assert {r["k"] for r in spline_trend(df, ["k"], "x", "v").collect()} == {"long"}


def test_month_panel_models_improve_on_mean(spark):
    panel = month_panel(spark, "/root/testdata/sf0.001")
    quality, _ = V.cross_validate(panel, ["departement"], ["Tn", "PR"], "log_yield", ("ols", "ridge"), row_keys=["departement", "year", "month"], observed="yield")
    assert all(r["NSE"] > 0 for r in quality.collect())
