"""Queries on model fits, cross-validation, scores and scenario impact."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.plans.rounding import round_doubles, rounded
from furrow.operators import forest, impact, linear
from furrow.operators import validate as V
from furrow.operators.aggregates import rank_models
from furrow.operators.gram import gram
from furrow.operators.panel_models import fit_panel_trend, fit_random_coef, panel_features
from furrow.operators.quality import gof, residuals, rmse
from furrow.operators.reshape import to_wide
from furrow.operators.robust import fit_huber
from furrow.operators.scenario import normalise_by_reference
from furrow.plans.catalog import query
from furrow.plans.inputs import month_panel, yield_panel
from furrow.plans.sql import PANEL, YIELD, fold_sql, gof_sql, ols_sql, r, uniform
from furrow.plans.trend_queries import REBASE, scenarios

FEATURES = ["Tn", "gap", "PR", "ETP"]
SQL_FEATURES = ["tn", "(tx - tn)", "pr", "etp"]
ROW = ["departement", "year", "month"]


def packed_cells(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


@query("m0_gram", f"WITH {PANEL}, z AS (SELECT departement, 1.0 AS z0, tn AS z1, pr AS z2, log_yield AS z3 FROM mp) " + " UNION ALL ".join(
    f"SELECT departement, {n} AS cell, count(*) AS rows, {r(f'sum(z{i} * z{j})', 'value', 4)} FROM z GROUP BY departement"
    for n, (i, j) in enumerate(packed_cells(4))))
def _(spark, d):
    g = gram(month_panel(spark, d), ["departement"], ["Tn", "PR"], "log_yield")
    return round_doubles(g.select("departement", "rows", F.posexplode("m").alias("cell", "value")), 4)


WIDE_NAMES = [f"{v}_{m}" for v in ("Tn", "PR") for m in range(1, 13)]


@query("m0_gram_many_features", f"""WITH {PANEL}, base AS (SELECT departement, year, avg(log_yield) AS ly FROM mp GROUP BY ALL HAVING count(*) = 12),
long AS (SELECT departement, year, m.month AS i, tn AS v FROM mp m JOIN base USING (departement, year)
 UNION ALL SELECT departement, year, month + 12, pr FROM mp JOIN base USING (departement, year)
 UNION ALL SELECT departement, year, 0, 1.0 FROM base
 UNION ALL SELECT departement, year, 25, ly FROM base)
SELECT a.year, CAST(a.i * 26 - a.i * (a.i - 1) // 2 + b.i - a.i AS INTEGER) AS cell, {r('sum(a.v * b.v)', 'value', 4)} FROM long a JOIN long b ON a.departement = b.departement AND a.year = b.year AND a.i <= b.i GROUP BY ALL""")
def _(spark, d):
    panel = month_panel(spark, d)
    cell = lambda v, m: F.max(F.when(F.col("month") == m, F.col(v))).alias(f"{v}_{m}")
    wide = panel.groupBy("departement", "year").agg(F.avg("log_yield").alias("ly"), *[cell(v, m) for v in ("Tn", "PR") for m in range(1, 13)])
    g = gram(wide, ["year"], WIDE_NAMES, "ly")
    return round_doubles(g.select("year", F.posexplode("m").alias("cell", "value")), 4)


IN_SAMPLE = PANEL + "," + ols_sql("g", "mp", "departement", SQL_FEATURES, "log_yield")


@query("m1_fit_ols", f"WITH {IN_SAMPLE} SELECT departement, year, month, {r('pred', 'pred')} FROM g_fit")
def _(spark, d):
    panel = month_panel(spark, d)
    fits = linear.fit_ols(gram(panel, ["departement"], FEATURES, "log_yield"), ["departement"])
    return round_doubles(linear.predict(fits, panel, ["departement"], FEATURES).select(*ROW, "pred"))


@query("m1_ols_one_feature", f"""WITH {PANEL}
SELECT departement, {r('regr_intercept(log_yield, pr)', 'intercept')}, {r('regr_slope(log_yield, pr)', 'slope')}, NULL::DOUBLE AS aliased FROM mp GROUP BY departement""")
def _(spark, d):
    panel = month_panel(spark, d).withColumn("PR2", 2 * F.col("PR"))
    fits = linear.fit_ols(gram(panel, ["departement"], ["PR", "PR2"], "log_yield"), ["departement"])
    return round_doubles(fits.select("departement", "intercept", F.col("coef")[0].alias("slope"), F.col("coef")[1].alias("aliased")))


def _panel_trend_sql(w: str) -> str:
    o = "OVER (PARTITION BY departement)"
    cols = {"f0": "tn", "f1": "pr", "f2": "log_yield"}
    mean = lambda e: f"sum({w} * {e}) {o} / sum({w}) {o}"
    proj = lambda e, q: f"sum({w} * {e} * {q}) {o} / sum({w} * {q} * {q}) {o} * {q}"
    return f"""
a0 AS (SELECT *, (year - avg(year) OVER ()) / stddev_samp(year) OVER () AS t FROM mp),
a1 AS (SELECT *, t - {mean('t')} AS q1, t * t - {mean('t * t')} AS s2, {', '.join(f'{e} - {mean(e)} AS {n}' for n, e in cols.items())} FROM a0),
a2 AS (SELECT *, s2 - {proj('s2', 'q1')} AS q2 FROM a1),
a3 AS (SELECT *, {', '.join(f'{n} - {proj(n, "q1")} - {proj(n, "q2")} AS h{n[1]}' for n in cols)} FROM a2),
a4 AS (SELECT *, h1 - sum({w} * h1 * h0) OVER () / sum({w} * h0 * h0) OVER () * h0 AS k1 FROM a3),
a5 AS (SELECT *, log_yield - (h2 - sum({w} * h2 * h0) OVER () / sum({w} * h0 * h0) OVER () * h0 - sum({w} * h2 * k1) OVER () / sum({w} * k1 * k1) OVER () * k1) AS pred FROM a4)"""


def _z_year(spark, d):
    from furrow.operators.aggregates import zscore

    return zscore(month_panel(spark, d), ["year"])


@query("m2_fit_panel_trend", f"WITH {PANEL}, {_panel_trend_sql('1.0')} SELECT departement, year, month, {r('pred', 'pred')} FROM a5")
def _(spark, d):
    panel = _z_year(spark, d)
    fits = fit_panel_trend(panel, "departement", "year_z", ["Tn", "PR"], "log_yield")
    rows, names = panel_features(panel, "year_z", ["Tn", "PR"])
    return round_doubles(linear.predict(fits, rows, ["departement"], names).select(*ROW, "pred"))


@query("m3_weighted_panel_trend", f"WITH {PANEL}, {_panel_trend_sql('area')} SELECT departement, year, month, {r('pred', 'pred')} FROM a5")
def _(spark, d):
    panel = _z_year(spark, d)
    fits = fit_panel_trend(panel, "departement", "year_z", ["Tn", "PR"], "log_yield", weight="area")
    rows, names = panel_features(panel, "year_z", ["Tn", "PR"])
    return round_doubles(linear.predict(fits, rows, ["departement"], names).select(*ROW, "pred"))


def _descent_sql() -> str:
    """Coordinate descent over four scaled features as one recursive query."""
    f = ["tn", "gp", "pr", "etp"]
    cor = ", ".join(f"corr({f[i]}, {f[j]}) AS r{i}{j}" for i in range(4) for j in range(i + 1, 4))
    rr = lambda i, j: f"r{min(i, j)}{max(i, j)}"

    def update(j: int) -> str:
        rest = " - ".join([f"c{j}"] + [f"{rr(i, j)} * {'n' if i < j else 'b'}{i}" for i in range(4) if i != j])
        return f"{rest} AS t{j}, sign(t{j}) * greatest(abs(t{j}) - lam * alpha, 0) / (1 + lam * (1 - alpha)) AS n{j}"

    return f"""
st AS (SELECT departement, count(*) n, {cor}, {', '.join(f'corr({x}, log_yield) AS c{i}, stddev_pop({x}) AS s{i}, avg({x}) AS m{i}' for i, x in enumerate(f))},
  stddev_pop(log_yield) AS sy, avg(log_yield) AS my FROM (SELECT *, tx - tn AS gp FROM mp) GROUP BY departement),
par AS (SELECT st.*, model, alpha, 0.005 / sy AS lam FROM st, (VALUES ('lasso', 1.0), ('ridge', 0.0), ('elnet', 0.5)) a(model, alpha)),
cd AS (SELECT departement, model, 0 AS it, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3 FROM par
  UNION ALL SELECT departement, model, it + 1, n0, n1, n2, n3 FROM (
    SELECT cd.departement, cd.model, it, {', '.join(update(j) for j in range(4))}
    FROM cd JOIN par ON cd.departement = par.departement AND cd.model = par.model WHERE it < 400)),
en AS (SELECT par.*, {', '.join(f'b{i} * sy / s{i} AS k{i}' for i in range(4))} FROM cd JOIN par ON cd.departement = par.departement AND cd.model = par.model WHERE it = 400)"""


@query("m4_elastic_net", f"""WITH RECURSIVE {PANEL}, {_descent_sql()}
SELECT departement, model, {r('my - k0 * m0 - k1 * m1 - k2 * m2 - k3 * m3', 'intercept')}, {', '.join(r(f'k{i}', f'"{n}"') for i, n in enumerate(FEATURES))} FROM en""")
def _(spark, d):
    table = gram(month_panel(spark, d), ["departement"], FEATURES, "log_yield")
    fits = None
    for model, alpha in linear.PENALISED.items():
        one = linear.fit_elastic_net(table, ["departement"], alpha, [0.005], name=model)
        fits = one if fits is None else fits.unionByName(one)
    return round_doubles(fits.select("departement", "model", "intercept", *[F.col("coef")[i].alias(n) for i, n in enumerate(FEATURES)]))


INNER = "CAST(floor(" + uniform("departement || '|' || CAST(year AS VARCHAR) || '|' || CAST(month AS VARCHAR)", 7) + " * 10) AS INTEGER) AS inner_fold"


def _net_cv_sql(alpha: float, tag: str, steps: int = 100, sweeps: int = 300) -> str:
    """Coordinate descent for every group, left-out part (-1: none) and penalty at once; CTEs end in ``tag``."""
    f = ["tn", "gp", "pr", "etp"]
    cor = ", ".join(f"corr({f[i]}, {f[j]}) AS r{i}{j}" for i in range(4) for j in range(i + 1, 4))
    rr = lambda i, j: f"r{min(i, j)}{max(i, j)}"

    def update(j: int) -> str:
        rest = " - ".join([f"c{j}"] + [f"{rr(i, j)} * {'n' if i < j else 'b'}{i}" for i in range(4) if i != j])
        return f"{rest} AS t{j}, sign(t{j}) * greatest(abs(t{j}) - lam * {alpha}, 0) / (1 + lam * {1 - alpha}) AS n{j}"

    bs = ", ".join(f"b{i}" for i in range(4))
    return f"""
fo{tag} AS (SELECT *, tx - tn AS gp, {INNER} FROM mp),
st{tag} AS (SELECT departement, part, {cor}, {', '.join(f'corr({x}, log_yield) AS c{i}, stddev_pop({x}) AS s{i}, avg({x}) AS m{i}' for i, x in enumerate(f))},
  stddev_pop(log_yield) AS sy, avg(log_yield) AS my FROM fo{tag}, (SELECT unnest(range(-1, 10)) AS part) WHERE inner_fold <> part GROUP BY departement, part),
pa{tag} AS (SELECT departement, k, sy * greatest(abs(c0), abs(c1), abs(c2), abs(c3)) / {max(alpha, 1e-3)} * pow(1e-4, k / {steps - 1}.0) AS penalty FROM st{tag}, (SELECT unnest(range({steps})) AS k) WHERE part = -1),
par{tag} AS (SELECT st{tag}.*, k, penalty, penalty / sy AS lam FROM st{tag} JOIN pa{tag} USING (departement)),
cd{tag} AS (SELECT departement, part, k, 0 AS it, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(4))} FROM par{tag}
  UNION ALL SELECT departement, part, k, it + 1, n0, n1, n2, n3 FROM (
    SELECT cd{tag}.departement, cd{tag}.part, cd{tag}.k, it, {', '.join(update(j) for j in range(4))}
    FROM cd{tag} JOIN par{tag} ON cd{tag}.departement = par{tag}.departement AND cd{tag}.part = par{tag}.part AND cd{tag}.k = par{tag}.k WHERE it < {sweeps})),
co{tag} AS (SELECT par{tag}.departement, par{tag}.part, par{tag}.k, penalty, my, {', '.join(f'b{i} * sy / s{i} AS k{i}, m{i}' for i in range(4))}
  FROM (SELECT departement, part, k, {bs} FROM cd{tag} WHERE it = {sweeps}) cd JOIN par{tag} USING (departement, part, k)),
er{tag} AS (SELECT fo{tag}.departement, k, sum(pow(log_yield - my - {' - '.join(f'k{i} * ({x} - m{i})' for i, x in enumerate(f))}, 2)) AS sse
  FROM fo{tag} JOIN co{tag} ON fo{tag}.departement = co{tag}.departement AND fo{tag}.inner_fold = co{tag}.part GROUP BY ALL),
be{tag} AS (SELECT departement, k FROM er{tag} QUALIFY row_number() OVER (PARTITION BY departement ORDER BY sse, k) = 1)"""


NETS = {"lasso": 1.0, "ridge": 0.0, "elnet": 0.5}


@query("m5_cv_elastic_net", f"""WITH RECURSIVE {PANEL}, {", ".join(_net_cv_sql(a, f"_{m}") for m, a in NETS.items())} """ + " UNION ALL ".join(
    f"""SELECT departement, '{m}' AS model, {r('penalty', '"lambda"', 5)}, {', '.join(r(f'k{i}', f'"{n}"', 5) for i, n in enumerate(FEATURES))}
FROM co_{m} JOIN be_{m} USING (departement, k) WHERE part = -1""" for m in NETS))
def _(spark, d):
    rows = V.inner_folds(month_panel(spark, d), ROW, 10)
    table = gram(rows, ["departement", "inner"], FEATURES, "log_yield")
    fits = reduce(DataFrame.unionByName, [linear.cv_elastic_net(table, ["departement"], a, m) for m, a in NETS.items()])
    return round_doubles(fits.select("departement", "model", "lambda", *[F.col("coef")[i].alias(n) for i, n in enumerate(FEATURES)]), 5)


def _pls_sql(components: int, tag: str = "") -> str:
    f = ["tn", "(tx - tn)", "pr", "etp"]
    o = "OVER (PARTITION BY departement)"
    steps = [
        f"q0{tag} AS (SELECT *, {', '.join(f'{x} - avg({x}) {o} AS x0_{i}' for i, x in enumerate(f))}, log_yield - avg(log_yield) {o} AS v0, avg(log_yield) {o} AS p0 FROM mp)"
    ]
    for a in range(components):
        xs = [f"x{a}_{i}" for i in range(4)]
        steps.append(f"w{a}{tag} AS (SELECT *, {' + '.join(f'sum({x} * v{a}) {o} * {x}' for x in xs)} AS t{a} FROM q{a}{tag})")
        t = f"t{a}"
        steps.append(
            f"q{a + 1}{tag} AS (SELECT *, {', '.join(f'{x} - sum({x} * {t}) {o} / sum({t} * {t}) {o} * {t} AS x{a + 1}_{i}' for i, x in enumerate(xs))}, "
            f"v{a} - sum(v{a} * {t}) {o} / sum({t} * {t}) {o} * {t} AS v{a + 1}, p{a} + sum(v{a} * {t}) {o} / sum({t} * {t}) {o} * {t} AS p{a + 1} FROM w{a}{tag})"
        )
    return ",\n".join(steps)


@query("m6_fit_pls", f"WITH {PANEL}, {_pls_sql(3)} SELECT departement, year, month, {r('p3', 'pred')} FROM q3")
def _(spark, d):
    panel = month_panel(spark, d)
    fits = linear.fit_pls(gram(panel, ["departement"], FEATURES, "log_yield"), ["departement"], 3)
    return round_doubles(linear.predict(fits, panel, ["departement"], FEATURES).select(*ROW, "pred"))


def _pls_cv_sql(components: int) -> str:
    f = SQL_FEATURES
    o = "OVER (PARTITION BY departement, part)"
    mean = lambda e: f"sum(w * {e}) {o} / sum(w) {o}"
    steps = [
        f"fo AS (SELECT *, {INNER} FROM mp)",
        "ex AS (SELECT *, CASE WHEN inner_fold <> part THEN 1.0 ELSE 0.0 END AS w FROM fo, (SELECT unnest(range(10)) AS part))",
        f"q0 AS (SELECT *, {', '.join(f'{x} - {mean(x)} AS x0_{i}' for i, x in enumerate(f))}, log_yield - {mean('log_yield')} AS v0 FROM ex)",
    ]
    for a in range(components):
        xs, t = [f"x{a}_{i}" for i in range(4)], f"t{a}"
        along = lambda e: f"sum(w * {e} * {t}) {o} / sum(w * {t} * {t}) {o} * {t}"
        steps.append(f"w{a} AS (SELECT *, {' + '.join(f'sum(w * {x} * v{a}) {o} * {x}' for x in xs)} AS {t} FROM q{a})")
        steps.append(f"q{a + 1} AS (SELECT *, {', '.join(f'{x} - {along(x)} AS x{a + 1}_{i}' for i, x in enumerate(xs))}, v{a} - {along(f'v{a}')} AS v{a + 1} FROM w{a})")
    return ",\n".join(steps)


@query("m6_cv_pls_errors", f"WITH {PANEL}, {_pls_cv_sql(3)} " + " UNION ALL ".join(
    f"""SELECT departement, inner_fold AS "inner", {k} AS ncomp, {r(f'sqrt(avg(v{k} * v{k}))', 'rmsep')}, count(*)::DOUBLE AS rows FROM q3 WHERE inner_fold = part GROUP BY ALL""" for k in range(4)))
def _(spark, d):
    rows = V.inner_folds(month_panel(spark, d), ROW, 10)
    return round_doubles(linear.cv_pls_errors(gram(rows, ["departement", "inner"], FEATURES, "log_yield"), ["departement"], 3))


NCOMP = _pls_cv_sql(4) + """,
e AS (""" + " UNION ALL ".join(
    f"SELECT departement, inner_fold AS part, {k} AS ncomp, sqrt(avg(v{k} * v{k})) AS rmsep, count(*)::DOUBLE AS rows FROM q4 WHERE inner_fold = part GROUP BY ALL" for k in range(5)) + """),
c AS (SELECT departement, ncomp, sqrt(sum(rmsep * rmsep * rows) / sum(rows)) AS rm, stddev_samp(rmsep) / sqrt(count(*)) AS se FROM e GROUP BY ALL),
b AS (SELECT departement, rm AS best, se AS bse FROM c QUALIFY row_number() OVER (PARTITION BY departement ORDER BY rm, ncomp) = 1),
nc AS (SELECT departement, CAST(greatest(min(ncomp), 1) AS INTEGER) AS ncomp FROM c JOIN b USING (departement) WHERE rm <= best + bse GROUP BY ALL)"""


ANNUAL = "an AS (SELECT departement, year, avg(tn) AS tn, avg(tx) AS tx, avg(pr) AS pr, avg(etp) AS etp, avg(log_yield) AS log_yield FROM mp GROUP BY departement, year)"


def _annual(spark, d):
    return month_panel(spark, d).groupBy("departement", "year").agg(*[F.avg(c).alias(c) for c in [*FEATURES, "log_yield"]])


def _pls_loo_sql(components: int) -> str:
    """Every row left out in turn and the model fitted anew to the others."""
    o = "OVER (PARTITION BY departement, part)"
    mean = lambda e: f"sum(w * {e}) {o} / sum(w) {o}"
    steps = [
        ANNUAL,
        "ex AS (SELECT a.*, b.year AS part, CASE WHEN a.year <> b.year THEN 1.0 ELSE 0.0 END AS w FROM an a JOIN (SELECT departement, year FROM an) b USING (departement))".replace("b USING (departement)", "b ON a.departement = b.departement"),
        f"q0 AS (SELECT *, {', '.join(f'{x} - {mean(x)} AS x0_{i}' for i, x in enumerate(SQL_FEATURES))}, log_yield - {mean('log_yield')} AS v0 FROM ex)",
    ]
    for a in range(components):
        xs, t = [f"x{a}_{i}" for i in range(4)], f"t{a}"
        along = lambda e: f"sum(w * {e} * {t}) {o} / sum(w * {t} * {t}) {o} * {t}"
        steps.append(f"w{a} AS (SELECT *, {' + '.join(f'sum(w * {x} * v{a}) {o} * {x}' for x in xs)} AS {t} FROM q{a})")
        steps.append(f"q{a + 1} AS (SELECT *, {', '.join(f'{x} - {along(x)} AS x{a + 1}_{i}' for i, x in enumerate(xs))}, v{a} - {along(f'v{a}')} AS v{a + 1} FROM w{a})")
    return ",\n".join(steps)


@query("m6_loo_pls_errors", f"WITH {PANEL}, {_pls_loo_sql(3)} " + " UNION ALL ".join(
    f"""SELECT departement, {k} AS ncomp, {r(f'sqrt(avg(v{k} * v{k}))', 'rmsep', 5)}, {r(f'stddev_samp(v{k}) / sqrt(count(*))', 'se', 5)}, count(*) AS rows
 FROM q3 WHERE year = part GROUP BY departement HAVING count(*) > 2""" for k in range(4)))
def _(spark, d):
    return round_doubles(linear.loo_pls_errors(_annual(spark, d), ["departement"], FEATURES, "log_yield", 3), 5)


@query("m7_select_ncomp_loo", f"""WITH {PANEL}, {_pls_loo_sql(3)}, e AS (""" + " UNION ALL ".join(
    f"SELECT departement, {k} AS ncomp, sqrt(avg(v{k} * v{k})) AS rmsep, stddev_samp(v{k}) / sqrt(count(*)) AS se FROM q3 WHERE year = part GROUP BY departement HAVING count(*) > 2" for k in range(4)) + """),
b AS (SELECT departement, rmsep + se AS upto FROM e QUALIFY row_number() OVER (PARTITION BY departement ORDER BY rmsep, ncomp) = 1)
SELECT departement, CAST(greatest(min(ncomp), 1) AS INTEGER) AS ncomp FROM e JOIN b USING (departement) WHERE rmsep <= upto GROUP BY departement""")
def _(spark, d):
    curve = linear.loo_pls_errors(_annual(spark, d), ["departement"], FEATURES, "log_yield", 3)
    return linear.select_ncomp_loo(curve, ["departement"])


@query("m7_select_ncomp", f"WITH {PANEL}, {NCOMP} SELECT departement, ncomp FROM nc")
def _(spark, d):
    rows = V.inner_folds(month_panel(spark, d), ROW, 10)
    errors = linear.cv_pls_errors(gram(rows, ["departement", "inner"], FEATURES, "log_yield"), ["departement"], len(FEATURES))
    return linear.select_ncomp(errors, ["departement"])


@query("m8_forest_cross_validated")
def _(spark, d):
    folded = V.block_folds(month_panel(spark, d), "year")
    scored = forest.cross_validate_forest(folded, FEATURES, "log_yield", "fold", V.fold_labels(V.TWO_FOLDS), "departement")
    return round_doubles(scored.select(*ROW, "fold", "model", "pred"))


def _tree_sql(min_leaf: int = 5) -> str:
    """One tree per fold and department over all rows and features: a step of the recursion is a level."""
    node = "turn, departement, node"
    return f"""WITH RECURSIVE {PANEL}, fo AS (SELECT *, {fold_sql('year', (0.5, 1.0))} AS fold FROM mp),
turns AS (SELECT fo.*, turn, fold <> turn AS learn FROM fo, (VALUES ('Y1'), ('Y2')) v(turn)),
lim AS (SELECT min(log_yield) AS lo, max(log_yield) AS hi FROM turns WHERE learn),
b AS (SELECT turn, departement, year, month, fold, learn, [{', '.join(r(x) for x in SQL_FEATURES)}] AS x,
  CAST(round(((log_yield - lo) / (hi - lo) - 0.5) * {1 << 40}) AS BIGINT) AS u FROM turns, lim),
grown AS (
  SELECT *, '' AS node, true AS open FROM b
  UNION ALL
  SELECT * FROM (
    WITH cells AS (SELECT {node}, k, x[k] AS v, count(*) AS n, sum(u) AS s, min(u) AS low, max(u) AS high
      FROM grown, (SELECT unnest(range(1, {len(SQL_FEATURES) + 1})) AS k) WHERE open AND learn GROUP BY ALL),
    runs AS (SELECT {node}, k, v, lead(v) OVER o AS nxt, sum(n) OVER o AS n1, sum(s) OVER o AS s1,
      sum(n) OVER w AS n, sum(s) OVER w AS s, min(low) OVER w AS low, max(high) OVER w AS high
      FROM cells WINDOW o AS (PARTITION BY {node}, k ORDER BY v ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY {node}, k)),
    scored AS (SELECT *, s1::DOUBLE * s1::DOUBLE / n1::DOUBLE + (s - s1)::DOUBLE * (s - s1)::DOUBLE / (n - n1)::DOUBLE AS score
      FROM runs WHERE nxt IS NOT NULL AND n1 >= {min_leaf} AND n - n1 >= {min_leaf} AND low < high),
    best AS (SELECT {node}, k, (v + nxt) / 2 AS border FROM scored QUALIFY row_number() OVER (PARTITION BY {node} ORDER BY score DESC, k, v) = 1)
    SELECT g.turn, g.departement, year, month, fold, learn, x, u,
      g.node || CASE WHEN k IS NULL THEN '' WHEN x[k] <= border THEN 'l' ELSE 'r' END AS node, k IS NOT NULL AS open
    FROM grown g LEFT JOIN best USING ({node}) WHERE g.open)),
leaf AS (SELECT {node}, sum(u)::DOUBLE / count(*) AS mean FROM grown WHERE learn AND NOT open GROUP BY ALL)
SELECT departement, year, month, fold, 'rf' AS model, {r(f'(mean / {1 << 40} + 0.5) * (hi - lo) + lo', 'pred')}
FROM grown LEFT JOIN leaf USING ({node}), lim WHERE NOT learn AND NOT open"""


@query("m8_tree_cross_validated", _tree_sql())
def _(spark, d):
    panel = month_panel(spark, d).withColumns({f: rounded(f, 6) for f in FEATURES})
    folded = V.block_folds(panel, "year")
    scored = forest.cross_validate_forest(
        folded, FEATURES, "log_yield", "fold", V.fold_labels(V.TWO_FOLDS), "departement", n_trees=1, mtry=len(FEATURES), bootstrap=False
    )
    return round_doubles(scored.select(*ROW, "fold", "model", "pred"))


@query("m9_random_coef")
def _(spark, d):
    fits = fit_random_coef(_z_year(spark, d), "departement", "year_z", ["Tn", "PR"], "log_yield")
    return round_doubles(fits.select("departement", "intercept", "coef", "converged"), 4)


def _mixed_sql(levels: int = 12) -> str:
    """Random intercepts: the likelihood of the residuals on ever finer grids of the variance share."""
    f = ["t", "tn", "pr", "y"]
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    mean = lambda x: f"sum(k * {x}) / sum(k)"
    steps = [
        "z AS (SELECT departement, (year - avg(year) OVER ()) / stddev_samp(year) OVER () AS t, tn, pr, log_yield AS y FROM mp)",
        f"gm AS (SELECT departement, count(*)::DOUBLE AS n, {', '.join(f'avg({x}) AS {x}' for x in f)}, {', '.join(f'covar_pop({f[i]}, {f[j]}) * count(*) AS w{i}{j}' for i, j in pairs)} FROM z GROUP BY departement)",
        f"wi AS (SELECT sum(n) AS total, {', '.join(f'sum(w{i}{j}) AS w{i}{j}' for i, j in pairs)} FROM gm)",
        "l0 AS (SELECT 0.0::DOUBLE AS lo, 0.999999::DOUBLE AS hi)",
    ]
    for k in range(levels):
        steps += [
            f"g{k} AS MATERIALIZED (SELECT lo + (hi - lo) * i / 40.0 AS share, (hi - lo) / 40.0 AS step FROM l{k}, (SELECT unnest(range(41)) AS i))",
            f"v{k} AS MATERIALIZED ({_mixed_value(f'g{k}', f, pairs, mean)})",
            f"l{k + 1} AS MATERIALIZED (SELECT greatest(share - step, 0.0) AS lo, least(share + step, 0.999999) AS hi FROM v{k} QUALIFY row_number() OVER (ORDER BY loglik DESC, share) = 1)",
        ]
    return ",\n".join(steps)


def _mixed_value(grid: str, f: list[str], pairs: list, mean) -> str:
    """Per share of the grid: likelihood, slopes and the mean of y less their part."""
    s = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    det = "(s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02))"

    def slope(k: int) -> str:
        c = [[s(i, j) if j != k else s(i, 3) for j in range(3)] for i in range(3)]
        return (f"({c[0][0]} * ({c[1][1]} * {c[2][2]} - {c[1][2]} * {c[2][1]}) - {c[0][1]} * ({c[1][0]} * {c[2][2]} - {c[1][2]} * {c[2][0]})"
                f" + {c[0][2]} * ({c[1][0]} * {c[2][1]} - {c[1][1]} * {c[2][0]})) / {det}")

    return f"""SELECT *, -0.5 * ((total - 4) * ln(s33 - b0 * s03 - b1 * s13 - b2 * s23) + dets + ln(ks * {det})) AS loglik,
      m3 - b0 * m0 - b1 * m1 - b2 * m2 AS level, (s33 - b0 * s03 - b1 * s13 - b2 * s23) / (total - 4) AS sigma2 FROM (
    SELECT *, {', '.join(f'{slope(k)} AS b{k}' for k in range(3))} FROM (
    SELECT share, step, ks, dets, total, {', '.join(f'm{i}' for i in range(4))}, {', '.join(f'w{i}{j} + k{i}{j} - ks * m{i} * m{j} AS s{i}{j}' for i, j in pairs)} FROM (
    SELECT share, step, sum(k) AS ks, sum(ln(1 + n * share / (1 - share))) AS dets, {', '.join(f'{mean(x)} AS m{i}' for i, x in enumerate(f))},
      {', '.join(f'sum(k * {f[i]} * {f[j]}) AS k{i}{j}' for i, j in pairs)} FROM (SELECT {grid}.*, gm.*, n / (1 + n * share / (1 - share)) AS k FROM {grid}, gm) GROUP BY share, step), wi))"""


@query("m9_random_intercept", f"""WITH {PANEL}, {_mixed_sql()},
best AS (SELECT * FROM v11 QUALIFY row_number() OVER (ORDER BY loglik DESC, share) = 1)
SELECT departement, {r('level + share / (1 - share) * n / (1 + n * share / (1 - share)) * (y - level - b0 * t - b1 * tn - b2 * pr)', 'intercept', 4)},
 {r('b0', 'trend', 5)}, {r('b1', '"Tn"', 5)}, {r('b2', '"PR"', 5)}, true AS converged FROM gm, best""")
def _(spark, d):
    fits = fit_random_coef(_z_year(spark, d), "departement", "year_z", ["Tn", "PR"], "log_yield", quadratic=False, random=1)
    b = lambda i, name: rounded(F.col("coef")[i], 5).alias(name)
    return fits.select("departement", rounded("intercept", 4).alias("intercept"), b(0, "trend"), b(1, "Tn"), b(2, "PR"), "converged")


TWO = PANEL + """,
tw AS (SELECT departement, count(*) n, avg(tn) m1, avg(pr) m2, avg(log_yield) my, var_pop(tn) * count(*) s11, var_pop(pr) * count(*) s22,
  covar_pop(tn, pr) * count(*) s12, covar_pop(tn, log_yield) * count(*) s1y, covar_pop(pr, log_yield) * count(*) s2y, var_pop(log_yield) * count(*) syy FROM mp GROUP BY departement),
tb AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM tw),
tc AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS v FROM tb),
td AS (SELECT departement, 'intercept' AS term, b0 AS est, sqrt(v * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) AS se FROM tc
  UNION ALL SELECT departement, 'Tn', b1, sqrt(v * s22 / det) FROM tc UNION ALL SELECT departement, 'PR', b2, sqrt(v * s11 / det) FROM tc)"""


@query("m10_bayes_linear", f"""WITH {TWO} SELECT departement, term, {r('est', 'mean', 5)}, {r('se', 'sd', 5)},
 {r('est - 1.959963984540054 * se', 'low', 5)}, {r('est + 1.959963984540054 * se', 'high', 5)} FROM td""")
def _(spark, d):
    g = gram(month_panel(spark, d), ["departement"], ["Tn", "PR"], "log_yield")
    return round_doubles(linear.fit_bayes_linear(g, ["departement"], ["Tn", "PR"]), 5)


@query("m25_coef_table", f"""WITH {TWO} SELECT departement, term, {r('est', 'estimate')}, {r('se', 'se')}, {r('est / se', 't', 4)} FROM td""")
def _(spark, d):
    g = gram(month_panel(spark, d), ["departement"], ["Tn", "PR"], "log_yield")
    t = linear.coef_table(g, ["departement"], ["Tn", "PR"])
    return t.select("departement", "term", rounded("estimate", 6).alias("estimate"), rounded("se", 6).alias("se"), rounded("t", 4).alias("t"))


@query("m11_predict_draws", f"""WITH {PANEL}, c AS (SELECT avg(i) AS i, avg(s) AS s FROM (SELECT regr_intercept(log_yield, pr) AS i, regr_slope(log_yield, pr) AS s FROM mp GROUP BY year))
SELECT departement, year, month, {r('i + s * pr', 'pred')} FROM mp, c""")
def _(spark, d):
    panel = month_panel(spark, d)
    draws = panel.groupBy(F.col("year").alias("draw")).agg(
        F.regr_intercept("log_yield", "PR").alias("intercept"), F.regr_slope("log_yield", "PR").alias("PR")
    ).unpivot(["draw"], ["intercept", "PR"], "term", "value")
    design = panel.withColumn("intercept", F.lit(1.0)).unpivot(ROW, ["intercept", "PR"], "term", "x")
    return round_doubles(linear.predict_draws(draws, design, ROW))


def _huber_sql(passes: int) -> str:
    """Slope and intercept per group after reweighting; more passes than any group needs."""
    steps = ["h0 AS MATERIALIZED (SELECT departement, regr_slope(log_yield, pr) AS b, regr_intercept(log_yield, pr) AS a FROM mp GROUP BY departement)"]
    for i in range(passes):
        steps.append(
            f"e{i} AS MATERIALIZED (SELECT mp.departement, pr, log_yield AS y, abs(log_yield - a - b * pr) AS r FROM mp JOIN h{i} USING (departement)),"
            f"s{i} AS (SELECT departement, median(r) / 0.6745 AS s FROM e{i} GROUP BY departement),"
            f"u{i} AS MATERIALIZED (SELECT departement, pr AS x, y, least(1.0, 1.345 * s / r) AS w FROM e{i} JOIN s{i} USING (departement)),"
            f"c{i} AS (SELECT departement, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM u{i} GROUP BY departement),"
            f"h{i + 1} AS MATERIALIZED (SELECT u.departement, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b,"
            f" max(my) - sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) * max(mx) AS a FROM u{i} u JOIN c{i} USING (departement) GROUP BY u.departement)"
        )
    return ",\n".join(steps)


@query("m12_fit_huber", f"WITH {PANEL.replace('mp AS (', 'mp AS MATERIALIZED (')}, {_huber_sql(40)} SELECT departement, {r('a', 'intercept')}, {r('b', 'slope')}, true AS converged FROM h40")
def _(spark, d):
    fits = fit_huber(month_panel(spark, d).select("departement", "PR", "log_yield"), ["departement"], ["PR"], "log_yield")
    return round_doubles(fits.select("departement", "intercept", F.col("coef")[0].alias("slope"), "converged"))


def _line(pdf: pd.DataFrame) -> pd.DataFrame:
    x, y = pdf["year"] - pdf["year"].mean(), pdf["yield"]
    return pdf[["department", "sp"]].head(1).assign(slope=(x * y).sum() / (x * x).sum(), n=len(pdf))


@query("m13_fit_by_group", f"""WITH {YIELD} SELECT department, sp, {r('regr_slope(yield, year)', 'slope', 5)}, count(*) AS n FROM yp GROUP BY department, sp""")
def _(spark, d):
    fits = V.fit_by_group(yield_panel(spark, d), ["department", "sp"], _line, "department string, sp string, slope double, n long")
    return round_doubles(fits, 5)


@query("m14_calibrate", f"WITH {IN_SAMPLE} SELECT departement, year, month, m AS model, {r('pred', 'pred')} FROM g_fit, (VALUES ('ols'), ('bayes')) t(m)")
def _(spark, d):
    out = V.calibrate(month_panel(spark, d), ["departement"], FEATURES, "log_yield", ["ols", "bayes"], ROW)
    return round_doubles(out.select(*ROW, "model", "pred"))


@query("m14_calibrate_all_models", f"""WITH RECURSIVE {IN_SAMPLE}, {", ".join(_net_cv_sql(a, f"_{m}") for m, a in NETS.items())}, {NCOMP}, {_pls_sql(4, "_all")}
SELECT departement, year, month, 'ols' AS model, {r('pred', 'pred', 5)} FROM g_fit""" + "".join(
    f"""
UNION ALL SELECT mp.departement, year, month, '{m}', {r('my + ' + ' + '.join(f'k{i} * ({x} - m{i})' for i, x in enumerate(SQL_FEATURES)), None, 5)}
FROM mp JOIN co_{m} c ON mp.departement = c.departement JOIN be_{m} b ON b.departement = c.departement AND b.k = c.k WHERE part = -1""" for m in NETS) + f"""
UNION ALL SELECT departement, year, month, 'pls', {r('CASE ncomp WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END', None, 5)} FROM q4_all JOIN nc USING (departement)""")
def _(spark, d):
    models = ["ols", "lasso", "ridge", "elnet", "pls"]
    out = V.calibrate(month_panel(spark, d), ["departement"], FEATURES, "log_yield", models, ROW).select(*ROW, "model", "pred")
    return round_doubles(out, 5)


@query("m16_block_folds", f"""WITH {PANEL} SELECT departement, year, month, {fold_sql('year', (0.5, 1.0))} AS fold2, {fold_sql('year', (0.25, 0.5, 0.75, 1.0))} AS fold4 FROM mp""")
def _(spark, d):
    rows = month_panel(spark, d).select(*ROW)
    return V.block_folds(V.block_folds(rows, "year", V.TWO_FOLDS, out="fold2"), "year", V.FOUR_FOLDS, out="fold4")


@query("m17_cv_split", f"""WITH {PANEL}, f AS (SELECT departement, year, month, {fold_sql('year', (0.5, 1.0))} AS fold FROM mp WHERE departement <> 'NATION_7'),
k AS (SELECT departement, round FROM f, (VALUES ('Y1'), ('Y2')) t(round) GROUP BY ALL HAVING count(CASE WHEN fold = round THEN 1 END) > 0 AND count(CASE WHEN fold <> round THEN 1 END) > 0)
SELECT departement, year, month, fold, round, CASE WHEN fold = round THEN 'val' ELSE 'cal' END AS role FROM f JOIN k USING (departement)""")
def _(spark, d):
    rows = V.block_folds(month_panel(spark, d).select(*ROW), "year")
    return V.cv_split(rows, "fold", ["departement"], V.fold_labels(V.TWO_FOLDS), {"departement": ["NATION_7"]})


def _cv_sql(part: str, cuts=(0.5, 1.0)) -> str:
    labels = ", ".join(f"('Y{i}')" for i in range(1, len(cuts) + 1))
    parts = ", ".join(p for p in ("round", part) if p)
    return f"""{PANEL}, fo AS (SELECT *, {fold_sql('year', cuts)} AS fold FROM mp),
ex AS (SELECT *, CASE WHEN fold <> round THEN 1.0 ELSE 0.0 END AS w FROM fo, (VALUES {labels}) t(round)),
{ols_sql('g', 'ex', parts, SQL_FEATURES, 'log_yield', 'w')},
cv AS (SELECT *, 'ols' AS model FROM g_fit WHERE fold = round AND pred IS NOT NULL)"""


def _cv(spark, d, keys, models=("ols",), cuts=V.TWO_FOLDS):
    return V.cross_validate(
        month_panel(spark, d), keys, FEATURES, "log_yield", models, "year", cuts, row_keys=ROW, observed="yield"
    )


@query("m15_predict_held_out", f"WITH {_cv_sql('departement')} SELECT departement, year, month, fold, model, {r('pred', 'pred')} FROM cv")
def _(spark, d):
    return round_doubles(_cv(spark, d, ["departement"])[1].select(*ROW, "fold", "model", "pred"))


@query("m18_cross_validate", f"WITH {_cv_sql('departement')} " + gof_sql("cv", "model", "exp(pred)", "yield", 4))
def _(spark, d):
    return round_doubles(_cv(spark, d, ["departement"])[0], 4)


@query("m18_cross_validate_four_folds", f"WITH {_cv_sql('departement', V.FOUR_FOLDS)} " + gof_sql("cv", "model", "exp(pred)", "yield", 4))
def _(spark, d):
    return round_doubles(_cv(spark, d, ["departement"], cuts=V.FOUR_FOLDS)[0], 4)


@query("m18_cross_validate_all_models")
def _(spark, d):
    return _cv(spark, d, ["departement"], ("ols", "lasso", "ridge", "elnet", "pls"))[0]


@query("m19_cross_validate_pooled", f"WITH {_cv_sql('')} " + gof_sql("cv", "model", "exp(pred)", "yield", 4))
def _(spark, d):
    return round_doubles(_cv(spark, d, [])[0], 4)


@query("w5_rank_models", f"""WITH {_cv_sql('departement')}, q AS (SELECT departement, pow(corr(exp(pred), yield), 2) AS r2, avg(pow(exp(pred) - yield, 2)) AS mse FROM cv GROUP BY departement)
SELECT departement, {r('r2', '"R2"', 5)}, {r('mse', '"MSE"', 3)} FROM q ORDER BY r2 DESC, mse LIMIT 10""")
def _(spark, d):
    pred = _cv(spark, d, ["departement"])[1].withColumn("sim", F.exp("pred"))
    best = rank_models(gof(pred, ["departement"], "sim", "yield").select("departement", "R2", "MSE"), 10)
    return best.select("departement", rounded("R2", 5).alias("R2"), rounded("MSE", 3).alias("MSE"))


SCENARIO = REBASE + """,
nm AS (SELECT *, (value - avg(CASE WHEN type = 'OBS' THEN value END) OVER w) / stddev_samp(CASE WHEN type = 'OBS' THEN value END) OVER w AS z
  FROM sc WINDOW w AS (PARTITION BY clim_var)),
fw AS (SELECT departement, month, year_cal AS year, type, max(CASE WHEN clim_var = 'Tn' THEN z END) AS tn, max(CASE WHEN clim_var = 'Tx' THEN z END) AS tx,
  max(CASE WHEN clim_var = 'PR' THEN z END) AS pr, max(CASE WHEN clim_var = 'ETP' THEN z END) AS etp FROM nm GROUP BY ALL),
oc AS (SELECT n_name AS departement, y AS year, mth AS month, sum(l_extendedprice) / sum(l_quantity) AS yield, sum(l_quantity) AS area FROM by_nation GROUP BY ALL),
fy AS (SELECT fw.*, yield, area, ln(yield) AS ly, CASE WHEN type = 'OBS' THEN 1.0 ELSE 0.0 END AS w FROM fw JOIN oc USING (departement, year, month) WHERE tn IS NOT NULL AND tx IS NOT NULL AND pr IS NOT NULL AND etp IS NOT NULL),
""" + ols_sql("k", "fy", "departement", ["tn", "tx", "pr", "etp"], "ly", "w")


def scenario_predictions(spark, d, models=("ols",)):
    variables = ["Tn", "Tx", "PR", "ETP"]
    normal = normalise_by_reference(scenarios(spark, d), ["clim_var"]).withColumnRenamed("year_cal", "year")
    wide = to_wide(normal, [*ROW, "type"], "clim_var", "value_norm", variables)
    outcome = month_panel(spark, d).select(*ROW, "yield", "area", "log_yield")
    rows = wide.join(outcome, ROW)
    return V.predict_scenarios(rows, ["departement"], variables, "log_yield", models, ROW)


@query("m20_predict_scenarios", f"WITH {SCENARIO} SELECT departement, year, month, type, 'ols' AS model, {r('pred', 'pred')} FROM k_fit")
def _(spark, d):
    return round_doubles(scenario_predictions(spark, d).select(*ROW, "type", "model", "pred"))


MIXED = {"Tn": {"type": "y1997"}, "Tx": {"type": "y1997"}, "PR": {"type": "OBS"}, "ETP": {"type": "OBS"}}


@query("m20_mix_scenarios", f"""WITH {REBASE}
SELECT departement, month, year_cal, {r("max(CASE WHEN clim_var = 'Tn' AND type = 'y1997' THEN value END)", '"Tn"')},
 {r("max(CASE WHEN clim_var = 'Tx' AND type = 'y1997' THEN value END)", '"Tx"')},
 {r("max(CASE WHEN clim_var = 'PR' AND type = 'OBS' THEN value END)", '"PR"')},
 {r("max(CASE WHEN clim_var = 'ETP' AND type = 'OBS' THEN value END)", '"ETP"')}, 'T97' AS type FROM sc GROUP BY departement, month, year_cal""")
def _(spark, d):
    return round_doubles(
        V.mix_scenarios(
            scenarios(spark, d), ["departement", "month", "year_cal"], MIXED, label="T97"
        )
    )


IMPACT = SCENARIO + """,
im AS (SELECT s.*, exp(o.pred) AS observed, exp(s.pred) AS scenario FROM k_fit s JOIN (SELECT * FROM k_fit WHERE type = 'OBS') o USING (departement, year, month) WHERE s.type <> 'OBS'),
mi AS (SELECT departement, type, CASE WHEN count(scenario) = count(*) THEN avg((observed - scenario) / observed * 100) END AS pct,
  CASE WHEN count(scenario) = count(*) THEN avg(observed - scenario) END AS diff FROM im GROUP BY departement, type)"""


@query("m21_scenario_impact", f"WITH {IMPACT} SELECT departement, type, {r('diff', 'diff', 4)}, {r('pct', 'diff_pct', 4)} FROM mi")
def _(spark, d):
    effect = impact.scenario_impact(scenario_predictions(spark, d), [*ROW, "model"])
    return round_doubles(impact.mean_impact(effect, ["departement", "type"]), 4)


@query("m22_impact_classes", f"""WITH {IMPACT} SELECT n_name AS departement,
 CASE WHEN pct >= -100 AND pct <= -1 THEN '[-100,-1]' WHEN pct > -1 AND pct <= 0 THEN '(-1,0]' WHEN pct > 0 AND pct <= 1 THEN '(0,1]' WHEN pct > 1 AND pct <= 100 THEN '(1,100]' END AS class
 FROM nation LEFT JOIN (SELECT * FROM mi WHERE type = 'y1997') ON departement = n_name""")
def _(spark, d):
    effect = impact.scenario_impact(scenario_predictions(spark, d), [*ROW, "model"]).where("type = 'y1997'")
    units = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("departement"))
    mean = impact.mean_impact(effect, ["departement"])
    return impact.impact_classes(mean, "diff_pct", [-100, -1, 0, 1, 100], units).select("departement", "class")


@query("m23_regional_production", f"""WITH {SCENARIO} SELECT year, type, {r('sum(exp(pred) * area)', 'pred_production', 0)}, {r('sum(yield * area)', 'production', 0)}, sum(area) AS area,
 {r('sum(exp(pred) * area) / sum(area)', 'pred_yield', 4)}, {r('sum(yield * area) / sum(area)', 'yield', 4)} FROM k_fit WHERE pred IS NOT NULL GROUP BY year, type""")
def _(spark, d):
    t = impact.regional_production(scenario_predictions(spark, d), ["year", "type"])
    return t.select(
        "year", "type", "area", *[rounded(c, n).alias(c) for c, n in (("pred_production", 0), ("production", 0), ("pred_yield", 4), ("yield", 4))]
    )


GROUPS = [f"NATION_{i}" for i in range(25)]
ONE_HOT = ", ".join(f"CAST(departement = '{g}' AS INTEGER)::DOUBLE AS x{i}" for i, g in enumerate(GROUPS, 5))


@query("m24_design_matrix", f"""WITH {PANEL}
SELECT departement, year, month, {r('log_yield', 'label')}, {r('(year - avg(year) OVER ()) / stddev_samp(year) OVER ()', 'x0')}, {r('tn', 'x1')}, {r('tx', 'x2')}, {r('pr', 'x3')}, {r('etp', 'x4')},
 {ONE_HOT} FROM mp""")
def _(spark, d):
    m = forest.design_matrix(month_panel(spark, d), ["Tn", "Tx", "PR", "ETP"], "yield", one_hot_col="departement", values=GROUPS)
    x = vector_to_array("x")
    return round_doubles(m.select(*ROW, "label", *[x[i].alias(f"x{i}") for i in range(5 + len(GROUPS))]))


SIM = "(1800 + 10 * pr - 12 * tn)"


@query("q1_gof", f"WITH {PANEL} " + gof_sql("mp", "month", SIM, "yield", 5, "departement", "year"))
def _(spark, d):
    panel = month_panel(spark, d).withColumn("sim", 1800 + 10 * F.col("PR") - 12 * F.col("Tn"))
    return round_doubles(gof(panel, ["month"], "sim", "yield", ["departement"], "year"), 5)


@query("q2_rmse", f"WITH {PANEL} SELECT month, {r(f'sqrt(avg(pow({SIM} - yield, 2)))', 'rmse')} FROM mp GROUP BY month")
def _(spark, d):
    panel = month_panel(spark, d).withColumn("sim", 1800 + 10 * F.col("PR") - 12 * F.col("Tn"))
    return round_doubles(rmse(panel, "sim", "yield", ["month"]))


@query("q3_train_and_validation", f"""WITH {_cv_sql('departement')}, bo AS (SELECT CASE WHEN fold = round THEN 'val' ELSE 'cal' END AS split, exp(pred) AS s, yield AS o FROM g_fit)
""" + gof_sql("bo", "split", "s", "o", 4))
def _(spark, d):
    rows = V.cv_split(V.block_folds(month_panel(spark, d), "year"), "fold", ["departement"], V.fold_labels(V.TWO_FOLDS))
    keys = ["departement", "round"]
    fits = linear.fit_ols(gram(rows.where("role = 'cal'"), keys, FEATURES, "log_yield"), keys)
    scored = linear.predict(fits, rows, keys, FEATURES).withColumns({"sim": F.exp("pred"), "split": F.col("role")})
    return round_doubles(gof(scored, ["split"], "sim", "yield"), 4)


@query("q4_residuals", f"WITH {IN_SAMPLE} SELECT departement, year, month, {r('log_yield - pred', 'residual')} FROM g_fit")
def _(spark, d):
    panel = month_panel(spark, d)
    fits = linear.fit_ols(gram(panel, ["departement"], FEATURES, "log_yield"), ["departement"])
    scored = linear.predict(fits, panel, ["departement"], FEATURES)
    return round_doubles(residuals(scored, "log_yield", "pred").select(*ROW, "residual"))
