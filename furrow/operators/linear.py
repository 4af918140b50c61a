"""Linear models on cross-product tables, and scoring of rows with them.

Every fit takes a table from ``gram`` (one row per group) and returns one row per
group: keys, ``model``, ``intercept``, ``coef`` in feature order, and what was tuned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions import solvers as S
from furrow.functions.keys import attach, complete, null_safe_join, spread
from furrow.operators.gram import gram

RESULT = [
    T.StructField("model", T.StringType()),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("coef", T.ArrayType(T.DoubleType())),
    T.StructField("lambda", T.DoubleType()),
    T.StructField("ncomp", T.IntegerType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("converged", T.BooleanType()),
]
PATH = 100  # penalties tried
PENALISED = {"lasso": 1.0, "ridge": 0.0, "elnet": 0.5}


def _fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _coefs(values) -> list:
    return [None if np.isnan(v) else float(v) for v in values]


def _row(model: str, intercept: float, coef, lam=None, ncomp=None, rank=None, converged=True) -> dict:
    return {
        "model": model, "intercept": float(intercept), "coef": _coefs(coef),
        "lambda": lam, "ncomp": ncomp, "rank": rank, "converged": bool(converged),
    }


def _frame(rows: list[dict], names: Sequence[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=list(names))
    for c in ("ncomp", "rank"):
        if c in out:
            out[c] = out[c].astype("Int32")
    return out


def _back(found: list[dict], point: np.ndarray) -> list[dict]:
    """Rows of fits to distances from ``point`` as rows of fits to the values themselves."""
    for row in found:
        if "intercept" in row:
            row["intercept"] = S.moved_back(row["intercept"], [np.nan if v is None else v for v in row["coef"]], point)
    return found


def _solve_rows(
    table: DataFrame, keys: Sequence[str], fields: list[T.StructField], solve: Callable[..., list[dict]]
) -> DataFrame:
    """Apply a solve to the matrix of each row about its means, and to these; rows are independent."""
    keys = list(keys)
    schema = T.StructType(_fields(table, keys) + fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        for pdf in batches:
            rows = []
            for record in pdf.to_dict("records"):
                moments = S.Moments(record["c"])
                for found in _back(solve(moments.about(), moments.mean), moments.mean):
                    rows.append({**{k: record[k] for k in keys}, **found})
            yield _frame(rows, names)

    return table.select(*keys, "c").mapInPandas(run, schema)


def fit_ols(table: DataFrame, keys: Sequence[str], name: str = "ols") -> DataFrame:
    """Least squares; a column explained by earlier ones gets a null coefficient."""

    def solve(g, _):
        fit = S.least_squares(g)
        return [_row(name, fit["intercept"], fit["coef"], rank=fit["rank"])]

    return _solve_rows(table, keys, RESULT, solve)


def fit_elastic_net(
    table: DataFrame, keys: Sequence[str], alpha: float, lambdas: Sequence[float] | None = None, name: str = "elnet",
    steps: int = PATH,
) -> DataFrame:
    """One row per group and penalty (a path of ``steps`` when none is given)."""

    def solve(g, _):
        path = S.penalty_path(g, alpha, steps) if lambdas is None else np.asarray(lambdas, float)
        fits = zip(*S.elastic_net(g, alpha, path), path)
        return [_row(name, a, b, lam=float(v), converged=done) for a, b, done, v in fits]

    return _solve_rows(table, keys, RESULT, solve)


def fit_pls(table: DataFrame, keys: Sequence[str], ncomp: int, name: str = "pls") -> DataFrame:
    def solve(g, _):
        intercepts, coefs = S.partial_least_squares(g, ncomp)
        return [_row(name, intercepts[ncomp], coefs[ncomp], ncomp=ncomp)]

    return _solve_rows(table, keys, RESULT, solve)


def fit_bayes_linear(
    table: DataFrame, keys: Sequence[str], features: Sequence[str], prior_precision: float = 1e-10
) -> DataFrame:
    """Posterior mean, spread and 95 % interval per term, long by ``term``."""
    fields = [T.StructField("term", T.StringType())] + [
        T.StructField(c, T.DoubleType()) for c in ("mean", "sd", "low", "high")
    ]
    terms = ["intercept", *features]

    def solve(g, mean):
        post = S.flat_posterior(g, prior_precision, mean)
        return [
            {"term": t, "mean": m, "sd": s, "low": m - 1.959963984540054 * s, "high": m + 1.959963984540054 * s}
            for t, m, s in zip(terms, post["mean"], post["sd"])
        ]

    return _solve_rows(table, keys, fields, solve)


def coef_table(table: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Estimate, standard error and t per term of a least-squares fit."""
    fields = [T.StructField("term", T.StringType())] + [
        T.StructField(c, T.DoubleType()) for c in ("estimate", "se", "t")
    ]

    def solve(g, mean):
        fit = S.least_squares(g)
        free = fit["n"] - fit["rank"]
        variance = fit["rss"] / free if free > 0 else np.nan
        kept, inv, mx = fit["kept"], fit["inverse"], mean[:-1]
        se = np.full(len(features) + 1, np.nan)
        se[0] = np.sqrt(variance * (1 / fit["n"] + mx[kept] @ inv @ mx[kept]))
        se[1 + np.asarray(kept, int)] = np.sqrt(variance * np.diag(inv))
        estimate = np.r_[S.moved_back(fit["intercept"], fit["coef"], mean), fit["coef"]]
        clean = lambda v: None if not np.isfinite(v) else float(v)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = estimate / se
        return [
            {"term": n, "estimate": clean(e), "se": clean(s), "t": clean(v)}
            for n, e, s, v in zip(["intercept", *features], estimate, se, t)
        ]

    return _solve_rows(table, keys, fields, solve)


def tune(total: np.ndarray, pieces: list[np.ndarray], fit: Callable, choices) -> np.ndarray:
    """Squared error of every choice on each piece, fitted on the sum of the others; (pieces, choices)."""
    errors = []
    for k, piece in enumerate(pieces):
        if piece[0, 0] > 0 and total[0, 0] - piece[0, 0] > 2:
            errors.append(S.squared_error(piece, *fit(_others(pieces, k), choices)[:2]))
    return np.array(errors)


def _others(pieces: list[np.ndarray], k: int) -> np.ndarray:
    """The sum of all matrices but one; not a difference, which would cancel."""
    return sum(p for i, p in enumerate(pieces) if i != k)


def _group_solve(table: DataFrame, keys: Sequence[str], fields, solve, part: str | None = None) -> DataFrame:
    """Solve per group from the matrices of its inner folds (a handful of rows), all about the group's means.

    With ``part`` the solve also gets the labels of the inner folds.
    """
    keys = list(keys)
    schema = T.StructType(_fields(table, keys) + fields)
    names = [f.name for f in schema.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [S.Moments(c) for c in pdf["c"]]
        point = S.common_mean(parts)
        pieces = [p.about(point) for p in parts]
        first = {k: pdf[k].iloc[0] for k in keys}
        more = [list(pdf[part])] if part else []
        return _frame([{**first, **found} for found in _back(solve(sum(pieces), pieces, *more), point)], names)

    rows = table.select(*keys, *([part] if part else []), "c")
    return (spread(rows, keys) if keys else rows).groupBy(*keys).applyInPandas(run, schema)


def _best_penalty(total, pieces, alpha: float, steps: int = PATH) -> float:
    path = S.penalty_path(total, alpha, steps)
    errors = tune(total, pieces, lambda g, c: S.elastic_net(g, alpha, c), path)
    return float(path[int(np.argmin(errors.sum(axis=0)))] if len(errors) else path[-1])


def cv_elastic_net(
    table: DataFrame, keys: Sequence[str], alpha: float, name: str = "elnet", steps: int = PATH
) -> DataFrame:
    """Penalty with the smallest error over the inner folds, refitted on all of them.

    ``table`` has one row per group and inner fold.
    """

    def solve(total, pieces):
        lam = _best_penalty(total, pieces, alpha, steps)
        intercepts, coefs, done = S.elastic_net(total, alpha, [lam])
        return [_row(name, intercepts[0], coefs[0], lam=lam, converged=done[0])]

    return _group_solve(table, keys, RESULT, solve)


def cv_pls_errors(table: DataFrame, keys: Sequence[str], max_ncomp: int, part: str = "inner") -> DataFrame:
    """Error of 0..max_ncomp components on each inner fold: ``ncomp``, the fold, ``rmsep``, ``rows``."""
    fields = [
        T.StructField("ncomp", T.IntegerType()), table.schema[part],
        T.StructField("rmsep", T.DoubleType()), T.StructField("rows", T.DoubleType()),
    ]

    def solve(total, pieces, labels):
        out = []
        for k, (label, piece) in enumerate(zip(labels, pieces)):
            if total[0, 0] - piece[0, 0] > 2:
                errors = S.squared_error(piece, *S.partial_least_squares(_others(pieces, k), max_ncomp))
                out += [
                    {"ncomp": k, part: label, "rmsep": float(np.sqrt(max(e, 0) / piece[0, 0])), "rows": piece[0, 0]}
                    for k, e in enumerate(errors)
                ]
        return out

    return _group_solve(table, keys, fields, solve, part)


def loo_pls_errors(df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, max_ncomp: int) -> DataFrame:
    """Error of 0..max_ncomp components with each row left out in turn: ``ncomp``, ``rmsep``, ``se``, ``rows``.

    The co-moments of a group less one row differ from the group's by a product of that row with itself, so the rows are
    read once to sum these and once to be left out; no group is fitted from its rows. ``se`` is
    that of the mean error, from the spread of the rows' errors. Groups of fewer than three rows get none.
    """
    keys, features = list(keys), list(features)
    size, top = len(features) + 2, min(max_ncomp, len(features))
    used = complete(df, [*features, y]).select(*keys, F.array(*[F.col(c).cast("double") for c in [*features, y]]).alias("__z"))
    named = used.select(*keys, *[F.col("__z")[i].alias(f"__f{i}") for i in range(size - 1)])
    table = gram(named, keys, [f"__f{i}" for i in range(size - 2)], f"__f{size - 2}").where("rows > 2").select(*keys, "c")
    both = attach(used, table, keys)

    def errors(z: pd.Series, c: pd.Series) -> np.ndarray:
        rows, packed = np.stack(z.to_numpy()), np.stack(c.to_numpy())
        out = np.empty((len(rows), top + 1))
        # rows of one group stand mostly together; each run of equal matrices is one stack
        starts = np.flatnonzero(np.r_[True, (np.diff(packed, axis=0) != 0).any(axis=1)])
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            for k in range(a, b, 4096):
                part = rows[k : min(b, k + 4096)]
                mean, co = S.leave_one_out(S.Moments(packed[a]), part)
                slopes = S.many_partial_least_squares(co[:, :-1, :-1], co[:, :-1, -1], top)
                apart = part - mean
                out[k : k + len(part)] = apart[:, -1:] - np.einsum("nkp,np->nk", slopes, apart[:, :-1])
        return out

    def run(batches):
        for pdf in batches:
            if len(pdf):
                found = errors(pdf["__z"], pdf["c"])
                yield pdf[keys].assign(__e=list(found)) if keys else pd.DataFrame({"__e": list(found)})

    schema = T.StructType(_fields(df, keys) + [T.StructField("__e", T.ArrayType(T.DoubleType()))])
    left_out = both.mapInPandas(run, schema).select(*keys, F.posexplode("__e").alias("ncomp", "__e"))
    return left_out.groupBy(*keys, "ncomp").agg(
        F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmsep"),
        (F.stddev_samp("__e") / F.sqrt(F.count("__e"))).alias("se"),
        F.count("__e").alias("rows"),
    )


def select_ncomp_loo(curve: DataFrame, keys: Sequence[str], floor: int = 1) -> DataFrame:
    """Smallest number of components whose left-out error is within one standard error of the least."""
    keys = list(keys)
    best = curve.groupBy(*keys).agg(F.min_by(F.struct("rmsep", "se"), F.struct("rmsep", "ncomp")).alias("__best"))
    limit = F.col("__best")["rmsep"] + F.coalesce(F.col("__best")["se"], F.lit(0.0))
    return (
        attach(curve, best, keys)
        .where(F.col("rmsep") <= limit)
        .groupBy(*keys)
        .agg(F.greatest(F.min("ncomp"), F.lit(floor)).cast("int").alias("ncomp"))
    )


def select_ncomp(errors: DataFrame, keys: Sequence[str], floor: int = 1) -> DataFrame:
    """Smallest number of components within one standard error of the best."""
    keys = list(keys)
    curve = errors.groupBy(*keys, "ncomp").agg(
        F.sqrt(F.sum(F.col("rmsep") * F.col("rmsep") * F.col("rows")) / F.sum("rows")).alias("rmsep"),
        (F.stddev_samp("rmsep") / F.sqrt(F.count("rmsep"))).alias("se"),
    )
    best = curve.groupBy(*keys).agg(F.min_by(F.struct("rmsep", "se"), F.struct("rmsep", "ncomp")).alias("__best"))
    limit = F.col("__best")["rmsep"] + F.coalesce(F.col("__best")["se"], F.lit(0.0))
    return (
        attach(curve, best, keys)
        .where(F.col("rmsep") <= limit)
        .groupBy(*keys)
        .agg(F.greatest(F.min("ncomp"), F.lit(floor)).cast("int").alias("ncomp"))
    )


def _one_sigma(errors: np.ndarray, counts: np.ndarray) -> int:
    """The rule of ``select_ncomp`` for the errors of one group."""
    overall = np.sqrt(errors.sum(axis=0) / counts.sum())
    per_piece = np.sqrt(np.maximum(errors, 0) / counts[:, None])
    best = int(np.argmin(overall))
    se = per_piece[:, best].std(ddof=1) / np.sqrt(len(counts)) if len(counts) > 1 else 0.0
    return max(1, int(np.flatnonzero(overall <= overall[best] + se)[0]))


def fit_models(
    table: DataFrame, keys: Sequence[str], models: Sequence[str], max_ncomp: int | None = None, steps: int = PATH
) -> DataFrame:
    """Fit and tune several models per group; ``table`` has one row per inner fold.

    Models: ols, lasso, ridge, elnet, pls, bayes. ``max_ncomp`` bounds the components of pls, which
    are as many as the features otherwise; ``steps`` is the number of penalties tried.
    """
    unknown = set(models) - {"ols", "pls", "bayes", *PENALISED}
    if unknown:
        raise ValueError(f"unknown models: {sorted(unknown)}")

    def solve(total, pieces):
        out = []
        for model in models:
            if model == "ols":
                fit = S.least_squares(total)
                out.append(_row(model, fit["intercept"], fit["coef"], rank=fit["rank"]))
            elif model == "bayes":
                mean = S.flat_posterior(total, 1e-10)["mean"]
                out.append(_row(model, mean[0], mean[1:]))
            elif model == "pls":
                top = int(min(max_ncomp or len(total), len(total) - 2, max(total[0, 0] - 2, 1)))
                usable = [p for p in pieces if p[0, 0] > 0 and total[0, 0] - p[0, 0] > 2]
                errors = tune(total, usable, S.partial_least_squares, top)
                ncomp = _one_sigma(errors, np.array([p[0, 0] for p in usable])) if len(errors) else 1
                intercepts, coefs = S.partial_least_squares(total, top)
                out.append(_row(model, intercepts[ncomp], coefs[ncomp], ncomp=ncomp))
            else:
                lam = _best_penalty(total, pieces, PENALISED[model], steps)
                intercepts, coefs, done = S.elastic_net(total, PENALISED[model], [lam])
                out.append(_row(model, intercepts[0], coefs[0], lam=lam, converged=done[0]))
        return out

    return _group_solve(table, keys, RESULT, solve)


def linear_score(features: Sequence[str]):
    """Column: intercept plus coefficients times features; null coefficients count 0."""
    score = F.col("intercept")
    for i, name in enumerate(features):
        score = score + F.coalesce(F.get(F.col("coef"), i), F.lit(0.0)) * F.col(name)
    return score


def predict(
    models: DataFrame, df: DataFrame, keys: Sequence[str], features: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Rows once per model of their group, with ``model`` and ``pred``.

    Models without rows drop out, and so do groups without a model; ``how='left'`` keeps
    the rows of these with a null model and prediction.
    """
    fits = models.select(*keys, "model", "intercept", "coef")
    if keys:
        joined = null_safe_join(df, fits, keys, how)
    else:  # pooled: as many rows as models, each a few numbers
        many = fits.agg(F.collect_list(F.struct("model", "intercept", "coef")).alias("__fits"))
        joined = attach(df, many, []).select(*df.columns, F.inline("__fits"))
    return joined.withColumn("pred", linear_score(features)).drop("intercept", "coef")


def predict_draws(draws: DataFrame, design: DataFrame, row_keys: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean over draws of the linear predictor.

    ``draws``: keys, draw, term, value; ``design``: row keys, term, x. The mean over
    draws of a sum is the sum of the mean coefficients, so draws are averaged per
    term before they meet the rows.
    """
    mean = draws.groupBy(*keys, "term").agg(F.avg("value").alias("__coef"))
    joined = null_safe_join(design, mean, [*keys, "term"])
    return joined.groupBy(*row_keys).agg(F.sum(F.col("__coef") * F.col("x")).alias("pred"))
