"""Models whose groups share slopes: group trends, and random coefficients."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions import solvers as S
from furrow.functions.keys import attach
from furrow.operators.gram import gram, merge_all, sum_matrices
from furrow.operators.linear import RESULT, _row
from furrow.session import cut_lineage


def _time_terms(df: DataFrame, time: str, quadratic: bool) -> tuple[DataFrame, list[str]]:
    out = df.withColumn("__t1", F.col(time).cast("double"))
    if quadratic:
        out = out.withColumn("__t2", F.col("__t1") * F.col("__t1"))
    return out, ["__t1", "__t2"] if quadratic else ["__t1"]


def fit_panel_trend(
    df: DataFrame, group: str, time: str, features: Sequence[str], y: str,
    weight: str | None = None, quadratic: bool = True,
) -> DataFrame:
    """Own intercept and time trend per group, shared slopes of the features.

    Same result as one regression with dummies for every group: the group's trend
    is projected out of its cross products, the rest is summed over groups and
    solved once. One row per group; ``coef`` is (t[, t^2], features...), with ``time``
    best given as a z-score.
    """
    rows, trend = _time_terms(df, time, quadratic)
    k = len(trend) + 1
    table = gram(rows, [group], [*trend, *features], y, weight)
    field = table.schema[group]

    def project(g: np.ndarray):
        kept = [0] + [1 + j for j in S.free_columns(S.centred(np.pad(g[:k, :k], (0, 1)))[3])]
        link = np.zeros((k, g.shape[0] - k))
        link[kept] = np.linalg.solve(g[np.ix_(kept, kept)], g[np.ix_(kept, range(k, len(g)))])
        return link, kept

    def leftover(batches):
        for pdf in batches:
            out = []
            for m in pdf["c"]:
                g = S.Moments(m).about()
                link, _ = project(g)
                out.append(S.pack(g[k:, k:] - g[k:, :k] @ link))
            yield pd.DataFrame({"m": out})

    rest = table.select("c").mapInPandas(leftover, "m array<double>")
    shared = sum_matrices(rest, []).select(F.col("m").alias("__rest"))
    schema = T.StructType([field] + RESULT)

    def finish(batches):
        for pdf in batches:
            out = []
            for record in pdf.to_dict("records"):
                pooled = S.unpack(record["__rest"])
                p = len(pooled) - 1
                kept = S.free_columns(pooled[:p, :p])
                slopes = np.zeros(p)
                slopes[kept] = np.linalg.solve(pooled[np.ix_(kept, kept)], pooled[kept, p])
                moments = S.Moments(record["c"])
                link, own = project(moments.about())
                level = link[:, -1] - link[:, :-1] @ slopes
                level[0] = S.moved_back(level[0], np.r_[level[1:], slopes], moments.mean)
                shown = slopes.copy()
                shown[[j for j in range(p) if j not in kept]] = np.nan
                trend_coef = np.array([level[j] if j in own else np.nan for j in range(1, k)])
                out.append({group: record[group], **_row("panel", level[0], np.r_[trend_coef, shown], rank=len(own) + len(kept))})
            frame = pd.DataFrame(out, columns=schema.names)
            frame["ncomp"] = frame["ncomp"].astype("Int32")
            frame["rank"] = frame["rank"].astype("Int32")
            yield frame

    return attach(table.select(group, "c"), shared, []).mapInPandas(finish, schema)


def panel_features(df: DataFrame, time: str, features: Sequence[str], quadratic: bool = True):
    """(rows with the time terms, feature names) that ``predict`` needs for these models."""
    rows, trend = _time_terms(df, time, quadratic)
    return rows, [*trend, *features]


@dataclass
class RandomEffects:
    """Fitted parts of a mixed model, for x, t and y counted from ``point``."""

    beta: np.ndarray
    sigma2: float
    cover: np.ndarray  # covariance of the random terms
    point: np.ndarray
    log_likelihood: float
    passes: int
    converged: bool


def _group_parts(g: np.ndarray, q: int, root: np.ndarray):
    """Log determinant of V and the products of z with V^-1: Z'V^-1 Z, Z'V^-1 (X, y), (X, y)'V^-1 (X, y).

    V is that of the group, 1 + Z T Z' with T = root root', in units of the residual variance.
    """
    zz, zw = g[:q, :q], g[:q, :]
    inner = np.eye(q) + root.T @ zz @ root
    half = np.linalg.solve(inner, root.T @ zw)
    link = zz @ root
    b = zw - link @ half
    a = b[:, :q]
    return np.linalg.slogdet(inner)[1], (a + a.T) / 2, b, g - zw.T @ root @ half


def random_effects(
    table: DataFrame, q: int, p: int, reml: bool = True, tolerance: float = 1e-10, most: int = 100
) -> RandomEffects:
    """Maximise the marginal likelihood over one matrix per group, by Fisher scoring.

    The first ``q`` of the ``p`` columns vary between groups. A pass over the table returns sums of fixed size, from which
    slopes and residual variance follow in closed form, and likelihood, slope and information of the covariance of the
    random terms. A step that does not raise the likelihood is halved. ``converged`` tells that steps have become
    negligible or the likelihood is flat up to rounding within ``most`` passes. ``table`` is read once a pass: write it first.
    """
    totals = S.Moments(merge_all(table).first()["c"])
    n = table.agg(F.sum("rows")).first()[0]
    point = totals.mean
    size = np.sqrt(np.maximum(np.diag(totals.co) / max(totals.n, 1e-300), 0))
    unit = np.r_[1.0, np.where(size > 0, size, 1.0)]
    free = n - p if reml else n

    def sums_pass(root: np.ndarray) -> list[np.ndarray]:
        shapes = [(1,), (q, q), (q, q, q, q), (q, q, p + 1, p + 1), (p + 1, p + 1)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])

        def run(batches):
            total = np.zeros(ends[-1])
            for pdf in batches:
                for c in pdf["c"]:
                    g = S.Moments(c).about(point) / np.outer(unit, unit)
                    det, a, b, v = _group_parts(g, q, root)
                    total += np.concatenate(
                        [[det], a.ravel(), np.einsum("ab,cd->acbd", a, a).ravel(), np.einsum("ai,bj->abij", b, b).ravel(), v.ravel()]
                    )
            yield pd.DataFrame({"m": [total]})

        found = np.array(sum_matrices(table.select("c").mapInPandas(run, "m array<double>"), []).first()["m"])
        return [part.reshape(s) for part, s in zip(np.split(found, ends[:-1]), shapes)]

    def evaluate(cover: np.ndarray):
        values, vectors = np.linalg.eigh(cover)
        root = vectors * np.sqrt(np.maximum(values, 0))
        (det,), a, aa, bb, v = sums_pass(root)
        xx, xy = v[:p, :p], v[:p, p]
        inverse = np.linalg.pinv(xx, hermitian=True)
        beta = inverse @ xy
        e = np.r_[-beta, 1.0]
        sigma2 = max(e @ v @ e / free, 1e-300)
        left = np.einsum("abij,i,j->ab", bb, e, e) / sigma2 - a
        value = -0.5 * (free * np.log(sigma2) + det)
        if reml:
            value -= 0.5 * np.linalg.slogdet(xx)[1]
            left = left + np.einsum("abij,ij->ab", bb[:, :, :p, :p], inverse)
        info = 0.5 * (aa.reshape(q * q, q * q) - np.outer(a.ravel(), a.ravel()) / free)
        return value, beta, sigma2, left / 2, info

    def inside(cover: np.ndarray) -> np.ndarray:
        """The nearest covariance."""
        values, vectors = np.linalg.eigh((cover + cover.T) / 2)
        return (vectors * np.maximum(values, 0)) @ vectors.T

    cover = np.eye(q) * 0.1
    state, passes, converged = evaluate(cover), 1, False
    while passes < most and not converged:
        value, _, _, slope, info = state
        step = (np.linalg.pinv(info, hermitian=True, rcond=1e-10) @ slope.ravel()).reshape(q, q)
        share = 1.0
        while passes < most:
            new = inside(cover + share * step)
            moved = np.abs(new - cover).max() / max(np.abs(cover).max(), 1e-6)
            if moved <= tolerance:
                converged = True
                break
            trial = evaluate(new)
            passes += 1
            if trial[0] > value:
                cover, state = new, trial
                break
            if trial[0] > value - 1e-13 * abs(value) and moved < 1e-5:
                converged = True  # flat up to rounding
                break
            share /= 2
    value, beta, sigma2, _, _ = state
    return RandomEffects(beta / unit[:p] * unit[p], sigma2 * unit[p] ** 2, cover * sigma2 * unit[p] ** 2 / np.outer(unit[:q], unit[:q]), point, float(value), passes, converged)


def fit_random_coef(
    df: DataFrame, group: str, time: str, features: Sequence[str], y: str, weight: str | None = None, quadratic: bool = True,
    random: int | None = None, reml: bool = True, tolerance: float = 1e-10, most: int = 100,
) -> DataFrame:
    """Fixed slopes plus correlated random (1, t[, t^2]) per group, at the maximum of the marginal likelihood.

    ``random`` is the number of these terms that vary between groups (1: the intercept; all by default); ``reml`` takes
    the likelihood of the residuals, as mixed models usually do. One matrix per group is written once; an iteration
    is a pass over that table. The result has one row per group, with the random part already added to the
    coefficients (t[, t^2], features...); ``converged`` is that of the whole fit.
    """
    rows, trend = _time_terms(df, time, quadratic)
    q, p = random or len(trend) + 1, len(trend) + 1 + len(features)
    if not 1 <= q <= len(trend) + 1:
        raise ValueError("the random terms are the first of (1, t, t^2)")
    table = cut_lineage(gram(rows, [group], [*trend, *features], y, weight).select(group, "rows", "c"))
    schema = T.StructType([table.schema[group]] + RESULT)
    if table.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    fit = random_effects(table, q, p, reml, tolerance, most)
    # in units of the residual variance, as in the fit
    values, vectors = np.linalg.eigh(fit.cover / fit.sigma2)
    root = vectors * np.sqrt(np.maximum(values, 0))

    def finish(batches):
        for pdf in batches:
            out = []
            for record in pdf.to_dict("records"):
                *_, b, _ = _group_parts(S.Moments(record["c"]).about(fit.point), q, root)
                own = fit.beta.copy()
                own[:q] += root @ root.T @ (b[:, -1] - b[:, :-1] @ fit.beta)
                level = S.moved_back(own[0], own[1:], fit.point)
                out.append({group: record[group], **_row("random", level, own[1:], converged=fit.converged)})
            frame = pd.DataFrame(out, columns=schema.names)
            frame["ncomp"] = frame["ncomp"].astype("Int32")
            frame["rank"] = frame["rank"].astype("Int32")
            yield frame

    return table.select(group, "c").mapInPandas(finish, schema)
