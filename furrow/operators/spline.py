"""Cubic smoothing spline per series, smoothness by generalised cross-validation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.filters import drop_flat_series, min_group_size
from furrow.functions.keys import complete, null_safe_join, spread


def knot_count(m: int) -> int:
    """All points up to 49; beyond, a number of knots that grows ever more slowly."""
    if m < 50:
        return m
    marks = np.log2([50, 100, 140, 200])
    if m < 200:
        return int(2 ** (marks[0] + (marks[1] - marks[0]) * (m - 50) / 150))
    if m < 800:
        return int(2 ** (marks[1] + (marks[2] - marks[1]) * (m - 200) / 600))
    if m < 3200:
        return int(2 ** (marks[2] + (marks[3] - marks[2]) * (m - 800) / 2400))
    return int(200 + (m - 3200) ** 0.2)


def _basis(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """B-spline values, one column per basis function."""
    last = np.searchsorted(knots, knots[-1]) - 1
    at = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, last)
    out = np.zeros((len(x), len(knots) - 1))
    out[np.arange(len(x)), at] = 1.0
    for k in range(1, degree + 1):
        left = knots[k:-1] - knots[: -k - 1]
        right = knots[k + 1 :] - knots[1:-k]
        a = np.divide(x[:, None] - knots[: -k - 1], left, out=np.zeros((len(x), len(left))), where=left > 0)
        b = np.divide(knots[k + 1 :] - x[:, None], right, out=np.zeros((len(x), len(right))), where=right > 0)
        out = a * out[:, :-1] + b * out[:, 1:]
    return out


def _second_derivative(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    out = _basis(x, knots, 1)
    for k in (2, 3):
        span = knots[k:] - knots[:-k]
        scaled = np.divide(k * out, span, out=np.zeros_like(out), where=span > 0)
        out = scaled[:, :-1] - scaled[:, 1:]
    return out


def smooth(x, y, w, within: float, lam: float | None = None) -> np.ndarray:
    """Fitted values at sorted distinct x; ``within`` is the scatter inside equal x."""
    m, n_obs = len(x), w.sum()
    z = (x - x[0]) / (x[-1] - x[0])
    inner = z[np.floor(np.linspace(0, m - 1, knot_count(m)) + 1e-9).astype(int)]
    knots = np.r_[[inner[0]] * 3, inner, [inner[-1]] * 3]
    design = _basis(z, knots, 3)
    gram = design.T @ (w[:, None] * design)
    right = design.T @ (w * y)
    gaps = np.diff(inner)
    penalty = np.zeros_like(gram)
    for node in (-1, 1):  # two-point Gauss rule, exact for the squared second derivative
        d2 = _second_derivative(inner[:-1] + gaps * (0.5 + node * 0.5 / np.sqrt(3)), knots)
        penalty += d2.T @ ((gaps / 2)[:, None] * d2)
    middle = slice(2, -3) if len(gram) > 6 else slice(None)
    ratio = np.diag(gram)[middle].sum() / np.diag(penalty)[middle].sum()

    # both matrices diagonal in one basis, so a trial of the penalty costs no solve
    lower = np.linalg.cholesky(gram + ratio * penalty)
    half = np.linalg.solve(lower, np.linalg.solve(lower, gram).T)
    share, vectors = np.linalg.eigh((half + half.T) / 2)
    share = np.clip(share, 0.0, 1.0)
    loadings = np.linalg.solve(lower.T, vectors)
    curves, weights = design @ loadings, loadings.T @ right

    def fit(value: float):
        shrink = 1.0 / (share + value / ratio * (1.0 - share) + 1e-300)
        return curves @ (shrink * weights), np.sum(share * shrink)

    if lam is not None:
        return fit(lam)[0]

    def score(spar: float) -> float:
        values, df = fit(ratio * 256.0 ** (3 * spar - 1))
        return (np.sum(w * (y - values) ** 2) + within) / n_obs / (1 - df / n_obs) ** 2

    grid = np.linspace(-1.5, 1.5, 31)
    at = int(np.argmin([score(s) for s in grid]))
    lo, hi = grid[max(at - 1, 0)], grid[min(at + 1, 30)]
    step = (np.sqrt(5) - 1) / 2
    for _ in range(20):
        a, b = hi - step * (hi - lo), lo + step * (hi - lo)
        lo, hi = (lo, b) if score(a) < score(b) else (a, hi)
    return fit(ratio * 256.0 ** (3 * (lo + hi) / 2 - 1))[0]


def spline_trend(
    df: DataFrame, keys: Sequence[str], x: str, y: str, lam: float | None = None, more_than: int = 5
) -> DataFrame:
    """Rows with ``fitted`` and ``resid``; series that are short or flat get none.

    Spark collapses each series to its distinct x (count, mean, scatter), which is
    at most the length of the time axis; a task sees only that.
    """
    keys = list(keys)
    valid = complete(df, [x, y])
    usable = drop_flat_series(min_group_size(valid, keys, more_than), keys, y)
    points = usable.groupBy(*keys, F.col(x).cast("double").alias("__x")).agg(
        F.count(F.lit(1)).cast("double").alias("__w"),
        F.avg(y).alias("__y"),
        F.coalesce(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0)).alias("__ss"),
    )
    schema = T.StructType(
        [f for f in points.schema.fields if f.name in keys]
        + [T.StructField("__x", T.DoubleType()), T.StructField("fitted", T.DoubleType())]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__x")
        px, py, pw = (pdf[c].to_numpy(float) for c in ("__x", "__y", "__w"))
        if len(px) < 4:  # too few places for a cubic: the series mean
            values = np.full(len(px), np.average(py, weights=pw))
        else:
            values = smooth(px, py, pw, float(pdf["__ss"].sum()), lam)
        return pdf[keys].assign(__x=px, fitted=values)

    fitted = spread(points, keys).groupBy(*keys).applyInPandas(solve, schema)
    return (
        null_safe_join(valid.withColumn("__x", F.col(x).cast("double")), fitted, [*keys, "__x"])
        .withColumn("resid", F.col(y) - F.col("fitted"))
        .drop("__x")
    )
