"""Huber regression per group by reweighting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import solvers as S
from furrow.functions.keys import attach, complete
from furrow.operators.gram import gram
from furrow.operators.linear import fit_ols, linear_score
from furrow.operators.quantiles import group_quantiles
from furrow.session import written

# Tuning constant of the weights, median of |N(0,1)|.
HUBER_K = 1.345
NORMAL_MAD = 0.6745


def fit_huber(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, passes: int = 100, name: str = "huber",
    tolerance: float = 1e-7,
) -> DataFrame:
    """Coefficients per group, reweighted until they stand still.

    A pass scores the rows with the last coefficients, takes the exact median absolute residual of each group and sums
    weighted cross products. A group is done when fitted values move by less than ``tolerance`` of the residuals'
    size; its rows then take no part in further passes. ``passes`` bounds their number; ``converged`` tells whether a group
    got there and ``passes`` in the result after how many. Coefficients are written to the shared folder between passes.
    """
    keys = list(keys)
    # every pass reads the rows again, so they are derived once
    rows = written(complete(df, [y, *features]).select(*dict.fromkeys([*keys, *features, y])), "huber-rows")
    table = gram(rows, keys, features, y).select(*keys, "c")
    start = fit_ols(table, keys, name).drop("converged")
    live = written(attach(start, table, keys), "huber-start")
    done = []
    for turn in range(1, passes + 1):
        scored = attach(rows, live.select(*keys, "intercept", "coef"), keys).withColumn("__r", F.abs(F.col(y) - linear_score(features)))
        scale = group_quantiles(scored, keys, "__r", [0.5], ["__mad"]).select(*keys, (F.col("__mad") / NORMAL_MAD).alias("__scale"))
        ratio = F.try_divide(F.lit(HUBER_K) * F.col("__scale"), F.col("__r"))
        weighted = attach(scored, scale, keys).withColumn("__weight", F.least(F.lit(1.0), F.coalesce(ratio, F.lit(1.0))))
        fits = fit_ols(gram(weighted, keys, features, y, weight="__weight"), keys, name).drop("converged")
        before = live.select(*keys, F.col("intercept").alias("__a"), F.col("coef").alias("__b"), "c")
        judged = attach(fits, before, keys).withColumn("converged", _still(tolerance)(F.col("c"), F.col("intercept"), F.col("coef"), F.col("__a"), F.col("__b")))
        # as a table: a checkpoint carries the constraints of all passes before it, and they multiply
        judged = written(judged.withColumn("passes", F.lit(turn)).drop("__a", "__b"), "huber-pass")
        done.append(judged.where("converged").drop("c"))
        live = judged.where("not converged").drop("converged", "passes")
        if live.isEmpty():
            break
    else:
        done.append(judged.where("not converged").drop("c"))
    return reduce(DataFrame.unionByName, done)


def _still(tolerance: float):
    """Whether two fits to a group differ by little, seen against its residuals; from the group's co-moments."""

    @F.pandas_udf("boolean")
    def still(c: pd.Series, a: pd.Series, b: pd.Series, a_old: pd.Series, b_old: pd.Series) -> pd.Series:
        out = []
        for packed, *fit in zip(c, a, b, a_old, b_old):
            m = S.Moments(packed)
            slopes, old = (np.array([v or 0.0 for v in x]) for x in (fit[1], fit[3]))
            step, level = slopes - old, fit[0] - fit[2] + m.mean[:-1] @ (slopes - old)
            moved = step @ m.co[:-1, :-1] @ step + m.n * level**2
            e, off = np.r_[old, -1.0], fit[2] + m.mean[:-1] @ old - m.mean[-1]
            size = e @ m.co @ e + m.n * off**2
            # beside the size of the residuals that of rounding in y counts
            out.append(bool(moved <= max(tolerance**2 * size, 1e-26 * m.co[-1, -1])))
        return pd.Series(out)

    return still
