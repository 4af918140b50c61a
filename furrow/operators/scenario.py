"""Detrended series and the scenarios built from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.keys import attach
from furrow.operators.loess import loess_trend
from furrow.operators.spline import spline_trend
from furrow.operators.trend import polynomial_trends

OBSERVED = "OBS"


def detrend(
    df: DataFrame, keys: Sequence[str], x: str, y: str, methods: Sequence[str] = ("lin", "loess", "spline")
) -> DataFrame:
    """Rows once per method with ``fitted``, ``resid``."""
    degrees = {"lin": 1, "quad": 2, "cub": 3}
    parts = []
    wanted = [degrees[m] for m in methods if m in degrees]
    if wanted or "poly" in methods:
        trends = polynomial_trends(df, keys, x, y, wanted if "poly" not in methods else (1, 2, 3), best="poly" in methods)
        parts.append(trends.where(F.col("method").isin(list(methods))).drop("aic"))
    if "loess" in methods:
        parts.append(loess_trend(df, keys, x, y).withColumn("method", F.lit("loess")))
    if "spline" in methods:
        parts.append(spline_trend(df, keys, x, y).withColumn("method", F.lit("spline")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def rebase_after(
    trend: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    base_years: Sequence[int],
    strict: bool = True,
    legacy_first: bool = False,
    keep_fitted: bool = False,
) -> DataFrame:
    """Each series as if its trend had stopped in a base year, long by ``type``.

    Up to the base year the value is the observed one, after it the residual plus
    the fit in the base year. ``type`` is ``OBS`` or ``y`` and the year. A series
    without the base year has null values after it. ``strict`` refuses series with
    two rows in one year. ``legacy_first`` leaves the first scenario unrebased.
    """
    keys = list(keys)
    per_year = trend.groupBy(*keys, x).agg(
        F.count(F.lit(1)).alias("__c"), F.max("fitted").alias("__f")
    )
    base = per_year.groupBy(*keys).agg(
        F.max("__c").alias("__c"),
        *[F.max(F.when(F.col(x) == b, F.col("__f"))).alias(f"__b{b}") for b in base_years],
    )
    rows = attach(trend, base, keys)
    if strict:
        message = F.lit("a series has more than one row in a year")
        rows = rows.withColumn(
            y, F.when(F.col("__c") > 1, F.raise_error(message).cast("double")).otherwise(F.col(y).cast("double"))
        )
    branch = lambda name, value: F.struct(F.lit(name).alias("type"), value.alias("value"))
    branches = [branch(OBSERVED, F.col(y).cast("double"))]
    for i, b in enumerate(base_years):
        level = F.col("fitted") if legacy_first and i == 0 else F.col(f"__b{b}")
        stopped = F.when(F.col(x) <= b, F.col(y)).otherwise(F.col("resid") + level)
        branches.append(branch(f"y{b}", stopped.cast("double")))
    if keep_fitted:
        branches.append(branch("fitted", F.col("fitted")))
    kept = [c for c in trend.columns if c not in (y, "fitted", "resid", "aic")]
    return rows.select(*kept, F.inline(F.array(*branches)))


def scenario_difference(
    df: DataFrame, keys: Sequence[str], value: str = "value", type_col: str = "type", ref: str = OBSERVED
) -> DataFrame:
    """Observed minus scenario for every row; ``keys`` name a row within a type."""
    reference = df.where(F.col(type_col) == ref).groupBy(*keys).agg(F.max(value).alias("__ref"))
    return (
        attach(df.where(F.col(type_col) != ref), reference, keys)
        .withColumn("difference", F.col("__ref") - F.col(value))
        .drop("__ref")
    )


def normalise_by_reference(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    type_col: str = "type",
    ref: str = OBSERVED,
    out: str = "value_norm",
) -> DataFrame:
    """(value - mean) / sd with the moments of the reference rows of each key."""
    moments = df.where(F.col(type_col) == ref).groupBy(*keys).agg(
        F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd")
    )
    return (
        attach(df, moments, keys)
        .withColumn(out, F.try_divide(F.col(value) - F.col("__mean"), F.col("__sd")))
        .drop("__mean", "__sd")
    )


def squared_variables(df: DataFrame, var_col: str, value: str = "value", suffix: str = "_sq") -> DataFrame:
    """Adds, for each long row, the row of the squared variable."""
    both = F.array(
        F.struct(F.col(var_col).alias("__n"), F.col(value).alias("__v")),
        F.struct(F.concat(F.col(var_col), F.lit(suffix)).alias("__n"), (F.col(value) * F.col(value)).alias("__v")),
    )
    rest = [c for c in df.columns if c not in (var_col, value)]
    return df.select(*rest, F.inline(both)).withColumnsRenamed({"__n": var_col, "__v": value})
