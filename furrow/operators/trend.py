"""Polynomial trends per series, and what is derived from any trend.

All polynomial degrees of a series come from one table of power sums: the
factorisation of the largest normal matrix holds those of the smaller ones, and
the fit is a sum of orthogonal terms, so degree d just stops after term d.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.columns import separate
from furrow.functions.keys import attach, complete
from furrow.operators.aggregates import group_mean_all

METHOD_OF_DEGREE = {1: "lin", 2: "quad", 3: "cub"}
# a term counts as aliased when orthogonalisation leaves less than this share of it
ALIAS_TOLERANCE = 1e-9


def _sum(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def orthogonal_solve(table: DataFrame, size: int, moment, response) -> DataFrame:
    """Factor small normal matrices held as columns, one matrix per row.

    ``moment(i, j)`` and ``response(i)`` give the entries. Adds ``__d{i}`` (squared
    length of the i-th orthogonal term, null when aliased), ``__l{i}{j}`` and
    ``__c{i}`` (coefficient of the i-th orthogonal term, 0 when aliased).
    """
    for j in range(size):
        before = range(j)
        rest = moment(j, j)
        for m in before:
            rest = rest - F.col(f"__l{j}{m}") * F.col(f"__l{j}{m}") * F.coalesce(F.col(f"__d{m}"), F.lit(0.0))
        table = table.withColumn(
            f"__d{j}", F.when(rest > ALIAS_TOLERANCE * moment(j, j), rest)
        )
        lower = {}
        for i in range(j + 1, size):
            entry = moment(i, j)
            for m in before:
                entry = entry - F.col(f"__l{i}{m}") * F.col(f"__l{j}{m}") * F.coalesce(F.col(f"__d{m}"), F.lit(0.0))
            lower[f"__l{i}{j}"] = F.coalesce(entry / F.col(f"__d{j}"), F.lit(0.0))
        right = response(j)
        for m in before:
            right = right - F.col(f"__l{j}{m}") * F.col(f"__c{m}") * F.coalesce(F.col(f"__d{m}"), F.lit(0.0))
        lower[f"__c{j}"] = F.coalesce(right / F.col(f"__d{j}"), F.lit(0.0))
        table = table.withColumns(lower)
    return table


def poly_coefficients(df: DataFrame, keys: Sequence[str], x: str, y: str, degree: int) -> DataFrame:
    """One row per series with the orthogonal fit up to ``degree``.

    x is centred and scaled inside each series first, otherwise the cubic normal
    matrix of calendar years has no precision left.
    """
    rows = complete(
        df.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")), ["__x", "__y"]
    )
    centre = rows.groupBy(*keys).agg(
        F.avg("__x").alias("__cx"),
        ((F.max("__x") - F.min("__x")) / 2).alias("__hx"),
        F.avg("__y").alias("__cy"),
    )
    u = F.coalesce(F.try_divide(F.col("__x") - F.col("__cx"), F.col("__hx")), F.lit(0.0))
    scaled = attach(rows, centre, keys).select(
        *keys, "__cx", "__hx", "__cy", u.alias("__u"), (F.col("__y") - F.col("__cy")).alias("__v")
    )
    power = lambda k: F.lit(1.0) if k == 0 else _product([F.col("__u")] * k)
    sums = scaled.groupBy(*keys, "__cx", "__hx", "__cy").agg(
        *[F.sum(power(k)).alias(f"__s{k}") for k in range(2 * degree + 1)],
        *[F.sum(power(k) * F.col("__v")).alias(f"__t{k}") for k in range(degree + 1)],
        F.sum(F.col("__v") * F.col("__v")).alias("__yy"),
    )
    solved = orthogonal_solve(
        sums, degree + 1, lambda i, j: F.col(f"__s{i + j}"), lambda i: F.col(f"__t{i}")
    )
    n = F.col("__s0")
    per_degree = {}
    for d in range(1, degree + 1):
        explained = _sum([F.col(f"__c{i}") * F.col(f"__c{i}") * F.coalesce(F.col(f"__d{i}"), F.lit(0.0)) for i in range(d + 1)])
        rank = _sum([F.col(f"__d{i}").isNotNull().cast("int") for i in range(d + 1)])
        rss = F.greatest(F.col("__yy") - explained, F.lit(0.0))
        per_degree[f"__rss{d}"] = rss
        per_degree[f"__rank{d}"] = rank
        per_degree[f"__aic{d}"] = F.when(
            rss > 0, n * (log(2 * pi) + F.log(rss / n) + 1) + 2 * (rank + 1)
        ).otherwise(F.lit(float("-inf")))
    return solved.withColumns(per_degree)


def _product(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total * p
    return total


def _terms(df: DataFrame, x: str, degree: int) -> DataFrame:
    """Values of the orthogonal terms at each row, as ``__q{i}``."""
    u = F.coalesce(F.try_divide(F.col(x) - F.col("__cx"), F.col("__hx")), F.lit(0.0))
    df = df.withColumns({"__u": u, "__q0": F.lit(1.0)})
    for i in range(1, degree + 1):
        term = _product([F.col("__u")] * i)
        for j in range(i):
            term = term - F.col(f"__l{i}{j}") * F.col(f"__q{j}")
        df = df.withColumn(f"__q{i}", term)
    return df


def _fit_at(degree: int) -> Column:
    return _sum([F.col("__cy")] + [F.col(f"__c{i}") * F.col(f"__q{i}") for i in range(degree + 1)])


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def poly_trend(
    df: DataFrame, keys: Sequence[str], x: str, y: str, degree: int = 1, diagnostics: bool = False
) -> DataFrame:
    """Rows with ``fitted``, ``resid`` and ``aic`` of one degree.

    ``diagnostics`` adds sigma, hat, se_fit, std_resid and cooksd.
    """
    model = poly_coefficients(df, keys, x, y, degree)
    rows = _terms(attach(complete(df, [x, y]), model, keys), x, degree)
    out = rows.withColumns({"fitted": _fit_at(degree), "aic": F.col(f"__aic{degree}")}).withColumn(
        "resid", F.col(y) - F.col("fitted")
    )
    if diagnostics:
        rank = F.col(f"__rank{degree}")
        hat = _sum(
            [F.coalesce(F.col(f"__q{i}") * F.col(f"__q{i}") / F.col(f"__d{i}"), F.lit(0.0)) for i in range(degree + 1)]
        )
        out = out.withColumns(
            {"sigma": F.sqrt(F.try_divide(F.col(f"__rss{degree}"), F.col("__s0") - rank)), "hat": hat}
        )
        free = F.lit(1.0) - F.col("hat")
        out = out.withColumns(
            {
                "se_fit": F.col("sigma") * F.sqrt("hat"),
                "std_resid": F.when(free > 1e-9, F.try_divide(F.col("resid"), F.col("sigma") * F.sqrt(free))),
                "cooksd": F.when(
                    free > 1e-9,
                    F.pow(F.try_divide(F.col("resid"), F.col("sigma") * free), F.lit(2.0)) * F.col("hat") / rank,
                ),
            }
        )
    return _clean(out)


def polynomial_trends(
    df: DataFrame, keys: Sequence[str], x: str, y: str, degrees: Sequence[int] = (1, 2, 3), best: bool = True
) -> DataFrame:
    """Several degrees at once, long by ``method``; ``poly`` is the best by AIC.

    On equal AIC the linear fit wins, then the cubic, then the quadratic.
    """
    top = max(degrees)
    rows = _terms(
        attach(complete(df, [x, y]), poly_coefficients(df, keys, x, y, top), keys), x, top
    )
    rows = rows.withColumns({f"__f{d}": _fit_at(d) for d in degrees})
    branch = lambda name, f, a: F.struct(F.lit(name).alias("method"), f.alias("fitted"), a.alias("aic"))
    branches = [branch(METHOD_OF_DEGREE[d], F.col(f"__f{d}"), F.col(f"__aic{d}")) for d in degrees]
    if best:
        lowest = F.least(*[F.col(f"__aic{d}") for d in degrees]) if len(degrees) > 1 else F.col(f"__aic{degrees[0]}")
        order = [d for d in (1, 3, 2) if d in degrees]
        chosen = F.when(F.col(f"__aic{order[0]}") == lowest, F.col(f"__f{order[0]}"))
        for d in order[1:]:
            chosen = chosen.when(F.col(f"__aic{d}") == lowest, F.col(f"__f{d}"))
        branches.append(branch("poly", chosen, lowest))
    return (
        rows.select(*df.columns, F.inline(F.array(*branches)))
        .withColumn("resid", F.col(y) - F.col("fitted"))
    )


def best_poly_trend(
    df: DataFrame, keys: Sequence[str], x: str, y: str, degrees: Sequence[int] = (1, 2, 3)
) -> DataFrame:
    return polynomial_trends(df, keys, x, y, degrees).where(F.col("method") == "poly").drop("method")


def anomalies(trend: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Residual, residual over its spread in the series, residual in percent of the fit.

    ``keys`` name a series and should include ``method``.
    """
    spread = trend.groupBy(*keys).agg(F.stddev_samp("resid").alias("__sd"))
    return (
        attach(trend, spread, keys)
        .withColumns(
            {
                "anomaly": F.col("resid"),
                "anomaly_stand": F.try_divide("resid", "__sd"),
                "anomaly_norm": F.try_divide("resid", "fitted") * 100,
            }
        )
        .drop("__sd")
    )


def mean_anomaly(df: DataFrame, keys: Sequence[str], method: str = "method") -> DataFrame:
    """Mean anomaly per key, tidy: columns first, scaling, method, value.

    A mean is null when one of its anomalies is missing.
    """
    kinds = ["anomaly", "anomaly_stand", "anomaly_norm"]
    means = group_mean_all(df.select(*keys, method, *kinds), [*keys, method])
    tidy = means.unpivot([*keys, method], kinds, "variable", "value")
    return separate(tidy, "variable", ["first", "scaling"], "_")
