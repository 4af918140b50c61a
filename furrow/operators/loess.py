"""Local regression per series, evaluated as its published default does.

A local quadratic is not fitted at every point: the series is cut into cells of
at most ``cell * span`` of its points, value and slope are fitted at the cell
borders only, and cubic blending fills the cells. The number of borders depends
on the two fractions alone (about ten), so work grows linearly with the points
and no pairs of points are formed.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.keys import attach, complete, null_safe_join
from furrow.operators.trend import orthogonal_solve

# Share of the range added on both ends.
BOX_MARGIN = 0.005


def _split_cells(points, limit, rounds: int):
    """Halve the ranks 1..points until every cell has at most ``limit`` of them."""
    cell = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    cells = F.array(cell(F.lit(1).cast("bigint"), points))

    def halve(c):
        middle = F.floor((c["lo"] + c["hi"]) / 2)
        small = (c["hi"] - c["lo"] + 1 <= limit) | (c["hi"] <= c["lo"])
        return F.when(small, F.array(c)).otherwise(
            F.array(cell(c["lo"], middle), cell(middle + 1, c["hi"]))
        )

    for _ in range(rounds):
        cells = F.flatten(F.transform(cells, halve))
    return cells


def loess_trend(
    df: DataFrame, keys: Sequence[str], x: str, y: str, span: float = 0.75, cell: float = 0.2
) -> DataFrame:
    """Rows with ``fitted`` and ``resid`` of a local quadratic with tricube weights."""
    keys = list(keys)
    if not 0 < span <= 1:
        raise ValueError("span must be in (0, 1]")
    valid = complete(df, [x, y])
    points = valid.groupBy(*keys, F.col(x).cast("double").alias("__x")).agg(
        F.count(F.lit(1)).alias("__w"), F.avg(y).alias("__y")
    )
    rounds = ceil(log2(2 / (span * cell))) + 1
    share = F.lit(span * cell)
    series = (
        points.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("__m"),
            F.sum("__w").alias("__n"),
            F.min("__x").alias("__lo"),
            F.max("__x").alias("__hi"),
        )
        .withColumns(
            {
                "__cells": _split_cells(F.col("__m"), F.floor(F.col("__m") * share), rounds),
                "__near": F.greatest(F.floor(F.col("__n") * span + 1e-5), F.lit(1)),
                "__pad": BOX_MARGIN
                * F.greatest(
                    F.col("__hi") - F.col("__lo"),
                    F.greatest(F.abs("__lo"), F.abs("__hi")) * 1e-3 + 1e-30,
                ),
            }
        )
    )
    # one row per distinct x of a series: at most the length of the time axis
    along = Window.partitionBy(*keys).orderBy("__x")
    ranked = attach(
        points.withColumns({"__r": F.row_number().over(along), "__next": F.lead("__x").over(along)}),
        series,
        keys,
    ).withColumn(
        "__cell",
        F.array_position(
            F.transform("__cells", lambda c: F.col("__r").between(c["lo"], c["hi"])), F.lit(True)
        ).cast("int"),
    )
    border = lambda no, at: F.struct(no.cast("int").alias("__j"), at.alias("__at"))
    last_of_cell = F.element_at("__cells", F.col("__cell"))["hi"] == F.col("__r")
    borders = ranked.select(
        *keys,
        F.inline(
            F.filter(
                F.array(
                    F.when(F.col("__r") == 1, border(F.lit(0), F.col("__x") - F.col("__pad"))),
                    F.when(
                        last_of_cell & (F.col("__r") < F.col("__m")),
                        border(F.col("__cell"), (F.col("__x") + F.col("__next")) / 2),
                    ),
                    F.when(F.col("__r") == F.col("__m"), border(F.col("__cell"), F.col("__x") + F.col("__pad"))),
                ),
                lambda s: s.isNotNull(),
            )
        ),
    )
    # distance to the near-th observation: cumulative counts by distance per border
    at_border = Window.partitionBy(*keys, "__j")
    spread = (
        null_safe_join(ranked.select(*keys, "__x", "__y", "__w", "__near"), borders, keys)
        .withColumn("__dist", F.abs(F.col("__x") - F.col("__at")))
        .withColumn("__cum", F.sum("__w").over(at_border.orderBy("__dist")))
        .withColumn("__h", F.min(F.when(F.col("__cum") >= F.col("__near"), F.col("__dist"))).over(at_border))
    )
    u = F.coalesce(F.try_divide(F.col("__x") - F.col("__at"), F.col("__h")), F.lit(0.0))
    weighted = spread.where(F.col("__dist") < F.col("__h")).withColumn("__u", u).withColumn(
        "__k", F.col("__w") * F.pow(1 - F.pow(F.abs("__u"), F.lit(3.0)), F.lit(3.0))
    )
    sums = weighted.groupBy(*keys, "__j", "__at", "__h").agg(
        *[F.sum(F.col("__k") * F.pow("__u", F.lit(float(i)))).alias(f"__s{i}") for i in range(5)],
        *[F.sum(F.col("__k") * F.pow("__u", F.lit(float(i))) * F.col("__y")).alias(f"__t{i}") for i in range(3)],
    )
    solved = orthogonal_solve(sums, 3, lambda i, j: F.col(f"__s{i + j}"), lambda i: F.col(f"__t{i}"))
    # from orthogonal terms back to value and slope at the border (u = 0)
    b2 = F.col("__c2")
    b1 = F.col("__c1") - F.col("__l21") * b2
    b0 = F.col("__c0") - F.col("__l10") * b1 - F.col("__l20") * b2
    fits = solved.select(*keys, "__j", "__at", b0.alias("__b"), (b1 / F.col("__h")).alias("__g"))
    next_border = Window.partitionBy(*keys).orderBy("__j")
    cells = fits.select(
        *keys,
        (F.col("__j") + 1).alias("__cell"),
        F.col("__at").alias("__a0"),
        F.col("__b").alias("__b0"),
        F.col("__g").alias("__g0"),
        *[F.lead(f"__{c}").over(next_border).alias(f"__{o}1") for c, o in (("at", "a"), ("b", "b"), ("g", "g"))],
    )
    width = F.col("__a1") - F.col("__a0")
    t = (F.col("__x") - F.col("__a0")) / width
    fit = (
        (1 - t) * (1 - t) * (1 + 2 * t) * F.col("__b0")
        + t * t * (3 - 2 * t) * F.col("__b1")
        + t * (1 - t) * (1 - t) * width * F.col("__g0")
        - t * t * (1 - t) * width * F.col("__g1")
    )
    fitted = null_safe_join(ranked.select(*keys, "__x", "__cell"), cells, [*keys, "__cell"]).select(
        *keys, "__x", fit.alias("fitted")
    )
    return (
        null_safe_join(valid.withColumn("__x", F.col(x).cast("double")), fitted, [*keys, "__x"])
        .withColumn("resid", F.col(y) - F.col("fitted"))
        .drop("__x")
    )
