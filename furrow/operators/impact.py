"""What a scenario does to predicted outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.columns import cut_fixed
from furrow.functions.keys import attach
from furrow.operators.aggregates import group_mean_all


def scenario_impact(
    pred: DataFrame, keys: Sequence[str], pred_col: str = "pred", type_col: str = "type",
    ref: str = "OBS", log_scale: bool = True,
) -> DataFrame:
    """Observed against scenario per row: ``diff`` and ``diff_pct`` of the observed value.

    ``keys`` name a row within a type.
    """
    value = F.exp(pred_col) if log_scale else F.col(pred_col)
    rows = pred.withColumn("__v", value)
    base = rows.where(F.col(type_col) == ref).groupBy(*keys).agg(F.max("__v").alias("observed"))
    return (
        attach(rows.where(F.col(type_col) != ref), base, keys)
        .withColumn("scenario", F.col("__v"))
        .withColumns(
            {
                "diff": F.col("observed") - F.col("scenario"),
                "diff_pct": F.try_divide(F.col("observed") - F.col("scenario"), F.col("observed")) * 100,
            }
        )
        .drop("__v")
    )


def mean_impact(impact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean differences per key; null if any is missing."""
    return group_mean_all(impact.select(*keys, "diff", "diff_pct"), keys)


def impact_classes(
    impact: DataFrame, col: str, breaks: Sequence[float], units: DataFrame | None = None, key: str = "departement"
) -> DataFrame:
    """Class of each unit's value; units without a value keep a null class."""
    classed = impact.withColumn("class", cut_fixed(col, breaks, include_lowest=True))
    if units is None:
        return classed
    return units.join(classed, key, "left")


def regional_production(
    pred: DataFrame, keys: Sequence[str], pred_col: str = "pred", observed: str = "yield", area: str = "area",
    log_scale: bool = True,
) -> DataFrame:
    """Production and area-weighted yield per key, predicted and observed."""
    value = F.exp(pred_col) if log_scale else F.col(pred_col)
    rows = pred.where(F.col(area).isNotNull() & F.col(observed).isNotNull() & F.col(pred_col).isNotNull())
    sums = rows.groupBy(*keys).agg(
        F.sum(value * F.col(area)).alias("pred_production"),
        F.sum(F.col(observed) * F.col(area)).alias("production"),
        F.sum(area).alias("area"),
    )
    return sums.withColumns(
        {
            "pred_yield": F.try_divide("pred_production", "area"),
            "yield": F.try_divide("production", "area"),
        }
    )
