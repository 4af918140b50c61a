"""Row filters: sentinels, missing values, group sizes, flat series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.keys import attach, complete, null_safe_join
from furrow.operators.quantiles import iqr


def drop_sentinel(df: DataFrame, col: str, value: float = -9999.0) -> DataFrame:
    return df.where(F.col(col) != F.lit(value))


def model_rows(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    """Rows a model can use: complete features, response present and not zero."""
    return complete(df, [y, *features]).where(F.col(y) != 0)


def rows_with_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = df.columns if cols is None else cols
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]))


def last_months(df: DataFrame, month: str = "month", n: int = 4, cap: int = 9) -> DataFrame:
    """Keep the n latest months not after ``cap``, over the whole table."""
    top = df.where(F.col(month) <= cap).agg(F.max(month).alias("__top"))
    return (
        attach(df, top, [])
        .where(F.col(month).between(F.col("__top") - (n - 1), F.col("__top")))
        .drop("__top")
    )


def min_group_size(df: DataFrame, keys: Sequence[str], more_than: int) -> DataFrame:
    """Rows of groups with more than ``more_than`` rows."""
    big = df.groupBy(*keys).count().where(F.col("count") > more_than).drop("count")
    return null_safe_join(df, big, keys, "left_semi")


def drop_flat_series(
    df: DataFrame, keys: Sequence[str], value: str, exclude_keys: Sequence[str] | None = None
) -> DataFrame:
    """Drop series whose interquartile range is zero.

    With ``exclude_keys`` (a subset of the keys) one flat series removes every
    series that shares those keys.
    """
    out_keys = list(exclude_keys or keys)
    flat = iqr(df, keys, value).where(F.col("iqr") == 0).select(*out_keys).distinct()
    return null_safe_join(df, flat, out_keys, "left_anti")
