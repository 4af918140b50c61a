"""Projections and scalar expressions on panel tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.keys import attach


def select_matching(
    df: DataFrame, include: str | None = None, exclude: str | None = None
) -> DataFrame:
    """Keep columns whose name contains the ``include`` regex and not ``exclude``."""
    kept = [
        c
        for c in df.columns
        if (include is None or re.search(include, c))
        and not (exclude is not None and re.search(exclude, c))
    ]
    return df.select(*[F.col(f"`{c}`") for c in kept])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def add_squares(
    df: DataFrame, cols: Sequence[str] | None = None, suffix: str = "_sq"
) -> DataFrame:
    """Squares of the raw values, taken before any normalisation."""
    cols = numeric_columns(df) if cols is None else cols
    return df.withColumns({c + suffix: F.col(c) * F.col(c) for c in cols})


def rename_regex(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    new = [re.sub(pattern, replacement, c) for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError(f"renaming makes two columns equal: {new}")
    return df.withColumnsRenamed(dict(zip(df.columns, new)))


def parse_decimal(col: str | Column, decimal: str = ",", group: str = ".") -> Column:
    """Number in a local notation to double; null where it is not a number."""
    c = F.col(col) if isinstance(col, str) else col
    plain = F.replace(F.replace(c, F.lit(group), F.lit("")), F.lit(decimal), F.lit("."))
    return plain.try_cast("double")


def normalise_key(
    col: str | Column, case: str | None = None, replace: Mapping[str, str] | None = None
) -> Column:
    """Clean a join key: regex replacements, then upper or lower case."""
    c = F.col(col) if isinstance(col, str) else col
    for pattern, value in (replace or {}).items():
        c = F.regexp_replace(c, pattern, value)
    return {"upper": F.upper, "lower": F.lower, None: lambda x: x}[case](c)


def separate(df: DataFrame, col: str, into: Sequence[str], sep: str, extra: str = "refuse") -> DataFrame:
    """Split a string column; missing pieces become null.

    Surplus pieces raise an error, are left out with ``extra='drop'``, or stay in the last
    column with ``extra='merge'``.
    """
    if extra == "merge":
        parts = F.split(F.col(col), sep, len(into))
    else:
        parts = F.split(F.col(col), sep)
    if extra == "refuse":
        message = F.lit(f"more than {len(into)} pieces in {col}")
        parts = F.when(F.size(parts) > len(into), F.raise_error(message).cast("array<string>")).otherwise(parts)
    return df.withColumns({name: F.get(parts, i) for i, name in enumerate(into)}).drop(col)


def recode(
    col: str | Column, mapping: Mapping[str, str], default: str | None = "keep"
) -> Column:
    """Replace values through a fixed dictionary; ``default='keep'`` keeps the others."""
    c = F.col(col) if isinstance(col, str) else col
    pairs = F.create_map(*[F.lit(v) for item in mapping.items() for v in item])
    found = F.try_element_at(pairs, c)
    if default == "keep":
        return F.coalesce(found, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def cut_fixed(
    col: str | Column,
    breaks: Sequence[float],
    labels: Sequence[str] | None = None,
    include_lowest: bool = False,
) -> Column:
    """Interval label of a value, intervals closed on the right; null outside."""
    c = F.col(col) if isinstance(col, str) else col
    if labels is None:
        labels = [f"({a:g},{b:g}]" for a, b in zip(breaks, breaks[1:])]
        if include_lowest:
            labels[0] = "[" + labels[0][1:]
    if len(labels) != len(breaks) - 1:
        raise ValueError("one label per interval is needed")
    out = F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        above = c >= breaks[i] if include_lowest and i == 0 else c > breaks[i]
        out = F.when(above & (c <= breaks[i + 1]), F.lit(labels[i])).otherwise(out)
    return out


def cut_width(df: DataFrame, col: str, k: int, out: str = "bin") -> DataFrame:
    """Number (1..k) of the equal-width interval of each value over the whole column."""
    span = df.agg(F.min(col).cast("double").alias("__lo"), F.max(col).cast("double").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / k
    raw = F.ceil(F.try_divide(F.col(col) - F.col("__lo"), width))
    bounded = F.least(F.greatest(raw, F.lit(1)), F.lit(k))
    bin_no = F.when(width == 0, F.lit(ceil(k / 2))).otherwise(bounded)
    return (
        attach(df, span, [])
        .withColumn(out, F.when(F.col(col).isNotNull(), bin_no).cast("int"))
        .drop("__lo", "__hi")
    )


def _extreme(fn, cols: Sequence[str], skip_nulls: bool) -> Column:
    value = fn(*[F.col(c) for c in cols])
    if skip_nulls:
        return value
    return F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]), value)


def row_min(*cols: str, skip_nulls: bool = False) -> Column:
    """Smallest of several columns; null if any is null unless told to skip."""
    return _extreme(F.least, cols, skip_nulls)


def row_max(*cols: str, skip_nulls: bool = False) -> Column:
    return _extreme(F.greatest, cols, skip_nulls)


def one_hot(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values}
    )


def derive_variable(
    df: DataFrame,
    keys: Sequence[str],
    var_col: str,
    value_col: str,
    name: str,
    inputs: Sequence[str],
    expr,
) -> DataFrame:
    """Add rows of a variable computed from other variables of the same key.

    ``expr`` receives one Column per input. Keys that lack an input get no row.
    """
    picked = df.where(F.col(var_col).isin(list(inputs))).groupBy(*keys).agg(
        *[F.max(F.when(F.col(var_col) == v, F.col(value_col))).alias(f"__{i}") for i, v in enumerate(inputs)]
    )
    derived = picked.select(
        *keys,
        F.lit(name).alias(var_col),
        expr(*[F.col(f"__{i}") for i in range(len(inputs))]).alias(value_col),
    ).where(F.col(value_col).isNotNull())
    return df.select(*keys, var_col, value_col).unionByName(derived)


def feature_columns(
    columns: Sequence[str],
    variables: Sequence[str],
    months: Sequence[int] | None = None,
    squares: bool = False,
    last_n: int | None = None,
    suffix: str = "_sq",
) -> list[str]:
    """Names ``variable[_month][suffix]`` that exist among ``columns``.

    ``last_n`` keeps the latest months by number, for each variable.
    """
    have = set(columns)
    out: list[str] = []
    for variable in variables:
        if months is None:
            names = [variable]
        else:
            present = [m for m in sorted(months) if f"{variable}_{m}" in have]
            kept = present if last_n is None else present[-last_n:]
            names = [f"{variable}_{m}" for m in kept]
        for name in names:
            wanted = [name] + ([name + suffix] if squares else [])
            out += [n for n in wanted if n in have]
    return out
