"""Joins of group-level tables onto rows, and small column helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RIGHT = "__right_"


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which a null key matches a null key; keys appear once.

    For an outer join the key is taken from whichever side has the row. No size
    is assumed for either side: AQE turns the join into a broadcast when the
    measured size allows and splits hot partitions otherwise. It does not split those of a
    full join, which is therefore the left join and the rows of the right table
    whose key the left one lacks.
    """
    if how in ("full", "outer", "full_outer", "fullouter"):
        both = null_safe_join(left, right, keys, "left")
        only = null_safe_join(right, left.select(*keys), keys, "left_anti")
        rest = [c for c in left.columns if c not in keys]
        only = only.select(*keys, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest], *[c for c in right.columns if c not in keys])
        return both.select(*keys, *rest, *[c for c in right.columns if c not in keys]).union(only)
    renamed = right.withColumnsRenamed({k: _RIGHT + k for k in keys})
    on = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(_RIGHT + k)) for k in keys]
    )
    joined = left.join(renamed, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("right", "right_outer"):
        rest = [c for c in joined.columns if c not in keys and not c.startswith(_RIGHT)]
        return joined.select(
            *[F.coalesce(F.col(k), F.col(_RIGHT + k)).alias(k) for k in keys], *rest
        )
    return joined.drop(*[_RIGHT + k for k in keys])


def attach(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add group-level columns to the rows of each group.

    Without keys ``groups`` is a single aggregated row; it is read as one
    scalar subquery, so no join is planned at all. This replaces windows over
    whole groups, which would sort a hot group in a single task.
    """
    if keys:
        return null_safe_join(df, groups, keys, how)
    values = groups.select(F.struct(*groups.columns).alias("s")).scalar()
    named = df.withColumn("__scalars", values)
    return named.withColumns(
        {c: F.col("__scalars").getField(c) for c in groups.columns}
    ).drop("__scalars")


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash small solver inputs by key over as many tasks as the session's shuffles have.

    Collapsed tables are so small that AQE would merge them into one task, while
    their solves are what takes the time.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows without null or NaN in the columns.

    One predicate per column: ``dropna`` tests all columns in a single expression, and
    the optimiser then derives a variant of it for every subset of renamed columns.
    """
    tests = []
    for c in dict.fromkeys(cols):
        tests.append(F.col(c).isNotNull())
        if df.schema[c].dataType.typeName() in ("double", "float"):
            tests.append(~F.isnan(c))
    return df.where(reduce(lambda a, b: a & b, tests))
