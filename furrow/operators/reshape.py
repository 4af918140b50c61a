"""Long, wide and nested forms of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.keys import attach

NEST_ROWS = 50_000


def to_wide(
    df: DataFrame, keys: Sequence[str], names_from: str, values_from: str, names: Sequence
) -> DataFrame:
    """Long to wide with a given list of names, so no extra job finds them.

    Two values for one cell are refused.
    """
    one = F.when(F.count(values_from) <= 1, F.max(values_from)).otherwise(
        F.raise_error(F.lit(f"more than one value of {values_from} for a row and a column")).cast(df.schema[values_from].dataType)
    )
    return df.groupBy(*keys).pivot(names_from, list(names)).agg(one)


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], names_to: str, values_to: str,
    drop_nulls: bool = False,
) -> DataFrame:
    out = df.unpivot(list(ids), list(values), names_to, values_to)
    return out.where(F.col(values_to).isNotNull()) if drop_nulls else out


def feature_wide(
    df: DataFrame,
    keys: Sequence[str],
    var_col: str,
    measures: Sequence[str],
    variables: Sequence[str],
    month_col: str | None = None,
    months: Sequence[int] = (),
) -> DataFrame:
    """One column per variable, measure and month, in a single pivot.

    Every measure column of every variable lands in the same row of the key; the
    reference form splits by variable, reshapes each and outer-joins the lot.
    """
    parts = [var_col, "__m"] + ([month_col] if month_col else [])
    long = df.unpivot(
        [*keys, var_col] + ([month_col] if month_col else []), list(measures), "__m", "__v"
    ).withColumn("__name", F.concat_ws("_", *[F.col(p).cast("string") for p in parts]))
    suffixes = [f"_{m}" for m in months] if month_col else [""]
    names = [f"{v}_{m}{s}" for v in variables for m in measures for s in suffixes]
    return to_wide(long, keys, "__name", "__v", names)


def nest_group(
    df: DataFrame, keys: Sequence[str], name: str = "data", max_rows: int = NEST_ROWS
) -> DataFrame:
    """Rows of a group as sorted arrays of structs, numbered by ``part``.

    A group has one part for each ``max_rows`` rows it begins, so no array grows with
    the largest group. The part of a row follows from its values, so a rerun or a retried task deals the
    same, however the rows are partitioned. Equal rows are counted first and dealt in runs of ``max_rows`` over the parts.
    Columns must be sortable (no maps).
    """
    rest = [c for c in df.columns if c not in keys]
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / max_rows).alias("__parts"))
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__many"))
    first = F.pmod(F.xxhash64(*rest) if rest else F.lit(0), F.col("__parts"))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__many") - 1) / max_rows))).alias("__run")
    dealt = attach(counted, sizes, keys).select(*counted.columns, "__parts", runs).select(
        *keys,
        F.pmod(first + F.col("__run"), F.col("__parts")).cast("int").alias("part"),
        F.struct(*rest).alias("__row"),
        F.least(F.col("__many") - F.col("__run") * max_rows, F.lit(max_rows)).cast("int").alias("__copies"),
    )
    rows = F.array_sort(F.collect_list(F.struct("__row", "__copies")))
    return dealt.groupBy(*keys, "part").agg(
        F.flatten(F.transform(rows, lambda x: F.array_repeat(x["__row"], x["__copies"]))).alias(name)
    )


def unnest_group(df: DataFrame, name: str = "data") -> DataFrame:
    others = [c for c in df.columns if c not in (name, "part")]
    return df.select(*others, F.inline(name))


def transpose(df: DataFrame, name_col: str, names: Sequence[str], into: str = "variable") -> DataFrame:
    """Columns become rows; ``names`` lists the values of ``name_col`` to keep as columns."""
    values = [c for c in df.columns if c != name_col]
    return to_wide(df.unpivot([name_col], values, into, "__v"), [into], name_col, "__v", names)
