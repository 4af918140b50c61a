"""Rounding of query results, so that they can be compared with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Added before rounding: exact decimals that end in 5 (a price over 16 items) lie on
# a rounding edge, where the last bit of a sum would decide. Far below every digit kept.
ROUNDING_NUDGE = 1.7320508e-8


def rounded(col: Column | str, digits: int) -> Column:
    """Round off the edge, and turn -0.0 into 0.0, so that equal values hash equally."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(ROUNDING_NUDGE), digits) + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            rounded(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else f.name
            for f in df.schema.fields
        ]
    )
