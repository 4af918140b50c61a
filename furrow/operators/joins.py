"""Joins of panel tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.keys import null_safe_join


def natural_full_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on every column the two tables share."""
    common = [c for c in a.columns if c in b.columns]
    if not common:
        raise ValueError("the tables share no column")
    return null_safe_join(a, b, common, "full")


def multi_join(dfs: Sequence[DataFrame], keys: Sequence[str], how: str = "full") -> DataFrame:
    """Join a list of tables one after another on the same keys."""
    return reduce(lambda a, b: null_safe_join(a, b, keys, how), dfs)


def keyed_bind(a: DataFrame, b: DataFrame, keys: Sequence[str], mismatch: str = "mark") -> DataFrame:
    """Columns of two tables side by side, row by row of one key.

    ``bound`` tells whether a key is in both tables or in the left or right one only; with
    ``mismatch='refuse'`` the latter is an error.
    """
    both = null_safe_join(a.withColumn("__a", F.lit(True)), b.withColumn("__b", F.lit(True)), keys, "full")
    where = F.when(F.col("__a").isNull(), "right").when(F.col("__b").isNull(), "left").otherwise("both")
    if mismatch == "refuse":
        error = F.raise_error(F.lit("a key is in one of the tables only")).cast("string")
        where = F.when(where == "both", where).otherwise(error)
    return both.withColumn("bound", where).drop("__a", "__b")


def mutual_domain(
    a: DataFrame, b: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows of both tables whose key occurs in both; null keys count as equal."""
    sides = a.select(*keys, F.lit(1).alias("__s")).unionByName(
        b.select(*keys, F.lit(2).alias("__s"))
    )
    both = (
        sides.groupBy(*keys)
        .agg(F.min("__s").alias("__lo"), F.max("__s").alias("__hi"))
        .where(F.col("__lo") < F.col("__hi"))
        .select(*keys)
    )
    return null_safe_join(a, both, keys, "left_semi"), null_safe_join(b, both, keys, "left_semi")


def grid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every combination of the distinct values of the columns.

    The product is spread over buckets: one side is hashed into buckets, the
    other copied to each, so it stays an equi-join whatever the sizes. There are as
    many buckets as the session's shuffles have tasks.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def product(a: DataFrame, b: DataFrame) -> DataFrame:
        hashed = F.pmod(F.xxhash64(*a.columns), F.lit(buckets)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
        return (
            a.withColumn("__b", hashed).join(b.withColumn("__b", copies), "__b").drop("__b")
        )

    return reduce(product, [df.select(c).distinct() for c in cols])


def code_lookup(
    codes: DataFrame, names: DataFrame, code: str, name: str,
    first: tuple[int, int] = (1, 3), second: tuple[int, int] = (5, 3),
) -> DataFrame:
    """Names that contain both pieces of a code, e.g. ``bar_win_gs`` -> ``barley_winter``.

    The first piece is matched as an equi-join on the fixed-length substrings of
    the name, the second as a filter. Codes without a match keep a null name.
    """
    start, size = first
    spots = F.sequence(F.lit(1), F.greatest(F.length(name) - size + 1, F.lit(1)))
    pieces = (
        names.select(name)
        .distinct()
        .select(name, F.explode(F.array_distinct(F.transform(spots, lambda i: F.substr(F.col(name), i, F.lit(size))))).alias("__p"))
    )
    keyed = codes.withColumns(
        {
            "__p": F.substring(code, start, size),
            "__q": F.substring(code, *second),
        }
    )
    return (
        keyed.join(pieces, (keyed["__p"] == pieces["__p"]) & F.contains(pieces[name], keyed["__q"]), "left")
        .drop("__p", "__q")
    )
