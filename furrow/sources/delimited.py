"""Delimited files in and out, with explicit schemas."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.columns import parse_decimal


def _as_schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _read(spark, path, schema, sep: str, header: bool, decimal: str, null: str, group: str = "."):
    schema = _as_schema(schema)
    local = decimal != "."
    floats = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    on_file = T.StructType(
        [T.StructField(f.name, T.StringType()) if local and f.name in floats else f for f in schema.fields]
    )
    rows = spark.read.csv(path, schema=on_file, sep=sep, header=header, nullValue=null)
    if local:
        rows = rows.withColumns({c: parse_decimal(c, decimal, group) for c in floats})
    return rows


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str,
    sep: str = ";", decimal: str = ".", null: str = "NA",
) -> DataFrame:
    """File with a header line; with a decimal comma, doubles are parsed from text."""
    return _read(spark, path, schema, sep, True, decimal, null)


def read_positional(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str,
    sep: str = ",", decimal: str = ".", null: str = "NA",
) -> DataFrame:
    """File without a header; the schema names the columns by position."""
    return _read(spark, path, schema, sep, False, decimal, null)


def read_tagged(
    spark: SparkSession, glob: str, schema: T.StructType | str, tag_col: str, tag_regex: str,
    sep: str = ";", decimal: str = ".", null: str = "NA",
) -> DataFrame:
    """Files of a glob stacked, each row tagged with the first group of the regex
    found in the path of its file."""
    rows = _read(spark, glob, schema, sep, True, decimal, null)
    path = F.url_decode(F.col("_metadata.file_path"))
    return rows.select("*", F.regexp_extract(path, tag_regex, 1).alias(tag_col))


def read_partition(spark: SparkSession, path: str, column: str, value, format: str = "parquet") -> DataFrame:
    """One partition of a partitioned table; other directories are not read."""
    return spark.read.format(format).load(path).where(F.col(column) == value)


def write_delimited(
    df: DataFrame, path: str, sep: str = ";", decimal: str = ".", null: str = "NA", mode: str = "error"
) -> None:
    if decimal != ".":
        floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        df = df.withColumns({c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(decimal)) for c in floats})
    df.write.mode(mode).csv(path, sep=sep, header=True, nullValue=null)


def write_by_key(
    df: DataFrame, path: str, keys: Sequence[str], format: str = "parquet", mode: str = "error", **options
) -> None:
    """One directory per key value.

    Rows are gathered by key first, so a key gets few files; the rebalance hint lets
    AQE split a key that holds much of the table over several tasks.
    """
    (
        df.hint("rebalance", *[F.col(k) for k in keys])
        .write.mode(mode)
        .partitionBy(*keys)
        .format(format)
        .options(**options)
        .save(path)
    )


def sanitise_columns(df: DataFrame) -> DataFrame:
    """Names such as ``0<Tx<10`` or ``.fitted`` to letters, digits and underscores."""
    words = {"<": "_lt_", ">": "_gt_"}
    seen: set[str] = set()
    names = {}
    for c in df.columns:
        name = "".join(words.get(ch, ch) for ch in c)
        name = re.sub(r"[^A-Za-z0-9_]+", "_", name).strip("_") or "column"
        if name in seen:
            raise ValueError(f"two columns become {name}")
        seen.add(name)
        names[c] = name
    return df.toDF(*[names[c] for c in df.columns])
