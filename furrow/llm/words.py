"""Word and column helpers shared by the native operators.

A word is a run of code points other than U+0020 and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null, empty and blank texts."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_RUN)).otherwise(
        F.array().cast("array<string>")
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluating ``value`` once however often it is used."""
    return F.transform(F.array(value), body)[0]


def unit_hash(key: Column, salt: str) -> Column:
    """A number in (0, 1) with 52 bits, the same for equal keys on every run."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{salt}|"), key)), 1, 13)
    return (F.conv(digest, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def unit_hash_sql(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}|' || {key}), 1, 13))::BIGINT + 0.5::DOUBLE) / {2**52}::DOUBLE"


def with_columns_of(docs: DataFrame, needed: dict[str, str]) -> DataFrame:
    """``docs`` with every needed column; one that is missing is added as null of the given type."""
    return docs.withColumns(
        {c: F.lit(None).cast(kind) for c, kind in needed.items() if c not in docs.columns}
    )


def long_schema(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(c, T._parse_datatype_string(k)) for c, k in kinds.items()])
