"""Panels derived from the star-schema tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which crop each product line stands for in the examples.
CROP_OF_TYPE = {
    "ECONOMY": "wine_total",
    "LARGE": "barley_spring",
    "MEDIUM": "wheat_spring",
    "PROMO": "maize_total",
    "SMALL": "wheat_winter",
    "STANDARD": "rape_winter",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the nation of their supplier; joins sized by the optimiser."""
    items = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        items.join(suppliers, items.l_suppkey == suppliers.s_suppkey)
        .join(nations, F.col("s_nationkey") == nations.n_nationkey)
        .withColumns(
            {
                "year": F.year("l_shipdate"),
                "month": F.month("l_shipdate"),
            }
        )
    )


def _outcome(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("yield"),
        F.sum("l_quantity").alias("area"),
        F.sum("l_extendedprice").alias("production"),
    )


def _with_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return _by_nation(spark, sf_dir).join(parts, F.col("l_partkey") == parts.p_partkey)


def yield_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """department, sp, year, yield, area, production: one row per series and year."""
    return _outcome(
        _with_type(spark, sf_dir).withColumnsRenamed({"n_name": "department", "p_type": "sp"}),
        "department", "sp", "year",
    )


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the yield panel, by month index x = 12 * year + month; value = yield."""
    return _outcome(
        _with_type(spark, sf_dir)
        .withColumnsRenamed({"n_name": "department", "p_type": "sp"})
        .withColumn("x", F.col("year") * 12 + F.col("month")),
        "department", "sp", "x",
    ).select("department", "sp", "x", F.col("yield").alias("value"))


def weather_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """departement, year, month and the four measured variables."""
    return (
        _by_nation(spark, sf_dir)
        .withColumnRenamed("n_name", "departement")
        .groupBy("departement", "year", "month")
        .agg(
            F.avg("l_quantity").alias("Tn"),
            (F.avg("l_quantity") + 10 * F.avg("l_discount")).alias("Tx"),
            (F.avg("l_extendedprice") / 1000).alias("PR"),
            (100 * F.avg("l_tax")).alias("ETP"),
        )
    )


def weather_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """departement, year_cal, month, clim_var, value."""
    return (
        weather_wide(spark, sf_dir)
        .withColumnRenamed("year", "year_cal")
        .unpivot(
            ["departement", "year_cal", "month"], ["Tn", "Tx", "PR", "ETP"], "clim_var", "value"
        )
    )


def month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelling table: one row per department, year and month.

    Outcome ``yield`` and its log, weather features, ``area`` as weight.
    """
    return (
        _by_nation(spark, sf_dir)
        .withColumnRenamed("n_name", "departement")
        .groupBy("departement", "year", "month")
        .agg(
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("yield"),
            F.sum("l_quantity").alias("area"),
            F.avg("l_quantity").alias("Tn"),
            (F.avg("l_quantity") + 10 * F.avg("l_discount")).alias("Tx"),
            (F.avg("l_extendedprice") / 1000).alias("PR"),
            (100 * F.avg("l_tax")).alias("ETP"),
        )
        .withColumns({"log_yield": F.log("yield"), "gap": F.col("Tx") - F.col("Tn")})
    )
