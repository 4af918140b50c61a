"""Queries that write the panels to files of the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from furrow.plans.rounding import round_doubles
from furrow.plans.catalog import query
from furrow.plans.inputs import table, weather_long, yield_panel
from furrow.plans.sql import WEATHER, YIELD, r
from furrow.session import shared_folder
from furrow.sources import delimited as IO

YIELD_FILE = "department string, year int, yield double, area double, production double"


def _fresh(spark) -> str:
    return f"{shared_folder(spark)}/furrow-files/{uuid.uuid4().hex}"


YIELD_SQL = f"WITH {YIELD} SELECT department, sp, year, {r('yield', 'yield')}, {r('area', 'area')}, {r('production', 'production', 2)} FROM yp"


def _shown(df):
    return round_doubles(df.withColumn("production", F.round("production", 2)))


@query("s1_read_tagged", YIELD_SQL)
def _(spark, d):
    path = _fresh(spark)
    IO.write_by_key(yield_panel(spark, d), path, ["sp"], "csv", sep=";", header=True, nullValue="NA")
    return _shown(IO.read_tagged(spark, f"{path}/sp=*/*.csv", YIELD_FILE, "sp", "sp=([^/]+)/"))


@query("s2_read_positional", f"WITH {WEATHER} SELECT year_cal, clim_var, departement, month, {r('value', 'value')} FROM wl")
def _(spark, d):
    path = _fresh(spark)
    columns = ["year_cal", "clim_var", "departement", "month", "value"]
    weather_long(spark, d).select(*columns).write.csv(path, header=False, nullValue="NA")
    return round_doubles(
        IO.read_positional(spark, path, "year_cal int, clim_var string, departement string, month int, value double")
    )


@query("s3_read_decimal_comma", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS l_tax FROM lineitem""")
def _(spark, d):
    path = _fresh(spark)
    items = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("l_tax")
    )
    IO.write_delimited(items, path, decimal=",")
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_tax double"
    return IO.read_delimited(spark, path, schema, decimal=",")


@query("s4_read_partition", YIELD_SQL + " WHERE sp = 'SMALL'")
def _(spark, d):
    path = _fresh(spark)
    IO.write_by_key(yield_panel(spark, d), path, ["sp"])
    return round_doubles(IO.read_partition(spark, path, "sp", "SMALL").withColumn("production", F.round("production", 2)))


@query("s5_write_delimited", YIELD_SQL)
def _(spark, d):
    path = _fresh(spark)
    y = yield_panel(spark, d)
    IO.write_delimited(y, path)
    return _shown(IO.read_delimited(spark, path, y.schema))


@query("s6_write_by_key", YIELD_SQL)
def _(spark, d):
    path = _fresh(spark)
    IO.write_by_key(yield_panel(spark, d), path, ["sp", "year"])
    return _shown(spark.read.parquet(path))
