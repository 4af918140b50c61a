"""Queries on columns, filters, joins, sets and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import columns as C
from furrow.functions import filters as FL
from furrow.functions.keys import null_safe_join
from furrow.plans.rounding import round_doubles, rounded
from furrow.operators import joins as J
from furrow.operators import reshape as R
from furrow.operators.aggregates import first_groups, hash_split, subtract_column
from furrow.plans.catalog import query
from furrow.plans.inputs import (
    CROP_OF_TYPE, monthly_series, table, weather_long, weather_wide, yield_panel,
)
from furrow.plans.sql import CROP_CASE, MONTHLY, WEATHER, WIDE, YIELD, r, uniform


@query("p1_rename_select", f"""WITH {YIELD}
SELECT department AS departement, year AS year_harvest, {r('yield', 'yield')} FROM yp""")
def _(spark, d):
    y = yield_panel(spark, d).withColumnsRenamed({"department": "departement", "year": "year_harvest"})
    return round_doubles(C.select_matching(y, exclude="^(sp|area|production)$"))


@query("p3_add_squares", f"""WITH {WIDE}
SELECT departement, year, month, {r('tn', 'Tn')}, {r('tx', 'Tx')}, {r('pr', 'PR')}, {r('etp', 'ETP')},
 {r('tn*tn', '"Tn_sq"')}, {r('tx*tx', '"Tx_sq"')}, {r('pr*pr', '"PR_sq"')}, {r('etp*etp', '"ETP_sq"')} FROM ww""")
def _(spark, d):
    return round_doubles(C.add_squares(weather_wide(spark, d), ["Tn", "Tx", "PR", "ETP"]))


@query("p4_rename_regex", f"""WITH {WIDE}
SELECT departement, year, month, {r('tn', '"OBS_Tn"')}, {r('tx', '"OBS_Tx"')} FROM ww""")
def _(spark, d):
    w = weather_wide(spark, d).drop("PR", "ETP")
    return round_doubles(C.rename_regex(w, "^T(.)$", r"OBS_T\1"))


@query("p5_parse_decimal", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS parsed FROM lineitem""")
def _(spark, d):
    # prices as local text (1.234,50), read back as numbers
    items = table(spark, d, "lineitem")
    text = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    return items.select("l_orderkey", "l_linenumber", "l_partkey", C.parse_decimal(text).alias("parsed"))


@query("p6_normalise_key", """
SELECT n_nationkey, replace(n_name, '_', '-') AS upper_key, lower(replace(n_name, '_', '''')) AS lower_key,
 count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def _(spark, d):
    n = table(spark, d, "nation").select(
        "n_nationkey",
        C.normalise_key("n_name", "upper", {"[_]": "-"}).alias("upper_key"),
        C.normalise_key("n_name", "lower", {"_": "'"}).alias("lower_key"),
    )
    cust = table(spark, d, "customer").groupBy("c_nationkey").count()
    return n.join(cust, n.n_nationkey == cust.c_nationkey, "left").select(
        "n_nationkey", "upper_key", "lower_key", F.coalesce("count", F.lit(0)).alias("customers")
    )


@query("p8_substring_extract", """
SELECT p_partkey, substr(p_type, 1, 3) AS head, right(p_type, 3) AS tail,
 regexp_extract(p_name, 'small|red|blue', 0) AS word, regexp_replace(p_brand, '.*#', '') AS brand_no
FROM part""")
def _(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        F.substring("p_type", 1, 3).alias("head"),
        F.right("p_type", F.lit(3)).alias("tail"),
        F.regexp_extract("p_name", "small|red|blue", 0).alias("word"),
        F.regexp_replace("p_brand", ".*#", "").alias("brand_no"),
    )


@query("p10_match_and_concat", """
SELECT p_partkey, concat_ws('_', p_type, p_brand) AS id FROM part
WHERE regexp_matches(p_name, 'ring|widget') AND contains(p_type, 'M') AND contains(p_type, 'O')""")
def _(spark, d):
    return (
        table(spark, d, "part")
        .where(F.col("p_name").rlike("ring|widget"))
        .where(F.col("p_type").contains("M") & F.col("p_type").contains("O"))
        .select("p_partkey", F.concat_ws("_", "p_type", "p_brand").alias("id"))
    )


@query("p12_separate", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS first,
 nullif(split_part(p_name, ' ', 2), '') AS second, nullif(split_part(p_name, ' ', 3), '') AS third FROM part""")
def _(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return C.separate(parts, "p_name", ["first", "second", "third"], " ")


@query("p13_recode", f"""WITH {YIELD}
SELECT department, year, {CROP_CASE} AS crop, {r('yield', 'yield')} FROM yp""")
def _(spark, d):
    y = yield_panel(spark, d)
    return round_doubles(y.select("department", "year", C.recode("sp", CROP_OF_TYPE).alias("crop"), "yield"))


@query("p15_case_when", f"""WITH {YIELD}
SELECT department, sp, year, CASE WHEN yield < 1800 THEN 'low' WHEN yield < 2200 THEN 'mid' ELSE 'high' END AS class,
 'yield' AS source FROM yp""")
def _(spark, d):
    y = F.col("yield")
    return yield_panel(spark, d).select(
        "department", "sp", "year",
        F.when(y < 1800, "low").when(y < 2200, "mid").otherwise("high").alias("class"),
        F.lit("yield").alias("source"),
    )


@query("p16_cut_fixed", """
SELECT cls, closed, count(*) AS n FROM (SELECT
 CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'a' WHEN l_quantity > 10 AND l_quantity <= 25 THEN 'b'
  WHEN l_quantity > 25 AND l_quantity <= 40 THEN 'c' END AS cls,
 CASE WHEN l_quantity >= 1 AND l_quantity <= 10 THEN '[1,10]' WHEN l_quantity > 10 AND l_quantity <= 50 THEN '(10,50]' END AS closed
 FROM lineitem) GROUP BY ALL""")
def _(spark, d):
    return (
        table(spark, d, "lineitem")
        .select(
            C.cut_fixed("l_quantity", [0, 10, 25, 40], ["a", "b", "c"]).alias("cls"),
            C.cut_fixed("l_quantity", [1, 10, 50], include_lowest=True).alias("closed"),
        )
        .groupBy("cls", "closed")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("p17_cut_width", """
WITH s AS (SELECT min(s_acctbal) lo, (max(s_acctbal) - min(s_acctbal)) / 10 w FROM supplier)
SELECT s_suppkey, CAST(least(greatest(ceil((s_acctbal - lo) / w), 1), 10) AS INTEGER) AS bin FROM supplier, s""")
def _(spark, d):
    return C.cut_width(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 10).drop("s_acctbal")


@query("p18_row_extremes", f"""WITH {WIDE}, g AS (
SELECT departement, year, month, CASE WHEN month % 5 = 0 THEN NULL ELSE tn END AS a, tx AS b, pr AS c FROM ww)
SELECT departement, year, month, {r('CASE WHEN a IS NULL THEN NULL ELSE least(a, b, c) END', 'strict_min')},
 {r('greatest(a, b, c)', 'loose_max')} FROM g""")
def _(spark, d):
    w = weather_wide(spark, d).withColumn("Tn", F.when(F.col("month") % 5 != 0, F.col("Tn")))
    return w.select(
        "departement", "year", "month",
        rounded(C.row_min("Tn", "Tx", "PR"), 6).alias("strict_min"),
        rounded(C.row_max("Tn", "Tx", "PR", skip_nulls=True), 6).alias("loose_max"),
    )


@query("p19_arithmetic", f"""WITH {WIDE}
SELECT departement, year, month, {r('(tn + tx) / 2', 'tmean')}, {r('ln(pr)', 'log_pr')},
 {r('exp(ln(pr)) / nullif(tn, 0) * 100', 'pct')}, CAST(CAST(month AS VARCHAR) AS DOUBLE) AS month_no FROM ww""")
def _(spark, d):
    return weather_wide(spark, d).select(
        "departement", "year", "month",
        rounded((F.col("Tn") + F.col("Tx")) / 2, 6).alias("tmean"),
        rounded(F.log("PR"), 6).alias("log_pr"),
        rounded(F.try_divide(F.exp(F.log("PR")), F.col("Tn")) * 100, 6).alias("pct"),
        F.col("month").cast("string").try_cast("double").alias("month_no"),
    )


PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("p21_one_hot", """
SELECT p_partkey, """ + ", ".join(f"CAST(p_type = '{t}' AS INTEGER) AS p_type_{t}" for t in PART_TYPES) + " FROM part")
def _(spark, d):
    return C.one_hot(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", PART_TYPES).drop("p_type")


@query("p22_derive_variable", f"""WITH {WEATHER}
SELECT departement, year_cal, month, clim_var, {r('value', 'value')} FROM wl
UNION ALL SELECT departement, year, month, 'Tmean', {r('(tn + tx) / 2')} FROM ww""")
def _(spark, d):
    w = weather_long(spark, d)
    keys = ["departement", "year_cal", "month"]
    out = C.derive_variable(w, keys, "clim_var", "value", "Tmean", ["Tn", "Tx"], lambda a, b: (a + b) / 2)
    return round_doubles(out)


@query("p24_feature_columns", f"""WITH {WEATHER}
SELECT departement, year_cal, {', '.join(r(f"max(CASE WHEN clim_var = '{v}' AND month = {m} THEN value END)", f'"{v}_{m}"') for v in ('Tn', 'PR') for m in (6, 7, 8))}
FROM wl WHERE month <= 8 AND clim_var IN ('Tn', 'PR') GROUP BY ALL""")
def _(spark, d):
    w = weather_long(spark, d).where((F.col("month") <= 8) & F.col("clim_var").isin("Tn", "PR"))
    keys = ["departement", "year_cal"]
    named = w.withColumn("name", F.concat_ws("_", "clim_var", F.col("month").cast("string")))
    names = [f"{v}_{m}" for v in ("Tn", "PR") for m in range(1, 9)]
    wide = R.to_wide(named, keys, "name", "value", names)
    kept = C.feature_columns(wide.columns, ["Tn", "PR", "RV"], range(1, 9), squares=True, last_n=3)
    return round_doubles(wide.select(*keys, *kept))


@query("f1_filters", f"""WITH {WEATHER}
SELECT departement, year_cal, month, clim_var, {r('value', 'value')} FROM wl
WHERE month IN (3,4,5,6,7,8,9,10) AND clim_var IN ('Tn','PR') AND departement NOT IN ('NATION_1','NATION_2') AND year_cal BETWEEN 1996 AND 2000""")
def _(spark, d):
    return round_doubles(
        weather_long(spark, d)
        .where(F.col("month").isin(list(range(3, 11))) & F.col("clim_var").isin("Tn", "PR"))
        .where(~F.col("departement").isin("NATION_1", "NATION_2") & F.col("year_cal").between(1996, 2000))
    )


@query("f2_drop_sentinel", """
SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS value FROM lineitem WHERE l_discount <> 0""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_discount") == 0, -9999.0).otherwise(F.col("l_discount")).alias("value"),
    )
    return FL.drop_sentinel(rows, "value", -9999.0)


@query("f3_model_rows", f"""WITH {WIDE}
SELECT departement, year, month, {r('tn', 'Tn')}, {r('pr', 'PR')}, {r('etp', 'ETP')} FROM ww
WHERE month % 5 <> 0 AND etp <> 0""")
def _(spark, d):
    w = weather_wide(spark, d).withColumn("Tn", F.when(F.col("month") % 5 != 0, F.col("Tn"))).drop("Tx")
    return round_doubles(FL.model_rows(w, "ETP", ["Tn", "PR"]).dropna("any"))


@query("f6_rows_with_missing", f"""WITH {WIDE}
SELECT departement, year, month, CAST(NULL AS DOUBLE) AS tn_gap, {r('pr', 'PR')} FROM ww WHERE month % 5 = 0""")
def _(spark, d):
    w = weather_wide(spark, d).select(
        "departement", "year", "month", F.when(F.col("month") % 5 != 0, F.col("Tn")).alias("tn_gap"), "PR"
    )
    return round_doubles(FL.rows_with_missing(w))


@query("f8_last_months", f"""WITH {WEATHER}, t AS (SELECT max(month) AS top FROM wl WHERE month <= 9)
SELECT departement, year_cal, month, clim_var, {r('value', 'value')} FROM wl, t WHERE month BETWEEN top - 3 AND top""")
def _(spark, d):
    return round_doubles(FL.last_months(weather_long(spark, d), "month", 4, 9))


@query("f9_min_group_size", f"""WITH {MONTHLY}
SELECT department, sp, x, {r('value', 'value')} FROM ms
WHERE (department, sp) IN (SELECT (department, sp) FROM ms GROUP BY department, sp HAVING count(*) > 58)""")
def _(spark, d):
    return round_doubles(FL.min_group_size(monthly_series(spark, d), ["department", "sp"], 58))


@query("f10_drop_flat_series", f"""WITH {WEATHER}, z AS (
 SELECT departement, clim_var, month, year_cal,
  CASE WHEN clim_var = 'PR' AND departement < 'NATION_2' THEN 1.0::DOUBLE ELSE value END AS value FROM wl),
flat AS (SELECT departement, clim_var, month FROM z GROUP BY ALL
 HAVING quantile_cont(value, 0.75) - quantile_cont(value, 0.25) = 0)
SELECT departement, clim_var, month, year_cal, {r('value', 'value')} FROM z
 WHERE (departement, clim_var, month) NOT IN (SELECT (departement, clim_var, month) FROM flat)""")
def _(spark, d):
    w = weather_long(spark, d).withColumn(
        "value",
        F.when((F.col("clim_var") == "PR") & (F.col("departement") < "NATION_2"), F.lit(1.0)).otherwise(F.col("value")),
    )
    out = FL.drop_flat_series(w, ["departement", "clim_var", "month"], "value")
    return round_doubles(out)


@query("j1_full_join", """
SELECT c_custkey, o_orderkey, c_mktsegment, o_orderstatus FROM customer
FULL JOIN (SELECT o_custkey AS k, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P') o ON c_custkey = k""")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").where(F.col("o_orderstatus") != "P").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus"
    )
    return null_safe_join(c, o, ["c_custkey"], "full")


@query("j2_natural_full_join", f"""WITH {YIELD}, a AS (SELECT department, sp, year, yield FROM yp WHERE year < 1999),
b AS (SELECT department, sp, year, area FROM yp WHERE year > 1996)
SELECT department, sp, year, {r('yield', 'yield')}, {r('area', 'area')} FROM a FULL JOIN b USING (department, sp, year)""")
def _(spark, d):
    y = yield_panel(spark, d)
    a = y.where("year < 1999").select("department", "sp", "year", "yield")
    b = y.where("year > 1996").select("department", "sp", "year", "area")
    return round_doubles(J.natural_full_join(a, b))


@query("j3_multi_join", f"""WITH {WEATHER}, k AS (SELECT DISTINCT departement, year_cal, month FROM wl)
SELECT k.*, {r('a.value', 'Tn')}, {r('b.value', 'PR')}, {r('c.value', 'ETP')} FROM k
LEFT JOIN (SELECT * FROM wl WHERE clim_var = 'Tn' AND month < 9) a USING (departement, year_cal, month)
LEFT JOIN (SELECT * FROM wl WHERE clim_var = 'PR' AND month > 3) b USING (departement, year_cal, month)
LEFT JOIN (SELECT * FROM wl WHERE clim_var = 'ETP' AND year_cal > 1996) c USING (departement, year_cal, month)
WHERE month < 9 OR month > 3 OR year_cal > 1996""")
def _(spark, d):
    w = weather_long(spark, d)
    keys = ["departement", "year_cal", "month"]
    pick = lambda v, cond: w.where((F.col("clim_var") == v) & cond).select(*keys, F.col("value").alias(v))
    parts = [
        pick("Tn", F.col("month") < 9), pick("PR", F.col("month") > 3), pick("ETP", F.col("year_cal") > 1996)
    ]
    return round_doubles(J.multi_join(parts, keys))


@query("j4_inner_many_to_many", """
SELECT l_partkey, l_orderkey, l_linenumber, s_suppkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def _(spark, d):
    items = table(spark, d, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey")
    )
    return null_safe_join(items, table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


@query("j5_semi_join", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def _(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return null_safe_join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), big, ["c_custkey"], "left_semi")


@query("j6_anti_join", """
SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def _(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return null_safe_join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), big, ["c_custkey"], "left_anti")


@query("j7_mutual_domain", f"""WITH {YIELD}, a AS (SELECT * FROM yp WHERE yield > 2000 AND year < 1998),
b AS (SELECT * FROM yp WHERE yield < 1900 AND year >= 1998),
k AS (SELECT department, sp FROM a INTERSECT SELECT department, sp FROM b)
SELECT 'cal' AS side, department, sp, year FROM a SEMI JOIN k USING (department, sp)
UNION ALL SELECT 'val', department, sp, year FROM b SEMI JOIN k USING (department, sp)""")
def _(spark, d):
    y = yield_panel(spark, d).select("department", "sp", "year", "yield")
    a, b = J.mutual_domain(
        y.where("yield > 2000 and year < 1998"), y.where("yield < 1900 and year >= 1998"), ["department", "sp"]
    )
    return a.withColumn("side", F.lit("cal")).unionByName(b.withColumn("side", F.lit("val"))).drop("yield")


@query("j9_keyed_bind", """WITH s AS (SELECT s_nationkey AS nationkey, s_acctbal < 0 AS debt, count(*) AS suppliers FROM supplier GROUP BY ALL),
c AS (SELECT c_nationkey AS nationkey, c_acctbal < 0 AS debt, count(*) AS customers FROM customer GROUP BY ALL)
SELECT nationkey, debt, suppliers, customers, CASE WHEN suppliers IS NULL THEN 'right' WHEN customers IS NULL THEN 'left' ELSE 'both' END AS bound
FROM s FULL JOIN c USING (nationkey, debt)""")
def _(spark, d):
    def per_nation(name: str, prefix: str, out: str):
        keys = [F.col(f"{prefix}_nationkey").alias("nationkey"), (F.col(f"{prefix}_acctbal") < 0).alias("debt")]
        return table(spark, d, name).groupBy(*keys).agg(F.count(F.lit(1)).alias(out))

    return J.keyed_bind(per_nation("supplier", "s", "suppliers"), per_nation("customer", "c", "customers"), ["nationkey", "debt"])


@query("j10_grid", f"""WITH {YIELD}
SELECT * FROM (SELECT DISTINCT department FROM yp), (SELECT DISTINCT sp FROM yp), (SELECT DISTINCT year FROM yp)""")
def _(spark, d):
    return J.grid(yield_panel(spark, d), ["department", "sp", "year"])


@query("j11_lookup", """
SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey <> 3
LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(spark, d):
    s, n, g = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n.where("n_nationkey <> 3"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(g, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("s_suppkey", "n_name", "r_name")
    )


@query("j12_code_lookup", f"""WITH codes AS (SELECT p_partkey, lower(substr(p_type, 1, 3)) || '_' || lower(substr(p_brand, 1, 3)) AS code FROM part)
SELECT p_partkey, code, c_mktsegment AS segment FROM codes LEFT JOIN (SELECT DISTINCT lower(p_type) || ' ' || lower(p_brand) AS c_mktsegment FROM part) n
ON contains(c_mktsegment, substr(code, 1, 3)) AND contains(c_mktsegment, substr(code, 5, 3))""")
def _(spark, d):
    part = table(spark, d, "part")
    codes = part.select(
        "p_partkey",
        F.concat_ws("_", F.lower(F.substring("p_type", 1, 3)), F.lower(F.substring("p_brand", 1, 3))).alias("code"),
    )
    names = part.select(F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand")).alias("segment"))
    return J.code_lookup(codes, names, "code", "segment")


@query("u1_union_by_name", f"""WITH {YIELD}
SELECT department, sp, year, {r('yield', 'yield')}, NULL::DOUBLE AS area FROM yp WHERE year = 1996
UNION ALL SELECT department, sp, year, NULL, {r('area', 'area')} FROM yp WHERE year <> 1996""")
def _(spark, d):
    y = yield_panel(spark, d)
    a = y.where("year = 1996").select("department", "sp", "year", "yield")
    b = y.where("year <> 1996").select("area", "year", "sp", "department")
    return round_doubles(a.unionByName(b, allowMissingColumns=True))


@query("u3_set_difference", """
(SELECT o_custkey AS k, 'only_orders' AS side FROM orders EXCEPT SELECT c_custkey, 'only_orders' FROM customer WHERE c_acctbal > 0)
UNION ALL (SELECT o_custkey, 'both' FROM orders INTERSECT SELECT c_custkey, 'both' FROM customer WHERE c_acctbal > 0)""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return o.subtract(c).withColumn("side", F.lit("only_orders")).unionByName(
        o.intersect(c).withColumn("side", F.lit("both"))
    )


@query("r1_to_wide", f"""WITH {WEATHER}
SELECT departement, year_cal, month, {', '.join(r(f"max(CASE WHEN clim_var = '{v}' THEN value END)", v) for v in ('Tn', 'Tx', 'PR', 'ETP'))}
FROM wl GROUP BY departement, year_cal, month""")
def _(spark, d):
    w = weather_long(spark, d)
    return round_doubles(R.to_wide(w, ["departement", "year_cal", "month"], "clim_var", "value", ["Tn", "Tx", "PR", "ETP"]))


@query("r2_to_long", f"""WITH {YIELD}
SELECT department, sp, year, 'yield' AS variable, {r('yield', 'value')} FROM yp WHERE yield IS NOT NULL
UNION ALL SELECT department, sp, year, 'area', {r('area')} FROM yp UNION ALL SELECT department, sp, year, 'production', {r('production')} FROM yp""")
def _(spark, d):
    y = yield_panel(spark, d)
    return round_doubles(R.to_long(y, ["department", "sp", "year"], ["yield", "area", "production"], "variable", "value", drop_nulls=True))


@query("r3_feature_wide", f"""WITH {WEATHER}
SELECT departement, year_cal, {', '.join(r(f"max(CASE WHEN clim_var = '{v}' AND month = {m} THEN {e} END)", f'"{v}_{n}_{m}"')
 for v in ('Tn', 'Tx', 'PR', 'ETP') for n, e in (('OBS', 'value'), ('dev', 'value - 25')) for m in range(1, 13))}
FROM wl GROUP BY departement, year_cal""")
def _(spark, d):
    w = weather_long(spark, d).withColumns({"OBS": F.col("value"), "dev": F.col("value") - 25})
    variables = ["Tn", "Tx", "PR", "ETP"]
    out = R.feature_wide(w, ["departement", "year_cal"], "clim_var", ["OBS", "dev"], variables, "month", list(range(1, 13)))
    return round_doubles(out)


@query("r4_nest_unnest", f"""WITH {YIELD}
SELECT department, sp, CAST(count(*) AS BIGINT) AS n, {r('sum(yield)', 'total')}, max(year) AS last FROM yp GROUP BY ALL""")
def _(spark, d):
    nested = R.nest_group(yield_panel(spark, d), ["department", "sp"])
    return round_doubles(
        R.unnest_group(nested).groupBy("department", "sp").agg(
            F.count(F.lit(1)).alias("n"), F.sum("yield").alias("total"), F.max("year").alias("last")
        )
    )


@query("r6_transpose", f"""WITH {YIELD}, t AS (
SELECT sp, avg(yield) a, avg(area) b, avg(production) / 1000 c FROM yp GROUP BY sp)
SELECT v AS variable, {', '.join(r(f"max(CASE WHEN sp = '{s}' THEN CASE v WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END END)", s) for s in sorted(CROP_OF_TYPE))}
FROM t, (VALUES ('a'), ('b'), ('c')) x(v) GROUP BY v""")
def _(spark, d):
    t = yield_panel(spark, d).groupBy("sp").agg(
        F.avg("yield").alias("a"), F.avg("area").alias("b"), (F.avg("production") / 1000).alias("c")
    )
    return round_doubles(R.transpose(t, "sp", sorted(CROP_OF_TYPE)))


@query("w8_hash_split", f"""
SELECT o_orderkey, {uniform('CAST(o_orderkey AS VARCHAR)')} < 0.3 AS train FROM orders""")
def _(spark, d):
    return hash_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.3)


@query("w9_subtract_column", f"""WITH {WIDE}
SELECT departement, year, month, {r('tn', 'Tn')}, {r('tx - tn', 'Tx')}, {r('pr - tn', 'PR')}, {r('etp - tn', 'ETP')} FROM ww""")
def _(spark, d):
    return round_doubles(subtract_column(weather_wide(spark, d), "Tn", ["Tx", "PR", "ETP"]))


@query("w10_first_groups", f"""WITH {YIELD}
SELECT department, sp, year, {r('yield', 'yield')} FROM yp WHERE department IN (SELECT DISTINCT department FROM yp ORDER BY 1 LIMIT 4)""")
def _(spark, d):
    return round_doubles(first_groups(yield_panel(spark, d), "department", 4).drop("area", "production"))
