"""Queries on grouped summaries, standardising, ranking and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.plans.rounding import round_doubles, rounded
from furrow.operators import aggregates as A
from furrow.operators.quantiles import iqr
from furrow.plans.catalog import query
from furrow.plans.inputs import table, weather_long, weather_wide, yield_panel
from furrow.plans.sql import WEATHER, WIDE, YIELD, r

WEATHER_VARS = ["Tn", "Tx", "PR", "ETP"]
YEARS = list(range(1995, 2002))


@query("a1_count_per_group", f"""WITH {YIELD}
SELECT department, sp, count(*) AS n FROM yp GROUP BY ALL""")
def _(spark, d):
    return yield_panel(spark, d).groupBy("department", "sp").agg(F.count(F.lit(1)).alias("n"))


@query("a2_availability", f"""WITH {WEATHER}
SELECT clim_var, {', '.join(f'count(CASE WHEN year_cal = {y} THEN 1 END) AS "{y}"' for y in YEARS)} FROM wl GROUP BY clim_var""")
def _(spark, d):
    return A.availability(weather_long(spark, d), "clim_var", "year_cal", YEARS)


@query("a3_max_count", f"""WITH {WEATHER}
SELECT departement, max(n) AS max_count FROM (SELECT departement, year_cal, count(*) AS n FROM wl GROUP BY ALL) GROUP BY ALL""")
def _(spark, d):
    return A.max_count(weather_long(spark, d), "departement", "year_cal")


@query("a4_group_moments", f"""WITH {WIDE}
SELECT departement, {', '.join(r(f'avg({v.lower()})', f'mean_{v}') + ', ' + r(f'stddev_samp({v.lower()})', f'sd_{v}') for v in WEATHER_VARS)}
FROM ww GROUP BY departement""")
def _(spark, d):
    return round_doubles(A.group_moments(weather_wide(spark, d), ["departement"], WEATHER_VARS))


@query("a5_group_mean_all", f"""WITH {WIDE}, g AS (SELECT departement, year, CASE WHEN month = 5 AND year = 1997 THEN NULL ELSE tn END AS tn, tx, pr, etp FROM ww)
SELECT departement, year, {r('CASE WHEN count(tn) = count(*) THEN avg(tn) END', 'Tn')}, {r('avg(tx)', 'Tx')}, {r('avg(pr)', 'PR')}, {r('avg(etp)', 'ETP')}
FROM g GROUP BY ALL""")
def _(spark, d):
    w = weather_wide(spark, d)
    gap = F.when(~((F.col("month") == 5) & (F.col("year") == 1997)), F.col("Tn"))
    return round_doubles(A.group_mean_all(w.withColumn("Tn", gap).drop("month"), ["departement", "year"]))


@query("a6_season_mean", f"""WITH {WEATHER}
SELECT departement, year_cal, clim_var, {r('avg(value)', 'value')} FROM wl WHERE month IN (6, 7, 8, 9) GROUP BY ALL""")
def _(spark, d):
    w = weather_long(spark, d)
    return round_doubles(A.season_mean(w, ["departement", "year_cal", "clim_var"], "value", months=[6, 7, 8, 9]))


@query("a7_iqr", f"""SELECT l_suppkey, l_returnflag, {r('quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)', 'iqr')}
FROM lineitem GROUP BY ALL""")
def _(spark, d):
    items = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice")
    return round_doubles(iqr(items, ["l_suppkey", "l_returnflag"], "l_extendedprice"))


@query("a8_weighted_rate", f"""WITH {YIELD}
SELECT sp, year, {r('sum(yield * area)', 'total', 3)}, {r('sum(area)', 'weight', 3)}, {r('sum(yield * area) / sum(area)', 'rate', 3)} FROM yp GROUP BY sp, year""")
def _(spark, d):
    return round_doubles(A.weighted_rate(yield_panel(spark, d), ["sp", "year"], "yield", "area", "rate"), 3)


@query("a9_distinct", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


def _with_gaps(spark, d):
    return weather_wide(spark, d).select(
        F.when(F.col("month") % 5 != 0, F.col("Tn")).alias("Tn"),
        F.when(F.col("year") % 3 != 0, F.col("Tx")).alias("Tx"),
        F.when((F.col("month") + F.col("year")) % 4 != 0, F.col("PR")).alias("PR"),
    )


GAPS = WIDE + """, g AS (SELECT CASE WHEN month % 5 <> 0 THEN tn END AS "Tn", CASE WHEN year % 3 <> 0 THEN tx END AS "Tx",
 CASE WHEN (month + year) % 4 <> 0 THEN pr END AS "PR" FROM ww)"""


@query("a10_missing_patterns", f"""WITH {GAPS}
SELECT concat(("Tn" IS NULL)::INT, ("Tx" IS NULL)::INT, ("PR" IS NULL)::INT) AS pattern, count(*) AS n FROM g GROUP BY ALL""")
def _(spark, d):
    return A.missing_patterns(_with_gaps(spark, d), ["Tn", "Tx", "PR"])


@query("a10_missing_share", f"WITH {GAPS} " + " UNION ALL ".join(
    f"""SELECT '{v}' AS variable, count(*) - count("{v}") AS missing, {r(f'(count(*) - count("{v}")) / count(*)', 'share')} FROM g""" for v in ("Tn", "Tx", "PR")))
def _(spark, d):
    return round_doubles(A.missing_share(_with_gaps(spark, d), ["Tn", "Tx", "PR"]))


@query("a11_summary_stats", " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, {r(f'min({c})', 'min')}, {r(f'quantile_cont({c}, 0.25)', 'q1')}, {r(f'quantile_cont({c}, 0.5)', 'median')},
 {r(f'avg({c})', 'mean')}, {r(f'quantile_cont({c}, 0.75)', 'q3')}, {r(f'max({c})', 'max')}, count(*) - count({c}) AS missing FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(spark, d):
    return round_doubles(A.summary_stats(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("a12_boxplot_stats", f"""WITH q AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.5) md,
 quantile_cont(o_totalprice, 0.75) q3, count(*) n FROM orders GROUP BY ALL)
SELECT p AS o_orderpriority, {r('q1', 'q1', 4)}, {r('md', 'median', 4)}, {r('q3', 'q3', 4)}, n,
 {r('min(CASE WHEN o_totalprice BETWEEN q1 - 0.4*(q3-q1) AND q3 + 0.4*(q3-q1) THEN o_totalprice END)', 'whisker_low', 4)},
 {r('max(CASE WHEN o_totalprice BETWEEN q1 - 0.4*(q3-q1) AND q3 + 0.4*(q3-q1) THEN o_totalprice END)', 'whisker_high', 4)},
 count(CASE WHEN NOT o_totalprice BETWEEN q1 - 0.4*(q3-q1) AND q3 + 0.4*(q3-q1) THEN 1 END) AS outliers
FROM orders JOIN q ON o_orderpriority = p GROUP BY p, q1, md, q3, n""")
def _(spark, d):
    return round_doubles(A.boxplot_stats(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", reach=0.4), 4)


@query("a13_histogram", """SELECT l_returnflag, CASE WHEN l_quantity <= 10 THEN '[0,10]' WHEN l_quantity <= 20 THEN '(10,20]' ELSE '(20,50]' END AS bin, count(*) AS n
FROM lineitem GROUP BY ALL""")
def _(spark, d):
    return A.histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", [0, 10, 20, 50])


@query("a14_density_grid", f"""WITH b AS (SELECT o_orderstatus AS k, count(*) n, min(o_totalprice) lo, max(o_totalprice) hi, stddev_samp(o_totalprice) sd,
 quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders GROUP BY ALL),
h AS (SELECT *, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS bw, (hi - lo) / 511 AS step FROM b),
p AS (SELECT k, least(floor((o_totalprice - lo) / step), 510) AS c, (o_totalprice - lo) / step AS pos FROM orders JOIN h ON o_orderstatus = k),
w AS (SELECT k, j, sum(wt) AS wt FROM (SELECT k, c AS j, 1 - (pos - c) AS wt FROM p UNION ALL SELECT k, c + 1, pos - c FROM p) GROUP BY ALL),
g AS (SELECT h.*, i, lo + (hi - lo) * i / 63 AS x FROM h, range(64) t(i))
SELECT g.k AS o_orderstatus, CAST(i AS INTEGER) AS point, {r('max(x)', 'x', 3)}, {r('1e6 * sum(wt * exp(-0.5 * pow((x - (lo + j * step)) / bw, 2)) / (bw * sqrt(2 * pi())) / n)', 'density')}
FROM g JOIN w ON g.k = w.k GROUP BY g.k, i""")
def _(spark, d):
    dens = A.density_grid(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", n=64)
    return dens.select("o_orderstatus", "point", rounded("x", 3).alias("x"), rounded(1e6 * F.col("density"), 6).alias("density"))


@query("a15_mean_sd_band", f"""WITH {WEATHER}
SELECT clim_var, year_cal, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, {r('avg(value) - stddev_samp(value)', 'low')}, {r('avg(value) + stddev_samp(value)', 'high')}
FROM wl GROUP BY ALL""")
def _(spark, d):
    return round_doubles(A.mean_sd_band(weather_long(spark, d), ["clim_var", "year_cal"], "value"))


@query("w2_standardise", f"""WITH {YIELD}
SELECT department, sp, year, {r('(yield - avg(yield) OVER w) / stddev_samp(yield) OVER w', 'yield_std')} FROM yp WINDOW w AS (PARTITION BY department, sp)""")
def _(spark, d):
    y = yield_panel(spark, d).drop("area", "production")
    return round_doubles(A.standardise(y, ["department", "sp"], ["yield"]).drop("yield"))


@query("w3_zscore", f"""WITH {YIELD}
SELECT department, sp, year, {r('(year - avg(year) OVER ()) / stddev_samp(year) OVER ()', 'year_z')}, {r('(yield - avg(yield) OVER ()) / stddev_samp(yield) OVER ()', 'yield_z')} FROM yp""")
def _(spark, d):
    y = yield_panel(spark, d).drop("area", "production")
    return round_doubles(A.zscore(y, ["year", "yield"]).drop("yield"))


@query("w4_offset_from_min", f"""WITH {YIELD}
SELECT department, sp, year, CAST(year - (min(year) OVER () - 1) AS INTEGER) AS "offset" FROM yp""")
def _(spark, d):
    return A.offset_from_min(yield_panel(spark, d).select("department", "sp", "year"), "year")


@query("w6_sort_peek", f"""WITH {YIELD}
SELECT department, {r('avg(yield)', 'mean_yield')} FROM yp GROUP BY department ORDER BY avg(yield) DESC LIMIT 10""")
def _(spark, d):
    means = yield_panel(spark, d).groupBy("department").agg(F.avg("yield").alias("mean_yield"))
    return round_doubles(means.orderBy(F.desc("mean_yield")).limit(10))
