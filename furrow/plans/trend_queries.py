"""Queries on seasons, trends, anomalies and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.plans.rounding import round_doubles, rounded
from furrow.functions.filters import min_group_size
from furrow.operators import scenario as SC
from furrow.operators import trend as TR
from furrow.operators.aggregates import check_identity, season_mean
from furrow.operators.joins import null_safe_join
from furrow.operators.loess import loess_trend
from furrow.operators.reshape import to_wide
from furrow.operators.seasons import CROP_NAME, SEASONS, expand_seasons, join_panel
from furrow.operators.spline import spline_trend
from furrow.functions.columns import recode
from furrow.plans.catalog import query
from furrow.plans.inputs import CROP_OF_TYPE, monthly_series, weather_long, yield_panel
from furrow.plans.sql import CROP_CASE, MONTHLY, POLY_LONG, WEATHER, YIELD, loess_sql, poly_sql, r

SERIES = ["department", "sp"]
BASES = [1996, 1997, 1998, 1999, 2000]

SEASON_ROWS = ", ".join(
    f"('{sp}', {m}, {str(shift).lower()})" for sp, (months, shift) in SEASONS.items() for m in months
)
SEASON = WEATHER + f""",
sea AS (
  SELECT departement, year_cal, wl.month, clim_var, value, s.sp,
         CAST(year_cal + CASE WHEN s.shifted AND wl.month >= 8 THEN 1 ELSE 0 END AS INTEGER) AS year_harvest
  FROM wl JOIN (VALUES {SEASON_ROWS}) s(sp, month, shifted) ON wl.month = s.month
  WHERE NOT (s.shifted AND year_cal = 1995 AND wl.month < 8))"""


@query("t1_expand_seasons", f"""WITH {SEASON}
SELECT departement, year_cal, month, clim_var, sp, year_harvest, {r('value', 'value')} FROM sea""")
def _(spark, d):
    return round_doubles(expand_seasons(weather_long(spark, d), drop_before=(1995, 8)))


MONTHLY_POLY = MONTHLY + "," + poly_sql("ms", "department, sp", "x", "value")


@query("t2_poly_trend", f"""WITH {MONTHLY_POLY}
SELECT department, sp, x, {r('value', 'value', 4)}, {r('f3', 'fitted', 4)}, {r('value - f3', 'resid', 4)}, {r('aic3', 'aic', 4)} FROM pf""")
def _(spark, d):
    return round_doubles(TR.poly_trend(monthly_series(spark, d), SERIES, "x", "value", degree=3), 4)


@query("t3_fit_diagnostics", f"""WITH {MONTHLY}, {poly_sql('ms', 'department, sp', 'x', 'value')},
hh AS (SELECT *, 1.0 / n + q1 * q1 / sum(q1 * q1) OVER (PARTITION BY department, sp) AS hat, sqrt(rss1 / (n - 2)) AS sigma FROM pf)
SELECT department, sp, x, {r('f1', 'fitted', 4)}, {r('sigma', 'sigma', 4)}, {r('hat', 'hat')}, {r('sigma * sqrt(hat)', 'se_fit', 4)},
 {r('(value - f1) / (sigma * sqrt(1 - hat))', 'std_resid', 5)}, {r('pow((value - f1) / (sigma * (1 - hat)), 2) * hat / 2', 'cooksd')} FROM hh""")
def _(spark, d):
    t = TR.poly_trend(monthly_series(spark, d), SERIES, "x", "value", degree=1, diagnostics=True)
    return t.select(
        *SERIES, "x", rounded("fitted", 4).alias("fitted"), rounded("sigma", 4).alias("sigma"), rounded("hat", 6).alias("hat"),
        rounded("se_fit", 4).alias("se_fit"), rounded("std_resid", 5).alias("std_resid"), rounded("cooksd", 6).alias("cooksd"),
    )


@query("t4_best_poly", f"""WITH {YIELD}, big AS (SELECT * FROM yp WHERE (department, sp) IN (SELECT (department, sp) FROM yp GROUP BY department, sp HAVING count(*) > 4)),
{poly_sql('big', 'department, sp', 'year', 'yield')}, {POLY_LONG}
SELECT department, sp, year, {r('yield', 'yield', 4)}, {r('fitted', 'fitted', 4)}, {r('yield - fitted', 'resid', 4)}, {r('least(aic1, aic2, aic3)', 'aic', 4)} FROM pl WHERE method = 'poly'""")
def _(spark, d):
    y = min_group_size(yield_panel(spark, d), SERIES, 4).drop("area", "production")
    return round_doubles(TR.best_poly_trend(y, SERIES, "year", "yield"), 4)


@query("t5_loess_trend", f"""WITH RECURSIVE {MONTHLY}, {loess_sql('ms', 'department, sp', 'x', 'value')}
SELECT department, sp, CAST(x AS INTEGER) AS x, {r('y', 'value', 4)}, {r('fitted', 'fitted', 4)}, {r('y - fitted', 'resid', 4)} FROM lo""")
def _(spark, d):
    return round_doubles(loess_trend(monthly_series(spark, d), SERIES, "x", "value"), 4)


@query("t6_spline_trend")
def _(spark, d):
    return round_doubles(spline_trend(monthly_series(spark, d), SERIES, "x", "value"), 4)


@query("t7_detrend", f"""WITH RECURSIVE {MONTHLY}, {poly_sql('ms', 'department, sp', 'x', 'value')}, {loess_sql('ms', 'department, sp', 'x', 'value')}
SELECT department, sp, x, 'lin' AS method, {r('value', 'value', 4)}, {r('f1', 'fitted', 4)}, {r('value - f1', 'resid', 4)} FROM pf
UNION ALL SELECT department, sp, CAST(x AS INTEGER), 'loess', {r('y', 'value', 4)}, {r('fitted', 'fitted', 4)}, {r('y - fitted', 'resid', 4)} FROM lo""")
def _(spark, d):
    return round_doubles(SC.detrend(monthly_series(spark, d), SERIES, "x", "value", ["lin", "loess"]), 4)


@query("t7_detrend_all_methods")
def _(spark, d):
    return round_doubles(SC.detrend(monthly_series(spark, d), SERIES, "x", "value"), 4)


ANOMALY = MONTHLY_POLY + "," + POLY_LONG + """,
an AS (SELECT department, sp, x, method, value, fitted, value - fitted AS anomaly,
  (value - fitted) / stddev_samp(value - fitted) OVER (PARTITION BY department, sp, method) AS stand, (value - fitted) / fitted * 100 AS norm FROM pl)"""


@query("t8_anomalies", f"""WITH {ANOMALY}
SELECT department, sp, x, method, {r('fitted', 'fitted', 4)}, {r('anomaly', 'anomaly', 4)}, {r('stand', 'anomaly_stand')}, {r('norm', 'anomaly_norm')} FROM an""")
def _(spark, d):
    trends = TR.polynomial_trends(monthly_series(spark, d), SERIES, "x", "value")
    a = TR.anomalies(trends, [*SERIES, "method"])
    return a.select(
        *SERIES, "x", "method", rounded("fitted", 4).alias("fitted"), rounded("anomaly", 4).alias("anomaly"),
        rounded("anomaly_stand", 6).alias("anomaly_stand"), rounded("anomaly_norm", 6).alias("anomaly_norm"),
    )


@query("t9_mean_anomaly", f"""WITH {YIELD}, big AS (SELECT * FROM yp WHERE (department, sp) IN (SELECT (department, sp) FROM yp GROUP BY department, sp HAVING count(*) > 4)),
{poly_sql('big', 'department, sp', 'year', 'yield')}, {POLY_LONG},
an AS (SELECT sp, year, method, yield - fitted AS a, (yield - fitted) / stddev_samp(yield - fitted) OVER (PARTITION BY department, sp, method) AS b,
 (yield - fitted) / fitted * 100 AS c FROM pl)
SELECT sp, year, method, 'anomaly' AS first, s AS scaling, {r("CASE WHEN s IS NULL THEN avg(a) WHEN s = 'stand' THEN avg(b) ELSE avg(c) END", 'value', 4)}
FROM an, (VALUES (NULL), ('stand'), ('norm')) t(s) GROUP BY sp, year, method, s""")
def _(spark, d):
    y = min_group_size(yield_panel(spark, d), SERIES, 4)
    a = TR.anomalies(TR.polynomial_trends(y, SERIES, "year", "yield"), [*SERIES, "method"])
    return round_doubles(TR.mean_anomaly(a, ["sp", "year"]), 4)


MONTH_SERIES = ["departement", "clim_var", "month"]
REBASE = WEATHER + "," + poly_sql("wl", "departement, clim_var, month", "year_cal", "value") + """,
sc AS (SELECT departement, clim_var, month, year_cal, 'OBS' AS type, value FROM pf""" + "".join(
    f"""
 UNION ALL SELECT departement, clim_var, month, year_cal, 'y{b}', CASE WHEN year_cal <= {b} THEN value
  ELSE value - f1 + max(CASE WHEN year_cal = {b} THEN f1 END) OVER (PARTITION BY departement, clim_var, month) END FROM pf"""
    for b in BASES
) + ")"


def scenarios(spark, d):
    trend = TR.poly_trend(weather_long(spark, d), MONTH_SERIES, "year_cal", "value")
    return SC.rebase_after(trend, MONTH_SERIES, "year_cal", "value", BASES)


@query("t10_rebase_after", f"WITH {REBASE} SELECT departement, clim_var, month, year_cal, type, {r('value', 'value')} FROM sc")
def _(spark, d):
    return round_doubles(scenarios(spark, d))


@query("t11_scenario_difference", f"""WITH {REBASE}, o AS (SELECT * FROM sc WHERE type = 'OBS'),
df AS (SELECT s.clim_var, s.year_cal, s.type, o.value - s.value AS diff FROM sc s JOIN o USING (departement, clim_var, month, year_cal) WHERE s.type <> 'OBS')
SELECT clim_var, year_cal, type, {r('CASE WHEN count(diff) = count(*) THEN avg(diff) END', 'difference')} FROM df GROUP BY ALL""")
def _(spark, d):
    diff = SC.scenario_difference(scenarios(spark, d), [*MONTH_SERIES, "year_cal"])
    from furrow.operators.aggregates import group_mean_all

    means = group_mean_all(diff.select("clim_var", "year_cal", "type", "difference"), ["clim_var", "year_cal", "type"])
    return round_doubles(means)


@query("t12_normalise_by_reference", f"""WITH {REBASE}, v AS (SELECT departement, clim_var, month, year_cal, type, value FROM sc
 UNION ALL SELECT departement, clim_var || '_sq', month, year_cal, type, value * value FROM sc)
SELECT departement, clim_var, month, year_cal, type, {r('''(value - avg(CASE WHEN type = 'OBS' THEN value END) OVER w) / stddev_samp(CASE WHEN type = 'OBS' THEN value END) OVER w''', 'value_norm')}
FROM v WINDOW w AS (PARTITION BY clim_var, month)""")
def _(spark, d):
    both = SC.squared_variables(scenarios(spark, d), "clim_var")
    return round_doubles(SC.normalise_by_reference(both, ["clim_var", "month"]).drop("value"))


CROP_NAME_CASE = "CASE sp " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CROP_NAME.items()) + " ELSE sp END"
JOINED = SEASON + f""",
sm AS (SELECT departement, sp, year_harvest, clim_var, avg(value) AS value FROM sea GROUP BY ALL),
sw AS (SELECT upper(replace(departement, '_', '-')) AS departement, {CROP_NAME_CASE} AS sp, year_harvest,
  max(CASE WHEN clim_var = 'Tn' THEN value END) AS tn, max(CASE WHEN clim_var = 'Tx' THEN value END) AS tx,
  max(CASE WHEN clim_var = 'PR' THEN value END) AS pr, max(CASE WHEN clim_var = 'ETP' THEN value END) AS etp FROM sm GROUP BY ALL),
yy AS (SELECT replace(department, '_', '-') AS departement, {CROP_CASE} AS sp, year AS year_harvest, yield
  FROM (SELECT n_name AS department, p_type AS sp, y AS year, sum(l_extendedprice) / sum(l_quantity) AS yield
        FROM (SELECT b.*, p_type FROM by_nation b JOIN part ON l_partkey = p_partkey) GROUP BY ALL))"""


def season_with_yield(spark, d):
    seasons = expand_seasons(weather_long(spark, d), drop_before=(1995, 8))
    keys = ["departement", "sp", "year_harvest"]
    wide = to_wide(season_mean(seasons, [*keys, "clim_var"], "value"), keys, "clim_var", "value", ["Tn", "Tx", "PR", "ETP"])
    y = yield_panel(spark, d).select(
        F.col("department").alias("departement"), recode("sp", CROP_OF_TYPE).alias("sp"), F.col("year").alias("year_harvest"), "yield"
    )
    return join_panel(wide, y, keys, excluded=["NATION-7"])


@query("t13_join_panel", f"""WITH {JOINED}
SELECT departement, sp, year_harvest, {r('tn', 'Tn')}, {r('tx', 'Tx')}, {r('pr', 'PR')}, {r('etp', 'ETP')}, {r('yield', 'yield')}
FROM (SELECT * FROM sw WHERE departement <> 'NATION-7') FULL JOIN yy USING (departement, sp, year_harvest)""")
def _(spark, d):
    return round_doubles(season_with_yield(spark, d))


@query("t14_check_identity", f"""WITH RECURSIVE {MONTHLY}, {poly_sql('ms', 'department, sp', 'x', 'value')}, {loess_sql('ms', 'department, sp', 'x', 'value')},
fi AS (SELECT department, 'lin' AS method, value, f1 AS fitted, value - f1 AS resid FROM pf UNION ALL SELECT department, 'loess', y, fitted, y - fitted FROM lo)
SELECT department, method, count(*) AS n, {r('sum(value)', 'total', 4)}, max(abs(value - (fitted + resid))) < 1e-9 AS closed FROM fi GROUP BY department, method""")
def _(spark, d):
    trends = SC.detrend(monthly_series(spark, d), SERIES, "x", "value", ["lin", "loess"])
    # the total is that of the parts, the check takes it from the values
    sums = trends.groupBy("department", "method").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fitted") + F.col("resid")).alias("total"))
    gaps = check_identity(trends, ["department", "method"], "value", ["fitted", "resid"])
    return sums.join(gaps, ["department", "method"]).select("department", "method", "n", rounded("total", 4).alias("total"), (F.col("max_gap") < 1e-9).alias("closed"))
