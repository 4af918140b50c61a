"""SQL building blocks shared by the check queries."""

from __future__ import annotations

from furrow.plans.rounding import ROUNDING_NUDGE
from furrow.plans.inputs import CROP_OF_TYPE


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded expression without negative zero, as in the Spark queries."""
    return f"(round({expr} + {ROUNDING_NUDGE}::DOUBLE, {digits}) + 0.0)" + (f" AS {name}" if name else "")


BY_NATION = """
by_nation AS (
  SELECT l.*, n_name, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(month(l_shipdate) AS INTEGER) AS mth
  FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

WITH_TYPE = BY_NATION + """,
with_type AS (
  SELECT b.*, p_type FROM by_nation b JOIN part ON l_partkey = p_partkey)"""

YIELD = WITH_TYPE + """,
yp AS (
  SELECT n_name AS department, p_type AS sp, y AS year,
         sum(l_extendedprice) / sum(l_quantity) AS yield,
         sum(l_quantity) AS area, sum(l_extendedprice) AS production
  FROM with_type GROUP BY ALL)"""

MONTHLY = WITH_TYPE + """,
ms AS (
  SELECT n_name AS department, p_type AS sp, CAST(12 * y + mth AS INTEGER) AS x,
         sum(l_extendedprice) / sum(l_quantity) AS value
  FROM with_type GROUP BY ALL)"""

WIDE = BY_NATION + """,
ww AS (
  SELECT n_name AS departement, y AS year, mth AS month,
         avg(l_quantity) AS tn, avg(l_quantity) + 10 * avg(l_discount) AS tx,
         avg(l_extendedprice) / 1000 AS pr, 100 * avg(l_tax) AS etp
  FROM by_nation GROUP BY ALL)"""

WEATHER = WIDE + """,
wl AS (
  SELECT departement, year AS year_cal, month, 'Tn' AS clim_var, tn AS value FROM ww
  UNION ALL SELECT departement, year, month, 'Tx', tx FROM ww
  UNION ALL SELECT departement, year, month, 'PR', pr FROM ww
  UNION ALL SELECT departement, year, month, 'ETP', etp FROM ww)"""

PANEL = BY_NATION + """,
mp AS (
  SELECT n_name AS departement, y AS year, mth AS month,
         sum(l_extendedprice) / sum(l_quantity) AS yield, sum(l_quantity) AS area,
         avg(l_quantity) AS tn, avg(l_quantity) + 10 * avg(l_discount) AS tx,
         avg(l_extendedprice) / 1000 AS pr, 100 * avg(l_tax) AS etp,
         ln(sum(l_extendedprice) / sum(l_quantity)) AS log_yield
  FROM by_nation GROUP BY ALL)"""

CROP_CASE = (
    "CASE sp " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CROP_OF_TYPE.items()) + " ELSE sp END"
)


def uniform(text: str, salt: int = 42) -> str:
    return f"(('0x' || substr(md5('{salt}|' || {text}), 1, 8))::BIGINT / 4294967296.0)"


def poly_sql(source: str, keys: str, x: str, y: str) -> str:
    """CTEs ending in ``pf``: fits f1..f3, squared errors and AIC by stepwise projection."""
    s = f"OVER (PARTITION BY {keys})"
    proj = lambda a, q: f"sum({a} * {q}) {s} / nullif(sum({q} * {q}) {s}, 0) * {q}"
    return f"""
p1 AS (SELECT *, {x} - avg({x}) {s} AS q1, {y} - avg({y}) {s} AS v, avg({y}) {s} AS my, count(*) {s} AS n FROM {source}),
p2 AS (SELECT *, q1*q1 - avg(q1*q1) {s} AS r2, q1*q1*q1 - avg(q1*q1*q1) {s} AS r3 FROM p1),
p3 AS (SELECT *, r2 - {proj('r2', 'q1')} AS q2, r3 - {proj('r3', 'q1')} AS r33 FROM p2),
p4 AS (SELECT *, r33 - {proj('r33', 'q2')} AS q3 FROM p3),
p5 AS (SELECT *, {proj('v', 'q1')} AS t1, {proj('v', 'q2')} AS t2, {proj('v', 'q3')} AS t3 FROM p4),
p6 AS (SELECT *, my + t1 AS f1, my + t1 + t2 AS f2, my + t1 + t2 + t3 AS f3,
  sum((v - t1) * (v - t1)) {s} AS rss1, sum((v - t1 - t2) * (v - t1 - t2)) {s} AS rss2,
  sum((v - t1 - t2 - t3) * (v - t1 - t2 - t3)) {s} AS rss3 FROM p5),
pf AS (SELECT *, n * (ln(2 * pi()) + ln(rss1 / n) + 1) + 6 AS aic1,
  n * (ln(2 * pi()) + ln(rss2 / n) + 1) + 8 AS aic2, n * (ln(2 * pi()) + ln(rss3 / n) + 1) + 10 AS aic3 FROM p6)"""


POLY_LONG = """
pl AS (
  SELECT *, 'lin' AS method, f1 AS fitted FROM pf UNION ALL SELECT *, 'quad', f2 FROM pf
  UNION ALL SELECT *, 'cub', f3 FROM pf
  UNION ALL SELECT *, 'poly', CASE WHEN aic1 <= least(aic2, aic3) THEN f1 WHEN aic3 <= aic2 THEN f3 ELSE f2 END FROM pf)"""


def loess_sql(source: str, keys: str, x: str, y: str, span: float = 0.75, cell: float = 0.2) -> str:
    """CTEs ending in ``lo``: source columns and fitted; one row per key and x assumed."""
    on = " AND ".join(f"{{a}}.{k.strip()} = {{b}}.{k.strip()}" for k in keys.split(","))
    j = lambda a, b: on.format(a=a, b=b)
    ks = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    return f"""
lr AS (SELECT {keys}, {x}::DOUBLE AS x, {y} AS y, row_number() OVER s AS r, lead({x}::DOUBLE) OVER s AS nx,
  count(*) OVER (PARTITION BY {keys}) AS m, min({x}) OVER (PARTITION BY {keys}) AS lo, max({x}) OVER (PARTITION BY {keys}) AS hi
  FROM {source} WINDOW s AS (PARTITION BY {keys} ORDER BY {x})),
lc AS (SELECT DISTINCT {keys}, 1::BIGINT AS l, m AS u, floor(m * ({span} * {cell})) AS fc, m FROM lr
  UNION ALL
  SELECT {keys}, CASE s WHEN 0 THEN l ELSE (l + u) // 2 + 1 END, CASE s WHEN 0 THEN (l + u) // 2 ELSE u END, fc, m
  FROM lc, (VALUES (0), (1)) t(s) WHERE u - l + 1 > fc AND l < u),
leaf AS (SELECT * FROM lc WHERE NOT (u - l + 1 > fc AND l < u)),
lv AS (SELECT {keys}, lo - 0.005 * greatest(hi - lo, greatest(abs(lo), abs(hi)) * 1e-3 + 1e-30) AS vx FROM lr WHERE r = 1
  UNION ALL SELECT {keys}, hi + 0.005 * greatest(hi - lo, greatest(abs(lo), abs(hi)) * 1e-3 + 1e-30) FROM lr WHERE r = m
  UNION ALL SELECT {ks('lr')}, (x + nx) / 2 FROM lr JOIN leaf ON {j('lr', 'leaf')} AND lr.r = leaf.u WHERE leaf.u < leaf.m),
lj AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY vx) AS j FROM lv),
ld AS (SELECT {ks('lj')}, j, vx, x, y, m, abs(x - vx) AS d FROM lj JOIN lr ON {j('lj', 'lr')}),
lh AS (SELECT *, row_number() OVER (PARTITION BY {keys}, j ORDER BY d) AS dr FROM ld),
lb AS (SELECT {keys}, j, max(CASE WHEN dr = floor(m * {span} + 1e-5) THEN d END) AS h FROM lh GROUP BY ALL),
lw AS (SELECT {ks('lh')}, lh.j, vx, h, (x - vx) / h AS t, y, pow(1 - pow(d / h, 3), 3) AS w FROM lh JOIN lb ON {j('lh', 'lb')} AND lh.j = lb.j WHERE d < h),
ls AS (SELECT {keys}, j, vx, h, sum(w) s0, sum(w*t) s1, sum(w*t*t) s2, sum(w*t*t*t) s3, sum(w*t*t*t*t) s4,
  sum(w*y) y0, sum(w*t*y) y1, sum(w*t*t*y) y2 FROM lw GROUP BY ALL),
lf AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det FROM ls),
lg AS (SELECT {keys}, j, vx, (y0*(s2*s4-s3*s3) - s1*(y1*s4-s3*y2) + s2*(y1*s3-s2*y2)) / det AS b,
  (s0*(y1*s4-y2*s3) - y0*(s1*s4-s3*s2) + s2*(s1*y2-s2*y1)) / det / h AS g FROM lf),
lk AS (SELECT *, lead(vx) OVER s AS vx1, lead(b) OVER s AS b1, lead(g) OVER s AS g1 FROM lg WINDOW s AS (PARTITION BY {keys} ORDER BY j)),
le AS (SELECT {ks('lr')}, lr.x, lr.y, (lr.x - vx) / (vx1 - vx) AS t, vx1 - vx AS wd, b, b1, g, g1 FROM lr JOIN lk ON {j('lr', 'lk')} AND lr.x > vx AND lr.x <= vx1),
lo AS (SELECT {keys}, x, y, (1-t)*(1-t)*(1+2*t)*b + t*t*(3-2*t)*b1 + t*(1-t)*(1-t)*wd*g - t*t*(1-t)*wd*g1 AS fitted FROM le)"""


def ols_sql(prefix: str, source: str, part: str, xs: list[str], y: str, w: str = "1.0") -> str:
    """CTEs ending in ``{prefix}_fit``: weighted least squares by stepwise projection.

    Adds ``pred`` to every row of the source; rows of weight 0 are predicted only.
    """
    over = f"OVER (PARTITION BY {part})" if part else "OVER ()"
    p = len(xs)
    mean = lambda e: f"sum(({w}) * {e}) {over} / sum({w}) {over}"
    steps = [
        f"{prefix}0 AS (SELECT *, {', '.join(f'{x} - {mean(x)} AS z{i}' for i, x in enumerate(xs))}, {y} - {mean(y)} AS vv, {mean(y)} AS my FROM {source})"
    ]
    for j in range(p - 1):
        proj = lambda i: f"z{i} - sum(({w}) * z{i} * z{j}) {over} / sum(({w}) * z{j} * z{j}) {over} * z{j} AS z{i}"
        keep = f"* EXCLUDE ({', '.join(f'z{i}' for i in range(j + 1, p))})"
        steps.append(f"{prefix}{j + 1} AS (SELECT {keep}, {', '.join(proj(i) for i in range(j + 1, p))} FROM {prefix}{j})")
    terms = " + ".join(f"sum(({w}) * vv * z{j}) {over} / sum(({w}) * z{j} * z{j}) {over} * z{j}" for j in range(p))
    steps.append(f"{prefix}_fit AS (SELECT *, my + {terms} AS pred FROM {prefix}{p - 1})")
    return ",\n".join(steps)


def fold_sql(block: str, cuts, salt: int = 42) -> str:
    u = uniform(f"CAST({block} AS VARCHAR)", salt)
    return "CASE " + " ".join(f"WHEN {u} <= {c} THEN 'Y{i}'" for i, c in enumerate(cuts, 1)) + " END"


def gof_sql(source: str, keys: str, s: str, o: str, digits: int = 6, series: str | None = None, order: str | None = None) -> str:
    """Full statement after the CTEs: the whole battery per key."""
    k = f"{keys}, " if keys else ""
    over = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    lag = f", lag(o) OVER (PARTITION BY {k}{series} ORDER BY {order}) AS p" if order else ""
    cp = (
        ", " + r("1 - sum(CASE WHEN p IS NOT NULL THEN pow(o - s, 2) END) / sum(pow(o - p, 2))", '"cp"', digits) if order else ""
    )
    group = f"GROUP BY {keys}" if keys else ""
    extra = ", ".join(dict.fromkeys([c for c in ([*(series or "").split(","), order or ""]) if c.strip() and c not in keys]))
    extra = f", {extra}" if extra else ""
    col = lambda e, n: r(e, f'"{n}"', digits)
    b = "(abs(sum(s * o) / sum(o * o)))"
    r2 = "pow(corr(s, o), 2)"
    return f"""
SELECT {k}count(*) AS n, {', '.join([
 col('avg(s - o)', 'ME'), col('avg(abs(s - o))', 'MAE'), col('avg(pow(s - o, 2))', 'MSE'), col('sqrt(avg(pow(s - o, 2)))', 'RMSE'),
 col('100 * sqrt(avg(pow(s - o, 2))) / stddev_samp(o)', 'NRMSE'), col('100 * sum(s - o) / sum(o)', 'PBIAS'),
 col('sqrt(avg(pow(s - o, 2))) / stddev_samp(o)', 'RSR'), col('stddev_samp(s) / stddev_samp(o)', 'rSD'),
 col('1 - sum(pow(o - s, 2)) / sum(pow(o - mo, 2))', 'NSE'), col('1 - sum(abs(o - s)) / sum(abs(o - mo))', 'mNSE'),
 col('1 - sum(pow((o - s) / o, 2)) / sum(pow((o - mo) / mo, 2))', 'rNSE'),
 col('1 - sum(pow(o - s, 2)) / sum(pow(abs(s - mo) + abs(o - mo), 2))', 'd'),
 col('1 - sum(abs(o - s)) / sum(abs(s - mo) + abs(o - mo))', 'md'),
 col('1 - sum(pow((o - s) / o, 2)) / sum(pow((abs(s - mo) + abs(o - mo)) / mo, 2))', 'rd'),
 col('corr(s, o)', 'r'), col(r2, 'R2'), col(f'CASE WHEN {b} <= 1 THEN {b} * {r2} ELSE {r2} / {b} END', 'bR2'),
 col('1 - sqrt(pow(corr(s, o) - 1, 2) + pow(stddev_samp(s) / stddev_samp(o) - 1, 2) + pow(avg(s) / avg(o) - 1, 2))', 'KGE'),
 col('1 - sum(abs(o - s)) / sum(o)', 'VE')])}{cp}
FROM (SELECT *, avg(o) {over} AS mo{lag} FROM (SELECT {k}{s} AS s, {o} AS o{extra} FROM {source})) {group}"""
