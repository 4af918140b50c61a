"""How well simulated values match observed ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.keys import attach

METRICS = [
    "ME", "MAE", "MSE", "RMSE", "NRMSE", "PBIAS", "RSR", "rSD", "NSE", "mNSE", "rNSE",
    "d", "md", "rd", "r", "R2", "bR2", "KGE", "VE",
]


def gof(
    df: DataFrame,
    keys: Sequence[str],
    sim: str,
    obs: str,
    series: Sequence[str] | None = None,
    order: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """One row per key with the whole battery; pairs with a null are left out.

    With ``series`` and ``order`` the persistence measure ``cp`` is added; its
    previous value is taken inside a series, so no window spans a whole model.
    """
    keys = list(keys)
    if order and not series:
        raise ValueError("an order needs the series it runs in")
    extra = [c for c in [*(series or []), *([order] if order else [])] if c not in keys]
    rows = df.select(
        *keys, *extra, F.col(sim).cast("double").alias("__s"), F.col(obs).cast("double").alias("__o")
    ).where(F.col("__s").isNotNull() & F.col("__o").isNotNull())
    s, o = F.col("__s"), F.col("__o")
    if order:
        before = Window.partitionBy(*dict.fromkeys([*keys, *(series or [])])).orderBy(order)
        rows = rows.withColumn("__p", F.lag("__o").over(before))
    means = rows.groupBy(*keys).agg(F.avg("__o").alias("__mo"))
    rows = attach(rows, means, keys)
    mo = F.col("__mo")
    gap, far = F.abs(s - o), F.abs(s - mo) + F.abs(o - mo)
    square = lambda c: c * c
    sums = {
        "n": F.count(F.lit(1)),
        "__e": F.sum(s - o),
        "__ae": F.sum(gap),
        "__se": F.sum(square(s - o)),
        "__so": F.sum(o),
        "__ss": F.sum(s),
        "__oo": F.sum(square(o - mo)),
        "__ao": F.sum(F.abs(o - mo)),
        "__far2": F.sum(square(far)),
        "__far": F.sum(far),
        "__rse": F.sum(square(F.try_divide(o - s, o))),
        "__roo": F.sum(square(F.try_divide(o - mo, mo))),
        "__rfar": F.sum(square(F.try_divide(far, mo))),
        "__sdo": F.stddev_samp("__o"),
        "__sds": F.stddev_samp("__s"),
        "r": F.corr("__s", "__o"),
        "__soo": F.sum(o * o),
        "__sso": F.sum(s * o),
    }
    if order:
        known = F.col("__p").isNotNull()
        sums["__pse"] = F.sum(F.when(known, square(o - s)))
        sums["__ppp"] = F.sum(F.when(known, square(o - F.col("__p"))))
    t = rows.groupBy(*keys).agg(*[c.alias(k) for k, c in sums.items()])
    ratio = F.try_divide
    c = F.col
    one_less = lambda a, b: 1 - ratio(c(a), c(b))
    t = t.withColumns({"R2": c("r") * c("r"), "RMSE": F.sqrt(c("__se") / c("n")), "__b": F.abs(ratio(c("__sso"), c("__soo")))})
    spread, bias = ratio(c("__sds"), c("__sdo")), ratio(c("__ss"), c("__so"))
    t = t.withColumns(
        {
            "ME": c("__e") / c("n"),
            "MAE": c("__ae") / c("n"),
            "MSE": c("__se") / c("n"),
            "NRMSE": 100 * ratio(c("RMSE"), c("__sdo")),
            "PBIAS": 100 * ratio(c("__e"), c("__so")),
            "RSR": ratio(c("RMSE"), c("__sdo")),
            "rSD": spread,
            "NSE": one_less("__se", "__oo"),
            "mNSE": one_less("__ae", "__ao"),
            "rNSE": one_less("__rse", "__roo"),
            "d": one_less("__se", "__far2"),
            "md": one_less("__ae", "__far"),
            "rd": one_less("__rse", "__rfar"),
            "bR2": F.when(c("__b") <= 1, c("__b") * c("R2")).otherwise(ratio(c("R2"), c("__b"))),
            "KGE": 1 - F.sqrt(square(c("r") - 1) + square(spread - 1) + square(bias - 1)),
            "VE": one_less("__ae", "__so"),
        }
    )
    names = METRICS
    if order:
        t = t.withColumn("cp", one_less("__pse", "__ppp"))
        names = METRICS + ["cp"]
    shown = [c(m) if digits is None else F.round(m, digits).alias(m) for m in names]
    return t.select(*keys, "n", *shown)


def rmse(df: DataFrame, sim: str, obs: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg((F.col(sim) - F.col(obs)) * (F.col(sim) - F.col(obs)))).alias("rmse")
    )


def residuals(df: DataFrame, obs: str, sim: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, F.col(obs) - F.col(sim))
