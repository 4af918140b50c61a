"""Exact quantiles per group, whatever the size of a group.

Sketches, which merge, bound each wanted rank from both sides. Values below the lower bound
are only counted; those between the bounds, a thin slice of the group, are counted one
by one and put in order. The result is the type-7 quantile. One path serves all groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.keys import attach

# the sketch errs by one part in so many of the ranks
ACCURACY = 10_000
# the bounds keep so many times that distance from the wanted rank
MARGIN = 4


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    probs: Sequence[float],
    names: Sequence[str],
    approx: bool = False,
    few: bool = False,
) -> DataFrame:
    """One row per group: the named quantiles of ``col`` and ``n`` non-null values.

    ``few`` says that the number of groups does not depend on the rows. Their bounds are then
    broadcast, and no row is moved to the few tasks that the groups would hash to.
    """
    keys = list(keys)
    present = df.select(*keys, F.col(col).cast("double").alias("__v")).where(
        F.col("__v").isNotNull()
    )
    if approx:
        return present.groupBy(*keys).agg(
            *[F.percentile_approx("__v", p, ACCURACY).alias(n) for p, n in zip(probs, names)],
            F.count(F.lit(1)).alias("n"),
        )
    step = MARGIN / ACCURACY
    wanted = [x for p in probs for x in (max(p - step, 0.0), min(p + step, 1.0))]
    bounds = present.groupBy(*keys).agg(
        F.percentile_approx("__v", [float(x) for x in wanted], ACCURACY).alias("__q"),
        F.count(F.lit(1)).alias("n"),
        F.min("__v").alias("__lo"),
        F.max("__v").alias("__hi"),
    )
    placed = F.broadcast if few and keys else lambda t: t
    slices = []
    for i, p in enumerate(probs):
        # of a few values the next ranks lie further off than the step: there the slice is the group
        many = F.col("n") * step >= 8
        low = F.when(many & F.lit(p > step), F.col("__q")[2 * i]).otherwise(F.col("__lo"))
        high = F.when(many & F.lit(p + step < 1), F.col("__q")[2 * i + 1]).otherwise(F.col("__hi"))
        slices.append(F.struct(F.lit(i).alias("__i"), low.alias("__from"), high.alias("__to")))
    per_slice = bounds.select(*keys, "n", F.array(*slices).alias("__s"))
    # a value above a slice is dropped, one below it becomes null and is only counted
    parts = F.filter("__s", lambda s: F.col("__v") <= s["__to"])
    cut = F.transform(
        parts, lambda s: F.struct(s["__i"].alias("__i"), F.when(F.col("__v") >= s["__from"], F.col("__v")).alias("__x"))
    )
    counted = (
        attach(present, placed(per_slice), keys)
        .select(*keys, F.inline(cut))
        .groupBy(*keys, "__i", "__x")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    order = Window.partitionBy(*keys, "__i").orderBy(F.col("__x").asc_nulls_first())
    ranked = attach(counted, placed(bounds.select(*keys, "n")), keys).withColumn(
        "__end", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )

    def value_at(i: int, rank):
        inside = (F.col("__i") == i) & (F.col("__end") > rank) & (F.col("__end") - F.col("__c") <= rank)
        return F.max(F.when(inside, F.col("__x")))

    picks = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("n") - 1)
        picks += [value_at(i, F.floor(h)).alias(f"__l{i}"), value_at(i, F.ceil(h)).alias(f"__h{i}")]
    picked = ranked.groupBy(*keys, "n").agg(*picks)
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"__l{i}"), F.col(f"__h{i}")
        missed = F.raise_error(F.lit("a sketch did not bound its rank")).cast("double")
        # no step between equal values: infinities have no difference
        between = F.when(lo == hi, lo).otherwise(lo + (h - F.floor(h)) * (hi - lo))
        out.append(F.when(lo.isNull() | hi.isNull(), missed).otherwise(between).alias(name))
    return picked.select(*keys, *out, "n")


def iqr(df: DataFrame, keys: Sequence[str], col: str, approx: bool = False) -> DataFrame:
    """Interquartile range per group."""
    return group_quantiles(df, keys, col, [0.25, 0.75], ["__q1", "__q3"], approx).select(
        *keys, (F.col("__q3") - F.col("__q1")).alias("iqr")
    )
