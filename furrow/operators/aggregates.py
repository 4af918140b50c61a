"""Grouped summaries of a panel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.columns import cut_fixed
from furrow.functions.keys import attach, null_safe_join
from furrow.operators.quantiles import group_quantiles


def availability(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Row counts per combination, one column per value, zero where there is none."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def max_count(df: DataFrame, row: str, column: str) -> DataFrame:
    """Largest cell of each row of the availability table."""
    return df.groupBy(row, column).count().groupBy(row).agg(F.max("count").alias("max_count"))


def mean_of(col: str, skip_nulls: bool = True) -> Column:
    """Mean; without ``skip_nulls`` it is null when any value of the group is null."""
    if skip_nulls:
        return F.avg(col)
    return F.when(F.count(col) == F.count(F.lit(1)), F.avg(col))


def group_moments(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    stats: Sequence[str] = ("mean", "sd"),
    skip_nulls: bool = True,
) -> DataFrame:
    def one(stat: str, c: str) -> Column:
        if stat == "mean":
            return mean_of(c, skip_nulls)
        if skip_nulls:
            return F.stddev_samp(c)
        return F.when(F.count(c) == F.count(F.lit(1)), F.stddev_samp(c))

    return df.groupBy(*keys).agg(*[one(s, c).alias(f"{s}_{c}") for c in cols for s in stats])


def group_mean_all(df: DataFrame, keys: Sequence[str], skip_nulls: bool = False) -> DataFrame:
    """Mean of every column that is not a key."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[mean_of(c, skip_nulls).alias(c) for c in cols])


def season_mean(
    df: DataFrame, keys: Sequence[str], value: str, month: str = "month",
    months: Sequence[int] | None = None, out: str | None = None,
) -> DataFrame:
    """Monthly values to one value per key, over all months or the given ones."""
    rows = df if months is None else df.where(F.col(month).isin(list(months)))
    return rows.groupBy(*keys).agg(F.avg(value).alias(out or value))


def weighted_rate(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Weighted mean per group from sums of value times weight."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return df.where(both).groupBy(*keys).agg(
        F.sum(F.col(value) * F.col(weight)).alias("total"), F.sum(weight).alias("weight")
    ).withColumn(out, F.try_divide("total", "weight"))


def missing_patterns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per combination of missing columns, written as a string of 0 and 1."""
    flags = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in cols])
    return df.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def missing_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: how many values are missing and which share that is."""
    totals = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
    )
    return totals.unpivot(["__n"], list(cols), "variable", "missing").select(
        "variable", "missing", F.try_divide("missing", "__n").alias("share")
    )


def summary_stats(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Minimum, quartiles, mean, maximum and null count, one row per column."""
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot(
        [], list(cols), "variable", "__v"
    )
    base = long.groupBy("variable").agg(
        F.min("__v").alias("min"),
        F.avg("__v").alias("mean"),
        F.max("__v").alias("max"),
        F.count_if(F.col("__v").isNull()).alias("missing"),
    )
    quart = group_quantiles(
        long, ["variable"], "__v", [0.25, 0.5, 0.75], ["q1", "median", "q3"], approx, few=True
    ).drop("n")
    return null_safe_join(base, quart, ["variable"], "left").select(
        "variable", "min", "q1", "median", "mean", "q3", "max", "missing"
    )


def boxplot_stats(df: DataFrame, keys: Sequence[str], col: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last value within ``reach`` IQR, outlier count."""
    quart = group_quantiles(df, keys, col, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    spread = F.col("q3") - F.col("q1")
    rows = attach(df.where(F.col(col).isNotNull()), quart, keys)
    inside = F.col(col).between(F.col("q1") - reach * spread, F.col("q3") + reach * spread)
    return rows.groupBy(*keys, "q1", "median", "q3", "n").agg(
        F.min(F.when(inside, F.col(col))).alias("whisker_low"),
        F.max(F.when(inside, F.col(col))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def histogram(
    df: DataFrame, keys: Sequence[str], col: str, breaks: Sequence[float], outside: str = "refuse"
) -> DataFrame:
    """Counts per bin. Values beyond the breaks raise an error, or are left out with ``outside='drop'``."""
    bins = cut_fixed(col, breaks, include_lowest=True)
    if outside == "refuse":
        message = F.lit(f"a value of {col} lies outside the breaks")
        bins = F.when(F.col(col).isNotNull() & bins.isNull(), F.raise_error(message).cast("string")).otherwise(bins)
    return (
        df.groupBy(*keys, bins.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("bin").isNotNull())
    )


def density_grid(
    df: DataFrame, keys: Sequence[str], col: str,
    bw: float | str = "nrd0", adjust: float = 1.0, n: int = 128, bins: int = 512,
) -> DataFrame:
    """Gaussian kernel density of each group on ``n`` points over its range.

    Values are first spread linearly over ``bins`` equal steps (two neighbours
    each), so the kernel sums touch bins times grid points per group, never rows
    times grid points.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(col).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__v").alias("__lo"),
        F.max("__v").alias("__hi"),
        F.stddev_samp("__v").alias("__sd"),
    )
    if bw == "nrd0":
        q = group_quantiles(rows, keys, "__v", [0.25, 0.75], ["__q1", "__q3"]).drop("n")
        base = attach(base, q, keys)
        scaled = (F.col("__q3") - F.col("__q1")) / 1.34
        narrow = F.least("__sd", scaled)
        spread = (
            F.when(narrow > 0, narrow).when(F.col("__sd") > 0, F.col("__sd")).otherwise(F.lit(1.0))
        )
        base = base.withColumn("__bw", 0.9 * spread * F.pow("__n", F.lit(-0.2)) * adjust).drop("__q1", "__q3")
    else:
        base = base.withColumn("__bw", F.lit(float(bw) * adjust))
    base = base.withColumn("__step", (F.col("__hi") - F.col("__lo")) / (bins - 1))
    pos = F.coalesce(F.try_divide(F.col("__v") - F.col("__lo"), F.col("__step")), F.lit(0.0))
    cell = F.least(F.floor(pos), F.lit(bins - 2))
    part = pos - cell
    binned = (
        attach(rows, base.select(*keys, "__lo", "__step"), keys)
        .select(*keys, cell.alias("__cell"), part.alias("__part"))
        .select(
            *keys,
            F.inline(
                F.array(
                    F.struct(F.col("__cell").alias("__j"), (1 - F.col("__part")).alias("__w")),
                    F.struct((F.col("__cell") + 1).alias("__j"), F.col("__part").alias("__w")),
                )
            ),
        )
        .groupBy(*keys, "__j")
        .agg(F.sum("__w").alias("__w"))
    )
    at = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("point") / (n - 1)
    u = (F.col("x") - (F.col("__lo") + F.col("__j") * F.col("__step"))) / F.col("__bw")
    kernel = F.exp(-0.5 * u * u) / (F.col("__bw") * 2.5066282746310002)
    return (
        attach(binned, base.drop("__sd"), keys)
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("x", at)
        .groupBy(*keys, "point")
        .agg(F.max("x").alias("x"), F.sum(F.col("__w") * kernel / F.col("__n")).alias("density"))
    )


def mean_sd_band(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Mean and mean plus or minus one standard deviation."""
    return df.groupBy(*keys).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd")).withColumns(
        {"low": F.col("mean") - F.col("sd"), "high": F.col("mean") + F.col("sd")}
    )


def standardise(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "_std") -> DataFrame:
    """(value - mean) / sd inside each group; over the whole table without keys."""
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols]
    )
    out = attach(df, stats, keys).withColumns(
        {c + suffix: F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in cols}
    )
    return out.drop(*[f"__{s}_{c}" for s in "ms" for c in cols])


def zscore(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return standardise(df, keys, cols, suffix="_z")


def offset_from_min(df: DataFrame, col: str, out: str = "offset") -> DataFrame:
    """1 for the smallest value of the table, 2 for the next integer, and so on."""
    low = df.agg(F.min(col).alias("__low"))
    return attach(df, low, []).withColumn(out, F.col(col) - (F.col("__low") - 1)).drop("__low")


def rank_models(quality: DataFrame, n: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Best n rows by R2 (high first), then MSE (low first)."""
    order = [F.desc_nulls_last("R2"), F.asc_nulls_last("MSE")]
    if not keys:
        return quality.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return quality.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hash_split(
    df: DataFrame, key: Sequence[str], fraction: float, salt: int = 42, out: str = "train"
) -> DataFrame:
    """Split rows by a hash of their key: repeatable, free of order and partitioning."""
    return df.withColumn(out, uniform_from(key, salt) < fraction)


def uniform_from(cols: Sequence[str], salt: int) -> Column:
    """A number in [0, 1) that depends only on the salt and the values."""
    text = F.concat_ws("|", F.lit(str(salt)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def subtract_column(df: DataFrame, ref: str, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) - F.col(ref) for c in cols})


def first_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of the first k distinct keys in sort order."""
    kept = df.select(key).distinct().orderBy(key).limit(k)
    return null_safe_join(df, kept, [key], "left_semi")


def check_identity(df: DataFrame, keys: Sequence[str], value: str, parts: Sequence[str]) -> DataFrame:
    """Largest gap between a value and the sum of its parts, per key."""
    total = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    return df.groupBy(*keys).agg(F.max(F.abs(F.col(value) - total)).alias("max_gap"))
