"""Growing seasons: which months of which year belong to a harvest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.columns import normalise_key, recode
from furrow.functions.keys import null_safe_join

# Months of the season and whether it starts in the year before harvest.
SEASONS = {
    "wne_tot_gs": ([3, 4, 5, 6, 7, 8, 9, 10], False),
    "bar_spr_gs": ([1, 2, 3, 4, 5, 6, 7, 8], False),
    "oat_spr_gs": ([1, 2, 3, 4, 5, 6, 7, 8], False),
    "wht_spr_gs": ([2, 3, 4, 5, 6, 7, 8], False),
    "mai_tot_gs": ([4, 5, 6, 7, 8, 9, 10, 11], False),
    "pot_tot_gs": ([4, 5, 6, 7, 8, 9, 10], False),
    "sug_tot_gs": ([4, 5, 6, 7, 8, 9, 10, 11], False),
    "sun_tot_gs": ([4, 5, 6, 7, 8, 9], False),
    "bar_win_gs": ([10, 11, 12, 1, 2, 3, 4, 5, 6, 7], True),
    "oat_win_gs": ([10, 11, 12, 1, 2, 3, 4, 5, 6, 7, 8], True),
    "wht_win_gs": ([10, 11, 12, 1, 2, 3, 4, 5, 6, 7, 8], True),
    "rap_win_gs": ([8, 9, 10, 11, 12, 1, 2, 3, 4, 5, 6, 7], True),
    "bar_tot_gs": ([10, 11, 12, 1, 2, 3, 4, 5, 6, 7], True),
    "oat_tot_gs": ([10, 11, 12, 1, 2, 3, 4, 5, 6, 7, 8], True),
    "wht_tot_gs": ([10, 11, 12, 1, 2, 3, 4, 5, 6, 7, 8], True),
    "rap_tot_gs": ([8, 9, 10, 11, 12, 1, 2, 3, 4, 5, 6, 7], True),
}

# Crop code to crop name.
CROP_NAME = {
    "bar_spr_gs": "barley_spring",
    "bar_tot_gs": "barley_total",
    "bar_win_gs": "barley_winter",
    "mai_tot_gs": "maize_total",
    "oat_spr_gs": "oats_spring",
    "oat_tot_gs": "oats_total",
    "oat_win_gs": "oats_winter",
    "pot_tot_gs": "potatoes_total",
    "rap_tot_gs": "rape_total",
    "rap_win_gs": "rape_winter",
    "sug_tot_gs": "sugarbeet_total",
    "sun_tot_gs": "sunflower_total",
    "x": "wheat_durum_total",
    "wht_spr_gs": "wheat_spring",
    "wht_tot_gs": "wheat_total",
    "wht_win_gs": "wheat_winter",
    "wne_tot_gs": "wine_total",
}


def expand_seasons(
    df: DataFrame,
    seasons: Mapping[str, tuple[Sequence[int], bool]] = SEASONS,
    year: str = "year_cal",
    month: str = "month",
    shift_from: int = 8,
    drop_before: tuple[int, int] | None = None,
) -> DataFrame:
    """One row per crop whose season holds the month, with its harvest year.

    The season table is a literal of at most crops x 12 rows, kept as an array
    per month in the plan, so the fan-out needs neither a join nor a shuffle.
    ``drop_before=(year, month)`` removes the months of that year before the
    month for crops that start in the year before harvest.
    """
    by_month: dict[int, list[tuple[str, bool]]] = {}
    for sp, (months, shifted) in seasons.items():
        for m in months:
            by_month.setdefault(m, []).append((sp, shifted))
    entry = lambda sp, shifted: F.struct(F.lit(sp).alias("sp"), F.lit(shifted).alias("__shift"))
    crops = None
    for m, items in by_month.items():
        values = F.array(*[entry(*i) for i in items])
        crops = F.when(F.col(month) == m, values) if crops is None else crops.when(F.col(month) == m, values)
    out = df.select("*", F.inline(crops))
    if drop_before is not None:
        first_year, first_month = drop_before
        out = out.where(
            ~(F.col("__shift") & (F.col(year) == first_year) & (F.col(month) < first_month))
        )
    shifted = F.col("__shift") & (F.col(month) >= shift_from)
    return out.withColumn("year_harvest", F.col(year) + shifted.cast("int")).drop("__shift")


def join_panel(
    weather: DataFrame,
    yields: DataFrame,
    keys: Sequence[str] = ("departement", "sp", "year_harvest"),
    how: str = "full",
    excluded: Sequence[str] = (),
) -> DataFrame:
    """Season weather with outcomes, after both sides' keys are brought to one form."""
    clean = lambda c: normalise_key(c, "upper", {"[_']": "-"})
    left = weather.withColumns({"departement": clean("departement"), "sp": recode("sp", CROP_NAME)})
    right = yields.withColumn("departement", clean("departement"))
    if excluded:
        left = left.where(~F.col("departement").isin(list(excluded)))
    return null_safe_join(left, right, keys, how)
