"""Year-block folds, splits and cross-validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.columns import cut_fixed
from furrow.functions.filters import model_rows
from furrow.functions.keys import attach, complete
from furrow.operators.aggregates import uniform_from
from furrow.operators.gram import gram, training_matrices
from furrow.operators.linear import PATH, fit_models, predict
from furrow.operators.quality import gof

TWO_FOLDS = (0.5, 1.0)
FOUR_FOLDS = (0.25, 0.5, 0.75, 1.0)


def fold_labels(cuts: Sequence[float]) -> list[str]:
    return [f"Y{i}" for i in range(1, len(cuts) + 1)]


def block_folds(
    df: DataFrame, block: str | Sequence[str] = "year", cuts: Sequence[float] = TWO_FOLDS,
    salt: int = 42, out: str = "fold",
) -> DataFrame:
    """Fold label of each block of years.

    The draw of a block is a hash of salt and block, so it needs no table of
    distinct years, no join and no shuffle, and never changes between runs.
    """
    blocks = [block] if isinstance(block, str) else list(block)
    draw = uniform_from(blocks, salt)
    return df.withColumn(out, cut_fixed(draw, [0.0, *cuts], fold_labels(cuts), include_lowest=True))


def inner_folds(df: DataFrame, row_keys: Sequence[str], k: int, salt: int = 7, out: str = "inner") -> DataFrame:
    """Random fold number 0..k-1 of each row, from a hash of its key."""
    return df.withColumn(out, F.floor(uniform_from(row_keys, salt) * k).cast("int"))


def cv_split(
    df: DataFrame, fold: str, keys: Sequence[str], labels: Sequence[str], excluded: dict | None = None
) -> DataFrame:
    """Each row once per round, as ``role`` cal or val.

    Keys that lack rows on either side of a round are left out of that round, and so
    are the ``excluded`` values ({column: [values]}).
    """
    keys = list(keys)
    for column, values in (excluded or {}).items():
        df = df.where(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(fold) == x).alias(f"__n{i}") for i, x in enumerate(labels)]
    )
    rounds = F.filter(
        F.array(
            *[
                F.when((F.col(f"__n{i}") > 0) & (F.col(f"__n{i}") < F.col("__n")), F.lit(x))
                for i, x in enumerate(labels)
            ]
        ),
        lambda v: v.isNotNull(),
    )
    usable = per_key.select(*keys, rounds.alias("__rounds"))
    return (
        attach(df, usable, keys)
        .withColumn("round", F.explode("__rounds"))
        .withColumn("role", F.when(F.col(fold) == F.col("round"), "val").otherwise("cal"))
        .drop("__rounds")
    )


def cross_validate(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    y: str,
    models: Sequence[str] = ("ols", "lasso", "ridge", "elnet", "pls"),
    block: str = "year",
    cuts: Sequence[float] = TWO_FOLDS,
    row_keys: Sequence[str] | None = None,
    inner: int = 10,
    observed: str | None = None,
    response_is_log: bool = True,
    salt: int = 42,
    max_ncomp: int | None = None,
    steps: int = PATH,
) -> tuple[DataFrame, DataFrame]:
    """(quality, predictions) of models fitted per group without the held-out block.

    Groups are ``keys`` (none: all rows pooled). The rows are read once to sum their
    cross products per group, fold and inner fold, and once to score them; training
    sets, tuning and fits are sums and solves on those small tables.
    """
    keys, labels = list(keys), fold_labels(cuts)
    usable = model_rows(df, observed or y, features)
    folded = inner_folds(block_folds(usable, block, cuts, salt), row_keys or [*keys, block], inner)
    sums = gram(folded, [*keys, "fold", "inner"], features, y)
    training = training_matrices(sums, [*keys, "inner"], "fold", labels)
    fits = fit_models(training, [*keys, "fold"], models, max_ncomp, steps)
    scored = predict(fits, folded, [*keys, "fold"], features)
    simulated = F.exp("pred") if response_is_log else F.col("pred")
    quality = gof(scored.withColumn("simulated", simulated), ["model"], "simulated", observed or y)
    return quality, scored.drop("inner")


def calibrate(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, models: Sequence[str],
    row_keys: Sequence[str], inner: int = 10, max_ncomp: int | None = None, steps: int = PATH,
) -> DataFrame:
    """In-sample predictions of several models, long by ``model``."""
    keys = list(keys)
    rows = inner_folds(complete(df, [y, *features]), row_keys, inner)
    fits = fit_models(gram(rows, [*keys, "inner"], features, y), keys, models, max_ncomp, steps)
    return predict(fits, rows.drop("inner"), keys, features)


def predict_scenarios(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, models: Sequence[str],
    row_keys: Sequence[str], type_col: str = "type", ref: str = "OBS", inner: int = 10,
    max_ncomp: int | None = None, steps: int = PATH,
) -> DataFrame:
    """Fit on the observed rows of each group, predict the rows of every type."""
    keys = list(keys)
    observed = inner_folds(df.where(F.col(type_col) == ref), row_keys, inner)
    fits = fit_models(gram(observed, [*keys, "inner"], features, y), keys, models, max_ncomp, steps)
    return predict(fits, complete(df, list(features)), keys, features)


def mix_scenarios(
    long: DataFrame, keys: Sequence[str], choice: dict[str, dict[str, str]],
    var_col: str = "clim_var", value: str = "value", label: str | None = None,
) -> DataFrame:
    """Wide features with a scenario chosen per variable.

    ``choice`` maps a variable to the column values to keep, such as
    ``{"Tn": {"type": "y1997"}, "PR": {"type": "OBS"}}``.
    """
    def cell(variable: str, wanted: dict[str, str]):
        keep = F.col(var_col) == variable
        for column, chosen in wanted.items():
            keep = keep & (F.col(column) == chosen)
        return F.max(F.when(keep, F.col(value))).alias(variable)

    mixed = long.groupBy(*keys).agg(*[cell(v, w) for v, w in choice.items()])
    return mixed if label is None else mixed.withColumn("type", F.lit(label))


def fit_by_group(df: DataFrame, keys: Sequence[str], fn, schema) -> DataFrame:
    """Any function of a group's rows (pandas in, pandas out).

    The function sees the whole group, so collapse groups first; models that are
    functions of sums should use ``gram`` instead.
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)
