"""Random forests grown level by level as aggregates, and design matrices."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.columns import one_hot
from furrow.functions.keys import complete, null_safe_join
from furrow.operators.aggregates import zscore
from furrow.session import written

_P = "__f_"
_BITS = 40  # of the range of y in one step, fewer where the sum of all rows would not fit a long


def _bagged(seed: int, tree: Column, row: Column) -> Column:
    """How often a tree draws a row: Poisson of mean 1, from a hash of seed, tree and the row's values."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), tree, row), 11) / F.lit(float(1 << 53))
    reached, steps = 0.0, []
    for k in range(16):
        reached += math.exp(-1) / math.factorial(k)
        steps.append(F.when(u >= reached, 1).otherwise(0))
    return sum(steps[1:], steps[0])


def _tried(n: int, mtry: int, seed: int, node: Sequence[str]) -> Column:
    """The features that a node tries: the ``mtry`` of least hash."""
    every = F.sequence(F.lit(0), F.lit(n - 1))
    if mtry >= n:
        return every
    drawn = F.transform(every, lambda f: F.struct(F.xxhash64(F.lit(seed), *[F.col(c) for c in node], f).alias("h"), f.alias("f")))
    return F.slice(F.array_sort(drawn), 1, mtry)["f"]


def _best_splits(state: DataFrame, node: Sequence[str], n: int, mtry: int, min_leaf: int, seed: int) -> DataFrame:
    """The border of each node that leaves the least squares, for the nodes that can be split.

    One histogram per node, feature and value, summed before the shuffle; sums are of whole numbers, so
    they do not depend on the order of the rows, and equal partitions tie exactly.
    """
    x = F.get(F.col(_P + "x"), F.col("f"))
    cells = (
        state.where(F.col(_P + "w") > 0)
        .select(*node, _P + "x", _P + "w", _P + "u", F.explode(_tried(n, mtry, seed, node)).alias("f"))
        .groupBy(*node, "f", x.alias("x"))
        .agg(
            F.sum(_P + "w").alias("n"),
            F.sum(F.col(_P + "w") * F.col(_P + "u")).alias("s"),
            F.min(_P + "u").alias("low"),
            F.max(_P + "u").alias("high"),
        )
    )
    whole = Window.partitionBy(*node, "f")
    upto = whole.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = cells.select(
        *node, "f", "x",
        F.lead("x").over(whole.orderBy("x")).alias("next"),
        F.sum("n").over(upto).alias("n1"), F.sum("s").over(upto).alias("s1"),
        F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"),
        F.min("low").over(whole).alias("low"), F.max("high").over(whole).alias("high"),
    )
    square = lambda s, k: s.cast("double") * s.cast("double") / k
    n2, s2 = F.col("n") - F.col("n1"), F.col("s") - F.col("s1")
    score = square(F.col("s1"), F.col("n1")) + square(s2, n2)
    usable = (F.col("next").isNotNull()) & (F.col("n1") >= min_leaf) & (n2 >= min_leaf) & (F.col("low") < F.col("high"))
    middle = (F.col("x") + F.col("next")) / 2
    border = F.when(middle < F.col("next"), middle).otherwise(F.col("x"))  # neighbours among the doubles have no middle
    split = F.struct(score.alias("score"), (-F.col("f")).alias("f"), (-F.col("x")).alias("x"), border.alias("border"), "n1", n2.alias("n2"))
    return runs.where(usable).groupBy(*node).agg(F.max(split).alias("b")).select(
        *node, (-F.col("b.f")).alias(_P + "f"), *[F.col(f"b.{c}").alias(_P + c) for c in ("border", "n1", "n2")]
    )


def _binned(rows: DataFrame, features: Sequence[str], fit: Column, bins: int) -> Column:
    """The features as the least of ``bins`` quantiles of the fitted rows that is not below; one bounded row of borders."""
    shares = [i / bins for i in range(1, bins)]
    borders = rows.where(fit).agg(*[F.percentile_approx(f, shares, 100 * bins).alias(f) for f in features]).first()
    cells = []
    for f in features:
        cuts = sorted(set(borders[f] or []))
        cells.append(F.size(F.filter(F.array(*[F.lit(float(b)) for b in cuts]), lambda b: b < F.col(f))).cast("double") if cuts else F.lit(0.0))
    return F.array(*cells)


def forest_predictions(
    rows: DataFrame, features: Sequence[str], y: str, fit: Column, keys: Sequence[str] = (),
    n_trees: int = 500, mtry: int = 10, min_leaf: int = 5, max_depth: int | None = None, bins: int | None = None,
    seed: int = 42, bootstrap: bool = True,
) -> DataFrame:
    """Rows that are not in ``fit``, with ``pred`` of a forest per group of ``keys`` grown on those that are.

    All groups, trees and nodes grow one level at a time: a level is one histogram keyed by group, tree, node, feature and
    value, and one join of the chosen borders back to the rows, so there is neither a job per group, fold or tree nor a task
    that holds one. Growth ends where no node has a border with ``min_leaf`` drawn rows on both sides, or at
    ``max_depth`` where one is given. Rows to be predicted walk along with the others. Every value is a possible
    border unless ``bins`` asks for quantiles, which bound the histograms of raw tables.

    Rows without all features are left out, and rows without ``y`` are not learned from. ``pred`` is null in a group without
    fitted rows. Draws are hashes of the row's values: equal rows are drawn alike, and reruns agree to the bit.
    """
    features, keys = list(features), list(keys)
    if n_trees < 1 or mtry < 1 or min_leaf < 1:
        raise ValueError("n_trees, mtry and min_leaf must be at least 1")
    known = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    usable = complete(rows, features).withColumn(_P + "fit", F.coalesce(fit & known, F.lit(False)))
    base = written(usable.withColumn(_P + "row", F.monotonically_increasing_id()), "forest-rows")
    learn = F.col(_P + "fit")
    low, high, n = base.where(learn).agg(F.min(y).cast("double"), F.max(y).cast("double"), F.count(F.lit(1))).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    steps = float(1 << min(_BITS, 58 - max(n, 1).bit_length()))  # a row may be drawn up to 16 times
    span = high - low
    u = F.round(((F.col(y) - low) / span - 0.5) * steps).cast("long") if span > 0 else F.lit(0).cast("long")
    x = _binned(base, features, learn, bins) if bins else F.array(*[F.col(f).cast("double") + F.lit(0.0) for f in features])
    named = [_P + f"k{i}" for i in range(len(keys))]
    node = [*named, _P + "tree", _P + "node"]
    slim = base.select(
        *[F.col(k).alias(a) for k, a in zip(keys, named)], _P + "row", _P + "fit", x.alias(_P + "x"), F.when(learn, u).alias(_P + "u")
    )
    trees = slim.withColumn(_P + "tree", F.explode(F.sequence(F.lit(1), F.lit(n_trees))))
    value = F.xxhash64(*[F.col(c) for c in (*named, _P + "x", _P + "u")])
    drawn = _bagged(seed, F.col(_P + "tree"), value) if bootstrap else F.lit(1)
    drawn = trees.withColumn(_P + "w", F.when(learn, drawn).otherwise(0).cast("long")).where((F.col(_P + "w") > 0) | ~learn)
    state = drawn.drop(_P + "fit").withColumns({_P + "node": F.lit(""), _P + "open": F.lit(True)})
    state, ended, depth = written(state, "forest-level"), [], 0
    slimmer = [*node, _P + "row", _P + "w", _P + "u"]
    while True:
        grows = state.where(F.col(_P + "open"))
        ended.append(state.where(~F.col(_P + "open")).select(*slimmer))
        if depth == max_depth or grows.where(F.col(_P + "w") > 0).isEmpty():
            ended.append(grows.select(*slimmer))
            break
        splits = written(_best_splits(grows, node, len(features), mtry, min_leaf, seed), "forest-splits")
        moved = null_safe_join(grows, splits, node, "left")
        left = F.get(F.col(_P + "x"), F.col(_P + "f")) <= F.col(_P + "border")
        side = F.when(F.col(_P + "f").isNull(), "").when(left, "l").otherwise("r")
        child = F.when(left, F.col(_P + "n1")).otherwise(F.col(_P + "n2"))
        large = F.col(_P + "f").isNotNull() & (child >= 2 * min_leaf)  # a smaller one has no border
        moved = moved.withColumns({_P + "node": F.concat(_P + "node", side), _P + "open": large})
        state = written(moved.select(*state.columns), "forest-level")
        depth += 1
    leaves = ended[0]
    for part in ended[1:]:
        leaves = leaves.unionByName(part)
    means = leaves.where(F.col(_P + "w") > 0).groupBy(*node).agg(
        (F.sum(F.col(_P + "w") * F.col(_P + "u")) / F.sum(_P + "w")).alias("mean")
    )
    asked = null_safe_join(leaves.where(F.col(_P + "w") == 0), means, node)
    # a fixed order of the trees, so that the sum is the same to the bit; as many entries as trees
    ordered = F.array_sort(F.collect_list(F.struct(F.col(_P + "tree").alias("t"), "mean")))
    total = F.aggregate(ordered, F.lit(0.0), lambda a, t: a + t["mean"])
    found = asked.groupBy(_P + "row").agg((total / F.count(F.lit(1))).alias("u"))
    pred = ((F.col("u") / steps + 0.5) * span + low).alias("pred") if span > 0 else F.when(F.col("u").isNotNull(), F.lit(low)).alias("pred")
    held = base.where(~learn).join(found, _P + "row", "left")
    return held.select(*[F.col(f"`{c}`") for c in rows.columns], pred)


def fit_forest(train: DataFrame, features: Sequence[str], y: str, group: str | None = None, **options):
    """A function that adds ``pred`` to rows by a forest per group grown on ``train``; it grows when called.

    Options are those of ``forest_predictions``.
    """
    needed = [*features, *([group] if group else [])]

    def score(rows: DataFrame) -> DataFrame:
        known = train.select(*needed, y).withColumn(_P + "train", F.lit(True))
        own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(_P + "own")
        both = rows.select(*needed, own, F.lit(False).alias(_P + "train")).unionByName(known, allowMissingColumns=True)
        scored = forest_predictions(both, features, y, F.col(_P + "train"), [group] if group else [], **options)
        return scored.select(_P + "own.*", "pred")

    return score


def cross_validate_forest(
    folded: DataFrame, features: Sequence[str], y: str, fold: str, labels: Sequence[str], group: str | None = None, **options
) -> DataFrame:
    """Predictions of each fold by forests grown on the others, one per fold and group; ``model`` is rf.

    All folds grow together. Options are those of ``forest_predictions``.
    """
    turn = _P + "turn"
    rounds = folded.withColumn(turn, F.explode(F.array(*[F.lit(x) for x in labels])))
    known = rounds.where(F.col(fold).isNotNull() & (F.col(fold).isin(list(labels))))
    keys = [turn, *([group] if group else [])]
    scored = forest_predictions(known, features, y, F.col(fold) != F.col(turn), keys, **options)
    return scored.where(F.col(fold) == F.col(turn)).drop(turn).withColumn("model", F.lit("rf"))


def design_matrix(
    df: DataFrame, features: Sequence[str], y: str, time: str = "year", one_hot_col: str | None = None,
    values: Sequence[str] = (),
) -> DataFrame:
    """Rows for an external learner: z-scored time, log response, one-hot group.

    Adds ``x`` (vector) and ``label``; rows without a usable response drop out.
    """
    rows = zscore(complete(df, [y, *features]).where(F.col(y) > 0), [time])
    inputs = [f"{time}_z", *features]
    if one_hot_col:
        rows = one_hot(rows, one_hot_col, values)
        inputs += [f"{one_hot_col}_{v}" for v in values]
    return VectorAssembler(inputCols=inputs, outputCol="x").transform(rows.withColumn("label", F.log(y)))
