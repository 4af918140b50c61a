"""Cross-product tables: all linear models of a group are functions of one matrix.

For z = (1, features, y) a group, or a fold of it, is kept as number of rows, means and co-moments about the
means. Such partials merge, also weighted ones, without the loss that sums of squares of large numbers
suffer: two groups are put together from their distance, not from their distance to zero. A training set
is what the other folds merge to, so the raw rows are read once for any number of models, folds and penalties.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.keys import complete

HELD = 20_000  # partial groups a task holds before it merges them
CELLS = 1 << 22  # products of a batch computed at once


def gram(df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, weight: str | None = None) -> DataFrame:
    """keys, ``rows`` (count), ``c`` and ``m``.

    ``c`` is the packed upper triangle of the matrix of weight, means and co-moments (see ``solvers``), which all fits
    use; ``m`` is that of the weighted sums of z z'. Pass fold columns as further keys. Rows with a missing feature,
    response or weight do not count.
    """
    keys = list(keys)
    used = [*features, y] + ([weight] if weight else [])
    # one name per role, as a feature may also serve as key or weight
    rows = complete(df, used).select(
        *keys,
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"),
        *[F.col(c).cast("double").alias(f"__z{i}") for i, c in enumerate([*features, y], start=1)],
    )
    size = len(features) + 2
    schema = T.StructType(
        [f for f in rows.schema.fields if f.name in keys]
        + [T.StructField("rows", T.LongType()), T.StructField("c", T.ArrayType(T.DoubleType()))]
    )
    partial = rows.mapInArrow(lambda batches: _collapsed(batches, keys, size), schema)
    dealt = partial.repartition(*keys).sortWithinPartitions(*keys) if keys else partial.repartition(1)
    merged = dealt.mapInArrow(lambda batches: _merged(batches, keys, size), schema)
    known = F.col("c").alias("c", metadata={"size": size})
    return merged.select(*keys, "rows", known, raw_sums(F.col("c"), size).alias("m"))


def merge_all(table: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``c`` of all groups of a table of ``gram`` together."""
    size = _size_of(table)
    partial = table.select("rows", "c")
    few = partial.mapInArrow(lambda batches: _merged(batches, [], size), partial.schema)
    return few.repartition(1).mapInArrow(lambda batches: _merged(batches, [], size), partial.schema)


def _cells(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size)


def raw_sums(c: Column, size: int) -> Column:
    """The packed sums of z z' from weight, means and co-moments."""
    first, second = (F.array(*[F.lit(int(i)) for i in x]) for x in _cells(size))

    def cell(v: Column, k: Column) -> Column:
        i, j = F.get(first, k), F.get(second, k)
        return F.when(i > 0, v + c[0] * c[i] * c[j]).when(j > 0, c[0] * v).otherwise(v)

    return F.transform(c, cell)


def _codes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    codes = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        own = batch[k].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return codes


def _put_together(codes: np.ndarray, n: np.ndarray, mean: np.ndarray, moments: np.ndarray | None, size: int):
    """Merge partials of equal code: (a row of each group, packed weight, means and co-moments).

    ``moments`` are the co-moments of the partials, none if they are single rows.
    """
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
    n, mean = n[order], mean[order]
    add = lambda x: np.add.reduceat(x, starts, axis=0)
    total = add(n)
    some = total != 0
    safe = np.where(some, total, 1.0)[:, None]
    # a near mean first: what is left of the distances to it corrects mean and co-moments
    near = np.where(some[:, None], add(n[:, None] * mean) / safe, mean[starts])
    apart = mean - near[group]
    left = add(n[:, None] * apart)
    i, j = (x[size:] - 1 for x in _cells(size))
    out = np.empty((len(starts), size + len(i)))
    out[:, 0], out[:, 1:size] = total, near + left / safe
    step = max(1, CELLS // max(len(order), 1))
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        products = n[:, None] * apart[:, a] * apart[:, b]
        if moments is not None:
            products += moments[order, k : k + step]
        out[:, size + k : size + k + len(a)] = add(products) - left[:, a] * left[:, b] / safe
    return order[starts], out


def _as_batch(batch: pa.RecordBatch, keys: list[str], lead: np.ndarray, rows: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(0, packed.size + 1, packed.shape[1]), pa.int32())
    lists = pa.ListArray.from_arrays(ends, pa.array(packed.ravel(), pa.float64()))
    at = pa.array(lead)
    return pa.RecordBatch.from_arrays([*[batch[k].take(at) for k in keys], pa.array(rows, pa.int64()), lists], [*keys, "rows", "c"])


def _of_rows(batch: pa.RecordBatch, keys: list[str], size: int) -> pa.RecordBatch:
    codes = _codes(batch, keys)
    z = np.column_stack([batch[f"__z{i}"].to_numpy(zero_copy_only=False) for i in range(1, size)])
    lead, packed = _put_together(codes, batch["__w"].to_numpy(zero_copy_only=False), z, None, size)
    counts = np.bincount(np.unique(codes, return_inverse=True)[1])
    return _as_batch(batch, keys, lead, counts, packed)


def _of_partials(parts: list[pa.RecordBatch], keys: list[str], size: int) -> tuple[pa.RecordBatch, int]:
    """One partial per group, and at which place the group of the last row stands."""
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    codes = _codes(whole, keys)
    c = whole["c"].flatten().to_numpy(zero_copy_only=False).reshape(whole.num_rows, -1)
    lead, packed = _put_together(codes, c[:, 0], c[:, 1:size], c[:, size:], size)
    place = np.unique(codes, return_inverse=True)[1]
    rows = np.zeros(len(lead), np.int64)
    np.add.at(rows, place, whole["rows"].to_numpy(zero_copy_only=False))
    return _as_batch(whole, keys, lead, rows, packed), int(place[-1])


def _collapsed(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[pa.RecordBatch]:
    """One partial per group and task, as long as the groups of a task are not too many to hold."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(_of_rows(batch, keys, size))
        if sum(b.num_rows for b in held) > HELD:
            held = [_of_partials(held, keys, size)[0]]
            if held[0].num_rows > HELD // 2:
                yield held.pop()
    if held:
        yield _of_partials(held, keys, size)[0]


def _merged(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[pa.RecordBatch]:
    """One partial per group, from partials in the order of the keys; only the last group is kept for the next batch."""
    last = None
    for batch in batches:
        if batch.num_rows:
            whole, at = _of_partials([*([last] if last else []), batch], keys, size)
            last = whole.slice(at, 1)
            others = np.delete(np.arange(whole.num_rows), at)
            if len(others):
                yield whole.take(pa.array(others))
    if last is not None:
        yield last


def sum_matrices(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add matrices per key, entry by entry; the result per key has fixed size."""
    counts = "rows" in df.columns
    entries = df.select(*keys, *(["rows"] if counts else []), F.posexplode("m").alias("__i", "__v"))
    summed = entries.groupBy(*keys, "__i").agg(
        F.sum("__v").alias("__v"), *([F.sum("rows").alias("rows")] if counts else [])
    )
    packed = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda s: s["__v"])
    return summed.groupBy(*keys).agg(
        *([F.max("rows").alias("rows")] if counts else []), packed.alias("m")
    )


def _merge(a: Column, b: Column, size: int) -> Column:
    """Weight, means and co-moments of two disjoint sets of rows together."""
    first, second = (F.array(*[F.lit(int(i)) for i in x]) for x in _cells(size))
    n = a[0] + b[0]
    share = F.when(n != 0, b[0] / n).otherwise(0.0)

    def cell(v: Column, k: Column) -> Column:
        i, j, w = F.get(first, k), F.get(second, k), F.get(b, k)
        apart = (b[j] - a[j]) * (b[i] - a[i])
        return F.when(i > 0, v + w + a[0] * share * apart).when(j > 0, v + (w - v) * share).otherwise(n)

    return F.transform(a, cell)


def training_matrices(
    table: DataFrame, keys: Sequence[str], fold: str, labels: Sequence[str]
) -> DataFrame:
    """For each fold the sum over the other folds, per key.

    A key holds at most one row per label, so the arrays gathered here are small.
    Keys without rows outside a fold get no row for it.
    """
    keys = list(keys)
    size = _size_of(table)
    per_key = table.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(fold), F.struct("rows", "c")))).alias("__folds")
    )
    exploded = per_key.select(*keys, F.explode(F.array(*[F.lit(x) for x in labels])).alias(fold), "__folds")
    # merged from the other folds rather than taken out of the total: no cancellation
    others = F.map_values(F.map_filter("__folds", lambda k, v: k != F.col(fold)))
    merged = (
        exploded.withColumn("__others", others)
        .where(F.size("__others") > 0)
        .select(
            *keys,
            fold,
            F.aggregate("__others", F.lit(0).cast("bigint"), lambda a, v: a + v["rows"]).alias("rows"),
            F.aggregate(
                F.slice("__others", 2, len(labels)), F.element_at("__others", 1)["c"], lambda a, v: _merge(a, v["c"], size)
            ).alias("c"),
        )
    )
    return merged.withColumn("m", raw_sums(F.col("c"), size))


def _size_of(table: DataFrame) -> int:
    """Features, response and constant of a table of ``gram``."""
    return table.schema["c"].metadata["size"]
