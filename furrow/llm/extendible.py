"""Sharding by extendible hashing.

A document's hash is 60 bits of the MD5 of its id. A bucket is a prefix of the hash; all
documents start in the bucket of no bits, and a bucket of more bytes than the limit is
split on the next bit, only it and only until it fits. The leaves, with their depth, are
the directory: a lookup takes the first depth at which the prefix of a hash is a leaf.

The splits are not made one by one. Bytes are summed once per prefix at a depth a few
bits below that of an even split, the sums of all shorter prefixes follow from these, and
each prefix finds its first ancestor within the limit. Prefixes that are still too large go into
another round with more bits. The shuffles carry counters, never texts.

Native DataFrame functions only. Nulls: a null id hashes as an empty key, a null text has
no bytes. Rows of equal id stay together; a bucket of one hash that exceeds the limit
cannot be split and is marked ``oversized``, as is a single document above the limit. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import written

BITS = 60
SLACK = 4


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _leaves(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """The buckets between two depths for the rows of buckets that are too large at ``low``.

    One row per prefix at ``high``: ``cell``, the depth of its leaf (null where even the
    prefix itself is too large) and the leaf's rows and bytes.
    """
    cells = rows.groupBy(F.expr(f"shiftright(h, {BITS - high})").alias("cell")).agg(
        F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")
    )
    cells = written(cells, "shard-cells")
    above = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, {high} - depth)")
    )
    nodes = above.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = above.select("cell", "depth", "prefix").join(
        nodes.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)), ["depth", "prefix"]
    )
    first = fits.groupBy("cell").agg(
        F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("leaf")
    )
    return cells.select("cell").join(first, "cell", "left").select("cell", "leaf.*")


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes`` and its shard.

    The shard is named by ``shard_depth`` and ``shard_prefix``; ``shard_docs`` and
    ``shard_bytes`` are its contents, ``oversized`` tells of one that cannot be split.
    """
    if limit < 1:
        raise ValueError("the limit must be at least one byte")
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            key_hash(F.col(id_col)).alias("h"),
            F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK)
    done = None
    rest = rows
    while True:
        leaves = written(_leaves(rest, low, high, limit), "shard-leaves")
        placed = rest.withColumn("cell", F.expr(f"shiftright(h, {BITS - high})")).join(leaves, "cell").drop("cell")
        ready = placed.where("depth is not null")
        done = ready if done is None else done.unionByName(ready)
        if high == BITS or leaves.where("depth is null").isEmpty():
            break
        rest = written(placed.where("depth is null").select("id", "h", "n_bytes"), "shard-rest")
        low, high = high + 1, min(BITS, high + 2 * SLACK)
    return done.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.col("depth").alias("shard_depth"),
        F.col("prefix").alias("shard_prefix"),
        "shard_docs",
        "shard_bytes",
        (F.col("shard_bytes") > limit).alias("oversized"),
    )


def directory(assigned: DataFrame) -> DataFrame:
    """One row per shard, in the order of the hash range it covers."""
    return assigned.select("shard_depth", "shard_prefix", "shard_docs", "shard_bytes", "oversized").distinct()


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` with one folder per shard, ``shard=<depth>-<prefix>``.

    Rows of equal id share a shard, so the shard joins on the distinct ids.
    """
    name = F.concat_ws("-", F.col("shard_depth").cast("string"), F.col("shard_prefix").cast("string"))
    shards = assign_shards(docs, limit, id_col, text_col).select(F.col(id_col).alias("__id"), name.alias("shard")).distinct()
    placed = docs.join(shards, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


def shards_sql(limit: int) -> str:
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h,
    coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
s AS (
  SELECT doc_id, h, n_bytes, 0 AS depth, sum(n_bytes) OVER () AS bytes, count(*) OVER () AS docs FROM d
  UNION ALL
  SELECT doc_id, h, n_bytes, depth + 1, sum(n_bytes) OVER (PARTITION BY h >> ({BITS - 1} - depth)), count(*) OVER (PARTITION BY h >> ({BITS - 1} - depth))
  FROM s WHERE bytes > {limit} AND depth < {BITS})
SELECT doc_id, n_bytes, depth AS shard_depth, h >> ({BITS} - depth) AS shard_prefix, docs AS shard_docs,
  bytes::BIGINT AS shard_bytes, bytes > {limit} AS oversized
FROM s WHERE bytes <= {limit} OR depth = {BITS}"""
