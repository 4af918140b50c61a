"""Document fingerprints: bottom-k sketches of word shingles.

A shingle is five words in a row; a text of fewer words is one shingle, one without words has none. A sketch
is the sorted array of the ``k`` least distinct 64-bit hashes of a text's shingles, so equal texts have equal
sketches, and the sketch of a union is made from the sketches of its parts (``merged``, ``merge_sketches``). Two sketches
estimate resemblance and containment of their sets, and one the number of distinct shingles; all are exact
while the sets have at most ``k`` shingles.

``fingerprints`` compares each text with the next in descending order of id and with an edited text whose end is
replaced by the beginning of the next. Its neighbours are found without sorting the table in one task: slim rows of id and text hash
are dealt by range, the first of each range is a border, each text goes to its range, and the first text of a range
also goes to the range before. The texts move once.

Native DataFrame functions only. Nulls: a null text is empty; null ids are the last in order. Rows of one id are ordered
by a hash of the text, so ids may repeat; only rows equal in id and text share one place and one range. After the last
row comes the first; a single row is its own successor. Sets without shingles resemble each other fully and others not at
all. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.keys import attach
from furrow.llm.words import let, words_of
from furrow.session import written

K = 128
SHINGLE = 5
RANGE_BYTES = 64 << 20  # of text per range of ids
MAX_RANGES = 1 << 14  # borders are one array, taken from samples of the ranges; beyond 1 TB of text ranges get larger
FAN = 64
_P = "__sketch_"


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles of a text, with repeats."""
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        whole = F.aggregate(h, F.xxhash64(F.lit("few")), lambda a, x: F.xxhash64(a, x))
        at = F.sequence(F.lit(0), F.size(h) - size)
        each = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
        empty = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= size, each).when(F.size(h) > 0, F.array(whole)).otherwise(empty)

    return let(hashes, shingles)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The ``k`` least distinct shingle hashes of a text, sorted."""
    return _least(shingle_hashes(text, size), k)


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of the intersection over that of the union; 1 for two empty sets."""

    def shared(u: Column) -> Column:
        both = F.array_intersect(F.array_intersect(a, b), u)
        return F.when(F.size(u) == 0, 1.0).otherwise(F.size(both) / F.size(u))

    return let(merged(a, b, k), shared)


def _reach(a: Column, b: Column, k: int) -> Column:
    """The hash up to which both sketches know all of their sets."""
    last = lambda s: F.when(F.size(s) >= k, F.element_at(s, -1)).otherwise(F.lit(2**63 - 1))
    return F.least(last(a), last(b))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that lies in the second; 1 for an empty first set, null if nothing tells."""

    def inside(reach: Column) -> Column:
        own = F.size(F.filter(a, lambda x: x <= reach))
        both = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= reach))
        return F.when(F.size(a) == 0, 1.0).when(own > 0, both / own)

    return let(_reach(a, b, k), inside)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles of the set."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def merge_sketches(parts: DataFrame, keys: Sequence[str], col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group of rows, that of the union, and ``parts``, the rows of the group.

    Groups are merged ``FAN`` at a time in rounds, so that no task holds more than some
    sketches of a group, however many rows it has.
    """
    keys = list(keys)
    turn = _P + "turn"
    rows = parts.select(*keys, F.col(col), F.lit(1).cast("long").alias("parts"), F.xxhash64(F.monotonically_increasing_id()).alias(turn))
    empty = F.array().cast("array<bigint>")
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while True:
        places = -(-most // FAN) if most else 1
        # the salt shrinks from round to round; the last has one place per group
        salted = rows.withColumn(_P + "salt", F.pmod(F.col(turn), F.lit(max(1, places))))
        gathered = salted.groupBy(*keys, _P + "salt").agg(
            F.collect_list(F.coalesce(F.col(col), empty)).alias(_P + "all"), F.sum("parts").alias("parts")
        )
        rows = gathered.select(*keys, _least(F.flatten(_P + "all"), k).alias(col), "parts", F.xxhash64(_P + "salt").alias(turn))
        if places <= 1:
            return rows.drop(turn)
        rows, most = written(rows, "sketch-round"), places


def as_text(a: Column) -> Column:
    """The sketch as a string of 16 hex digits per hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _place(key: Column, borders: Column, most: int) -> Column:
    """How many of the sorted borders are at most ``key``, by halving."""
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(max(1, most).bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= F.size(borders)) & (F.get(borders, at + step - 1) <= key), at + step).otherwise(at),
    )


def _order_key(id_col: str, text: Column) -> Column:
    """Rises as ids fall; nulls come last."""
    return F.struct(
        F.col(id_col).isNull().alias("none"),
        F.coalesce(-1 - F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.xxhash64(text).alias("hash"),
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES, also=None) -> DataFrame:
    """``doc_id``, ``text`` and ``next``, the text of the next row in descending order of id.

    ``also`` maps names to functions of a text; each is computed once per text where it has arrived,
    and given for the row and, as ``next_<name>``, for the next one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("key", _order_key("doc_id", F.col("text")))
    size, least = keyed.agg(F.sum(F.octet_length("text")), F.min("key")).first()
    if least is None:
        also_empty = [F.lit(None).cast("array<bigint>").alias(n) for name in also or {} for n in (name, f"next_{name}")]
        return keyed.select("doc_id", "text", F.col("text").alias("next"), *also_empty)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MAX_RANGES, max(4 * tasks, -(-size // range_bytes)))
    slim = keyed.select("key").repartitionByRange(ranges, "key")
    borders = slim.groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("key"))
    # one row: the sorted least keys of all ranges but the first; the least of all is the first border
    row = written(borders.agg(F.array_sort(F.array_distinct(F.collect_list("key"))).alias("borders")), "sketch-borders")
    placed = attach(keyed, row, []).withColumn("range", let(F.col("borders"), lambda b: _place(F.col("key"), b, ranges)))
    # the first of each range is also a guest, the last in the range before it
    first = F.get("borders", F.col("range") - 1) == F.col("key")
    before = F.when(F.col("range") > 1, F.col("range") - 1).otherwise(F.size("borders"))
    both = F.when(
        first,
        F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")), F.struct(before.alias("range"), F.lit(True).alias("guest"))),
    ).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))))
    dealt = placed.select("doc_id", "text", "key", F.inline(both)).repartition(tasks, "range")
    ready = dealt.withColumns({name: fn(F.col("text")) for name, fn in (also or {}).items()})
    order = Window.partitionBy("range").orderBy("guest", "key")
    following = {f"next_{c}": F.lead(c).over(order) for c in ["text", *(also or {})]}
    return (
        ready.withColumns(following)
        .where(~F.col("guest"))
        .select("doc_id", "text", F.col("next_text").alias("next"), *[c for name in also or {} for c in (name, f"next_{name}")])
    )


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the following text."""

    def edit(n: Column) -> Column:
        half = F.floor(n / 2).cast("int")
        return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))

    return let(F.length(text), edit)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per text: length, fingerprint, that of its edited text, and how alike it is to that and to the next text."""
    pairs = with_next(docs, id_col, text_col, also={"own": lambda t: sketch(t, k)})
    pairs = pairs.withColumn("edited", edited_text(F.col("text"), F.col("next")))

    def measured(edited: Column) -> Column:
        own, after = F.col("own"), F.col("next_own")
        return let(
            sketch(edited, k),
            lambda e: F.struct(
                F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
                as_text(own).alias("fingerprint"),
                as_text(e).alias("edited_fingerprint"),
                resemblance(own, e, k).alias("near_edited"),
                resemblance(own, after, k).alias("near_next"),
                containment(own, e, k).alias("inside_edited"),
                distinct_shingles(own, k).alias("distinct_shingles"),
            ),
        )

    found = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.inline(F.array(let(F.col("edited"), measured))))
    return found.withColumnRenamed("doc_id", id_col)
