"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. Its documents first get the whole copies
that the target covers for all of them; what remains is a sample without replacement.
A document with inclusion probability p and a random number u gets the rank
(u / (1 - u)) / (p / (1 - p)), and the documents of lowest rank are taken until their
words reach the rest of the target, so that the size of the sample is fixed and longer
documents may be likelier than short ones.

No source is ever sorted as a whole. Words are summed over 1,024 slices of the rank,
then over 1,024 parts of the one slice in which the target is reached; only the rows of
that part, a millionth of the source, are put in order.

Native DataFrame functions only. Nulls: a null text has no words and is never taken; a
null source is a source of its own, the last one; a null ``doc_id`` counts as an empty one. The random
number of a row comes from its id and its text, so rows of one id that differ in text are drawn
each by itself. Rows equal in both share their rank: they count as one group of so many words, and if the target falls
within it, as many of them as it needs are taken, in the order in which they were written.
An empty table gives an empty result. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.words import unit_hash, unit_hash_sql, word_count
from furrow.session import written

SLICES = 1024
EDGE = 1e-6
_P = "__mix_"
KEY, ROW = _P + "key", _P + "row"
LAST_ROW = 2**63 - 1


def source_targets(
    sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3
) -> DataFrame:
    """One row per source: words, documents and the target number of words.

    ``sized`` has ``source`` and ``size``. Sources in code point order, null last, take the
    weights in turn. Targets share all words by weight; a target stops at ``most`` times
    its source's words and the excess goes to the others by weight, until none is above.
    Sources in order of words per weight stop one after the other, so the shares follow
    from running sums over the table of sources.
    """
    per = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs")
    )
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn(
        "weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights))
    )
    fills = [(most * F.col("source_size")) / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*fills).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(
        F.sum(most * F.col("source_size")).over(before), F.lit(0)
    )
    shares = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0.0)
    )
    place = F.row_number().over(Window.orderBy(*fills))
    # sources stop in this order, so the first that does not stop sets the level of all that follow
    level = weighed.withColumns({"level": left / shares, "place": place})
    stops = most * F.col("source_size") <= F.col("level") * F.col("weight")
    first = F.min(F.when(~stops, F.struct("place", "level"))).over(everything)
    cap = (most * F.col("source_size")).cast("double")
    return level.withColumn("first", first).select(
        "source",
        "source_size",
        "source_docs",
        F.when(F.col("place") >= F.col("first.place"), F.col("first.level") * F.col("weight"))
        .otherwise(cap)
        .alias("target"),
    )


def _rank(size: Column, mean: Column, rest: Column, key: Column, salt: str) -> Column:
    """The Pareto rank, brought from (0, inf) into (0, 1) by a rising function."""
    relative = 2.0 * size / (size + mean)
    p = F.least(F.greatest(rest * relative, F.lit(EDGE)), F.lit(1 - EDGE))
    u = unit_hash(key, salt)
    odds = (u / (1.0 - u)) / (p / (1.0 - p))
    return odds / (1.0 + odds)


def _same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    named = right.withColumnRenamed("source", _P + "source")
    return left.join(named, F.col("source").eqNullSafe(F.col(_P + "source")), how).drop(_P + "source")


def _reach(rows: DataFrame, part: str, need: str, carry: list[str]) -> DataFrame:
    """Per source the first part, in order, in which the running sum of words reaches ``need``."""
    sums = rows.groupBy("source", part).agg(
        F.sum("size").alias("words"), *[F.first(c).alias(c) for c in [need, *carry]]
    )
    running = Window.partitionBy("source").orderBy(part)
    reached = F.sum("words").over(running)
    return (
        sums.withColumn("reached", reached)
        .where((F.col("reached") >= F.col(need)) & (F.col("reached") - F.col("words") < F.col(need)))
        .select("source", part, *carry, (F.col(need) - F.col("reached") + F.col("words")).alias("need"))
    )


def _last_group(in_part: DataFrame) -> DataFrame:
    """Per source the last group of equal rows that is taken: its rank, key and how many of its rows, if not all.

    A row is taken while its middle word lies within the need, so the last one may go beyond it by half its size.
    """
    groups = in_part.groupBy("source", "rank", "tie", "size").agg(F.count(F.lit(1)).alias("rows"), F.first("need").alias("need"))
    order = Window.partitionBy("source").orderBy("rank", "tie")
    before = F.sum(F.col("rows") * F.col("size")).over(order) - F.col("rows") * F.col("size")
    fit = F.floor((2 * (F.col("need") - F.col("before")) + F.col("size")) / (2 * F.col("size")))
    taken = groups.withColumn("before", before).withColumn("many", F.least(fit, F.col("rows"))).where("many > 0")
    last = taken.groupBy("source").agg(F.max(F.struct("rank", "tie", "many", "rows")).alias("x"))
    return last.select("source", "x.rank", "x.tie", F.when(F.expr("x.many < x.rows"), F.col("x.many")).alias("many"))


def _last_row(ranked: DataFrame, last: DataFrame) -> DataFrame:
    """Per source whose last group is taken in part: the number of the last of its rows that is taken.

    The rows of a group are counted per task that wrote them; only those of the task that holds the last one are put in order.
    """
    cut = last.where("many is not null").select("source", "tie", "many").withColumnRenamed("tie", _P + "tie")
    rows = _same_source(ranked.select("source", "tie", ROW), cut).where(F.col("tie") == F.col(_P + "tie"))
    rows = rows.withColumn("task", F.shiftright(ROW, 33))
    counts = rows.groupBy("source", "task").agg(F.count(F.lit(1)).alias("rows"), F.first("many").alias("many"))
    running = F.sum("rows").over(Window.partitionBy("source").orderBy("task"))
    here = counts.withColumn("reached", running).where("reached >= many and reached - rows < many")
    here = here.select("source", F.col("task").alias(_P + "task"), (F.col("many") - F.col("reached") + F.col("rows")).alias("nth"))
    own = _same_source(rows.select("source", "task", ROW), here).where(F.col("task") == F.col(_P + "task"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy(ROW))
    return own.withColumn("k", nth).where("k = nth").select("source", F.col(ROW).alias("row"))


def mix_plan(
    sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, salt: str = "mix"
) -> DataFrame:
    """One row per source: targets, whole copies and the rank up to which one more is taken.

    ``sized`` has ``source``, ``size`` and the columns of ``_identity``; it is read several times and must be a written
    table, since its numbers of rows may not change.
    """
    targets = written(source_targets(sized, weights, most), "mix-targets")
    copies = F.col("target") / F.col("source_size")
    sources = targets.withColumns(
        {
            "whole": F.when(F.col("source_size") > 0, F.floor(copies)).otherwise(0).cast("int"),
            "rest": F.when(F.col("source_size") > 0, copies - F.floor(copies)).otherwise(0.0),
            "mean": F.col("source_size") / F.col("source_docs"),
        }
    ).withColumn("need", F.col("rest") * F.col("source_size"))
    ranked = (
        _same_source(sized, sources.where("need > 0").drop("source_docs", "source_size", "target", "whole"))
        .where("size > 0")
        .withColumn("rank", _rank(F.col("size"), F.col("mean"), F.col("rest"), F.col(KEY), salt))
        .withColumn("slice", F.floor(F.col("rank") * SLICES))
        .withColumn("part", F.floor(F.col("rank") * SLICES * SLICES))
        .withColumnRenamed(KEY, "tie")
        .select("source", "size", "need", "rank", "slice", "part", "tie", ROW)
    )
    slices = written(_reach(ranked, "slice", "need", []), "mix-slices")
    in_slice = _same_source(ranked.drop("need"), slices.withColumnRenamed("slice", _P + "slice")).where(
        F.col("slice") == F.col(_P + "slice")
    )
    parts = written(_reach(in_slice, "part", "need", []), "mix-parts")
    in_part = _same_source(ranked.drop("need"), parts.withColumnRenamed("part", "cut")).where("part = cut")
    last = written(_last_group(in_part), "mix-last")
    upto = F.struct("rank", "tie", F.coalesce(F.col("row"), F.lit(LAST_ROW)).alias("row")).alias("upto")
    last = _same_source(last, _last_row(ranked, last), "left").select("source", upto)
    plan = _same_source(_same_source(sources, parts.select("source", "part").withColumnRenamed("part", "cut"), "left"), last, "left")
    return written(
        plan.select("source", "source_size", "target", "whole", "rest", "mean", "cut", "upto"), "mix-plan"
    )


def with_copies(
    docs: DataFrame, plan: DataFrame, size: Column, out: str = "copies", salt: str = "mix", keep: Sequence[str] = ()
) -> DataFrame:
    """``docs`` with the number of copies of each row; joins the table of sources only.

    ``docs`` has the columns of ``_identity``, as in the table that the plan was made from.
    """
    renamed = plan.withColumnsRenamed({c: _P + c for c in plan.columns})
    p = lambda c: F.col(_P + c)
    joined = (
        docs.join(renamed, F.col("source").eqNullSafe(p("source")))
        .withColumn(_P + "size", size)
        .withColumn(_P + "rank", _rank(p("size"), p("mean"), p("rest"), F.col(KEY), salt))
    )
    part = F.floor(p("rank") * SLICES * SLICES)
    sampled = (p("size") > 0) & (
        (part < p("cut"))
        | ((part == p("cut")) & (F.struct(p("rank").alias("rank"), F.col(KEY).alias("tie"), F.col(ROW).alias("row")) <= p("upto")))
    )
    copies = F.when(p("size") > 0, p("whole") + F.when(sampled, 1).otherwise(0)).otherwise(0)
    return joined.withColumn(out, copies.cast("int")).select(
        *[F.col(f"`{c}`") for c in docs.columns], out, *[p(c).alias(c) for c in keep]
    )


def _identity() -> dict[str, Column]:
    """What tells rows apart: a key of id and text, and a number for each row that holds once it is written."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    return {KEY: key, ROW: F.monotonically_increasing_id()}


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words and the row's identity, written once: the text is read a single time."""
    size = word_count(F.col("text")).alias("size")
    return written(docs.select("doc_id", "source", size, *[c.alias(k) for k, c in _identity().items()]), "mix-sizes")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, salt: str = "mix") -> DataFrame:
    """The mixture itself: each document as many times as it is taken, with the columns of ``docs``.

    Sizes are written beside the texts: the words of a text are counted once, whatever is derived from the count.
    """
    own, size, n = [F.col(f"`{c}`") for c in docs.columns], _P + "words", _P + "copies"
    counted = written(docs.withColumns({size: word_count(F.col("text")), **_identity()}), "mix-documents")
    plan = mix_plan(counted.select("source", F.col(size).alias("size"), KEY, ROW), weights, most, salt)
    copies = with_copies(counted, plan, F.col(size), n, salt).where(F.col(n) > 0)
    return copies.withColumn(_P + "copy", F.explode(F.sequence(F.lit(1), F.col(n)))).select(*own)


def mix_report(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, salt: str = "mix") -> DataFrame:
    """Per document: its size, its source's size and target, and the words taken of it."""
    sized = sizes(docs)
    plan = mix_plan(sized, weights, most, salt)
    return with_copies(sized, plan, F.col("size"), salt=salt, keep=["source_size", "target"]).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def _mix_sql(weights: Sequence[float] = (5, 2, 1), most: int = 3, salt: str = "mix") -> str:
    turns = " ".join(f"WHEN {i} THEN {float(w)}::DOUBLE" for i, w in enumerate(weights))
    steps = 200  # rounds of resharing; each round stops at least one more source
    return f"""
WITH RECURSIVE sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(weights)} {turns} END AS weight FROM per),
o AS (SELECT *, row_number() OVER (ORDER BY {most} * source_size / weight, encode(source) NULLS LAST) AS k,
  (sum(source_size) OVER ())::BIGINT AS total, sum(weight) OVER () AS weights FROM w),
fill AS (
  SELECT 0::BIGINT AS stopped, min(total) AS words, min(weights) AS shares, 0 AS step FROM o
  UNION ALL
  SELECT f.stopped + 1, f.words - {most} * o.source_size, f.shares - o.weight, f.step + 1
  FROM fill f JOIN o ON o.k = f.stopped + 1 WHERE {most} * o.source_size <= f.words / f.shares * o.weight AND f.step < {steps}),
level AS (SELECT words / shares AS level, stopped FROM fill ORDER BY stopped DESC LIMIT 1),
t AS (SELECT o.*, CASE WHEN k <= stopped THEN ({most} * source_size)::DOUBLE ELSE level * weight END AS target FROM o, level),
r AS (SELECT s.doc_id, s.size, t.source, t.source_size, t.target, floor(target / nullif(source_size, 0)) AS whole,
  target / nullif(source_size, 0) - floor(target / nullif(source_size, 0)) AS rest, source_size / n AS mean,
  {unit_hash_sql("key", salt)} AS u, key AS tie
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, least(greatest(rest * (2.0::DOUBLE * size / (size + mean)), {EDGE}::DOUBLE), {1 - EDGE}::DOUBLE) AS p FROM r),
q AS (SELECT *, (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) AS odds FROM p),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1.0::DOUBLE + odds), tie ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM q)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size > 0 THEN size * (whole + CASE WHEN rest * source_size > 0 AND middle <= rest * source_size THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken
FROM c"""


MIX_SQL = _mix_sql()
