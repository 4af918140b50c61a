"""Substring deduplication by content-defined chunks.

A gear hash runs over the bytes of a text: each byte shifts it by one bit and adds a random
number, so its value depends on the last 32 bytes alone. A chunk ends where its upper bits are zero, at
least ``LEAST`` and at most ``MOST`` bytes after its start. As the ends follow the content, an insertion
moves the chunks around it only, and a passage yields the same chunks in whatever text it stands.

Chunks are joined by digest. One found in more than one document is repeated; its first holder, the
least id and place, keeps it. Neighbouring repeated chunks make a span as long as all of them or none of them have an
earlier holder, so what can be removed is never joined to what this document keeps. A span counts from ``SPAN`` bytes,
so that a short phrase that two texts happen to share does not.

Counts are summed before the shuffle and joined back, so a chunk in a third of all documents is one
row of counts, and its rows are split by the join. Chunks of one document are put in order, never
those of one digest.

Null and empty texts have no chunks. A chunk that recurs in its own document only is not repeated. Rows of one id are
one holder, and null ids one before all others, so such rows take nothing from each other; rows that differ in text have
spans of their own, and each is cut by its own only. An empty table gives an empty
result. Other columns are kept by ``without_repeats`` and not looked at otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.shingles import text_slices
from furrow.session import written

LEAST, MOST = 24, 256
MASK_BITS = 5  # a cut every 32 bytes past the least length
SPAN = 80
GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 2**32, 256, dtype=np.uint32)
NO_ID = -(2**63)
TEXT_KEY = "__text_key"  # tells rows of one id apart


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the bytes it covers."""
    h = GEAR[data]
    width = 1
    while width < 32:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; the last is its length. A text's hash starts anew."""
    n = len(data)
    if not n:
        return []
    cuts = (np.flatnonzero(gear_hashes(data) >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist()
    ends, start, k = [], 0, 0
    while start < n:
        while k < len(cuts) and cuts[k] < start + LEAST:
            k += 1
        end = min(n, start + MOST, cuts[k] if k < len(cuts) else n)
        ends.append(end)
        start = end
    return ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        for first, data, offsets in text_slices(batch.column(1)):
            raw = data.tobytes()
            doc, key, at, size, digest = [], [], [], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                start = 0
                for end in chunk_ends(data[a:b]):
                    doc.append(ids[first + k])
                    key.append(keys[first + k])
                    at.append(start)
                    size.append(end - start)
                    digest.append(xxhash.xxh3_128_digest(raw[a + start : a + end]))
                    start = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(digest, pa.binary())],
                ["id", TEXT_KEY, "at", "size", "digest"],
            )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per span of repeated chunks of a document.

    ``doc_id``, ``start`` and ``n_bytes`` (UTF-8 bytes of its text), ``n_chunks``, ``first_doc_id`` (the least id that holds
    the first chunk of the span) and ``removed_bytes``, the bytes of which an earlier holder exists.
    """
    return _spans(docs).drop(TEXT_KEY)


def _spans(docs: DataFrame) -> DataFrame:
    """The result of ``repeated_spans`` with the key of the text."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias(TEXT_KEY))
    chunks = written(texts.mapInArrow(_chunks, f"id long, {TEXT_KEY} long, at int, size int, digest binary"), "chunks")
    holders = chunks.groupBy("digest").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    repeated = chunks.join(holders.where("first_id < last_id").select("digest", "first_id"), "digest")
    order = Window.partitionBy("id", TEXT_KEY).orderBy("at")
    held = F.col("first_id") < F.col("id")
    goes_on = (F.col("at") == F.lag(F.col("at") + F.col("size")).over(order)) & (held == F.lag(held).over(order))
    new = F.when(goes_on, 0).otherwise(1)
    spans = (
        repeated.dropDuplicates(["id", TEXT_KEY, "at", "digest"])
        .withColumn("new", new)
        .withColumn("span", F.sum("new").over(order))
        .groupBy("id", TEXT_KEY, "span")
        .agg(
            F.min("at").alias("start"),
            F.sum("size").alias("n_bytes"),
            F.count(F.lit(1)).alias("n_chunks"),
            F.min(F.struct("at", "first_id"))["first_id"].alias("first"),
            F.sum(F.when(held, F.col("size")).otherwise(0)).alias("removed_bytes"),
        )
    )
    hidden = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return spans.where(F.col("n_bytes") >= SPAN).select(
        hidden("id").alias("doc_id"), F.col("start").cast("long").alias("start"), "n_bytes", "n_chunks", hidden("first").alias("first_doc_id"), "removed_bytes", TEXT_KEY
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with each span that lies in an earlier document cut out of the text.

    Spans are cut where they begin and end between code points, inwards.
    """
    cuts = _spans(docs).where(F.col("removed_bytes") == F.col("n_bytes"))
    spans = F.sort_array(F.collect_list(F.struct("start", "n_bytes"))).alias("__cuts")
    lists = written(cuts.groupBy(F.col("doc_id").alias("__id"), F.col(TEXT_KEY).alias("__text")).agg(spans), "chunk-cuts")
    joined = docs.join(lists, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__text")), "left")

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, mine in zip(texts, spans):
            if text is None or mine is None:
                out.append(text)
                continue
            data, kept, upto = text.encode(), [], 0
            for s in mine:
                kept.append(data[upto : s["start"]])
                upto = s["start"] + s["n_bytes"]
            out.append(b"".join([*kept, data[upto:]]).decode(errors="ignore"))
        return pd.Series(out, dtype=object)

    cut_texts = F.pandas_udf(cut, "string")
    return joined.withColumn("text", F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(cut_texts("text", "__cuts"))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
