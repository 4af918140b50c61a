"""Exact self-join of documents on the Jaccard similarity of their word shingles.

Documents of equal shingle sets are one class. Classes are linked where the similarity
reaches the threshold, and the result names the connected components.

* Candidates. Shingles have one order; two sets that reach the threshold share a shingle
  within the first ``n - ceil(t n) + 1`` of each. Shingles seen in several documents
  of a small sample come last in that order, which keeps passages that many documents
  share out of the prefixes. The order never changes the result.
* Tiles. The classes that share a prefix shingle form a tile. A tile of many classes is cut
  into bands of similar size (a band meets itself and the next) and these into blocks, so
  that each pair of classes meets and no task holds more than two blocks.
* Bounds. Each set has a bitmap in which its shingles toggle one bit. The differing bits of
  two bitmaps are at most the shingles by which the sets differ, so their count bounds the
  overlap from above. Size and position of the shared shingle bound it, too.
* Exact check. What passes is decided by the intersection of the sorted sets, made
  from the texts of just these documents.

Components need fewer pairs than there are links. Two rounds check a spanning forest of the
pairs that look linked, the first on one shingle a class; the last round checks every remaining
pair of different components that passes the bounds, so that no link is lost. In it,
the inside of a component, however many copies it has, costs nothing.

Nulls and empty texts have no shingles and link with nothing. Rows are told apart by their place, not by ``doc_id``:
where an id is null or repeated, each of its rows gets a key of its own, so that rows of one id link only
by their texts. A null id comes after all others: a component is named by null only if none of its rows has an id. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.shingles import shingle_sets, text_slices
from furrow.session import removed, written

TILE = 1024  # classes in a block
SAMPLE = 4000  # documents whose shingles set the order
SAMPLE_SEEN = 8  # a shingle of so many of them is put last
SAMPLE_KEPT = 1 << 16
BROADCAST_IDS = 1_000_000  # rows of ids sent to every task, some 40 MB
KEY = "__near_key"
SET_SCHEMA = "id long, n long, digest binary, prefix array<long>, bits binary"


def _width(n: int) -> int:
    """Bits of a bitmap: a power of two, at least the size of the set."""
    return max(64, 1 << max(0, int(n) - 1).bit_length())


def _bitmap(shingles: np.ndarray) -> bytes:
    width = _width(len(shingles))
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _summaries(percent: int, size: int, last: np.ndarray):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in text_slices(batch.column(1)):
                n, digests, bits, prefixes, lengths = [], [], [], [], [0]
                for s in shingle_sets(data, offsets, size):
                    n.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    if len(last) and len(s):
                        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        ordered = np.concatenate([s[~late], s[late]])
                    else:
                        ordered = s
                    prefix = ordered[: len(s) - (percent * len(s) + 99) // 100 + 1] if len(s) else s
                    prefixes.append(prefix)
                    lengths.append(lengths[-1] + len(prefix))
                    bits.append(_bitmap(s))
                flat = _signed(np.concatenate(prefixes)) if prefixes else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64())),
                        pa.array(bits, pa.binary()),
                    ],
                    ["id", "n", "digest", "prefix", "bits"],
                )

    return summarise


def _full_sets(size: int, flat: bool):
    """Rows of id and its whole set, as bytes, or one row for each shingle."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in text_slices(batch.column(1)):
                found = list(shingle_sets(data, offsets, size))
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(found)), pa.int64())], ["shingle"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, len(found)), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "shingles"]
                    )

    return sets


def frequent_shingles(texts: DataFrame, size: int = 5) -> np.ndarray:
    """Shingles of several documents of a bounded sample, by hash of the id; sorted."""
    total = texts.count()
    every = max(1, total // SAMPLE)
    picked = texts.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(2 * SAMPLE)
    shingles = picked.mapInArrow(_full_sets(size, flat=True), "shingle long")
    rows = (
        shingles.groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("seen"))
        .where(F.col("seen") >= SAMPLE_SEEN)
        .orderBy(F.desc("seen"), "shingle")
        .limit(SAMPLE_KEPT)
        .toPandas()
    )
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


class _Rows:
    """The rows of some tiles, with bitmaps as matrices by width."""

    def __init__(self, table: pa.Table) -> None:
        get = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
        self.id, self.comp, self.n, self.pos, self.block, self.band = (get(c) for c in ("id", "comp", "n", "pos", "block", "band"))
        tile = np.stack([get(c) for c in ("token", "t", "i", "j")], axis=1)
        self.t, self.i, self.j = tile[:, 1], tile[:, 2], tile[:, 3]
        new = np.r_[True, (tile[1:] != tile[:-1]).any(axis=1)]
        self.tile = np.cumsum(new) - 1
        self.starts = np.r_[np.flatnonzero(new), len(new)]
        maps = table["bits"].combine_chunks().cast(pa.large_binary())
        at = np.frombuffer(maps.buffers()[1], np.int64)[maps.offset : maps.offset + len(maps) + 1]
        data = np.frombuffer(maps.buffers()[2], np.uint8)
        self.width = np.diff(at) // 8
        self.place = np.zeros(len(maps), np.int64)
        self.maps = {}
        for w in np.unique(self.width):
            mine = np.flatnonzero(self.width == w)
            self.place[mine] = np.arange(len(mine))
            index = at[mine][:, None] + np.arange(8 * w)
            self.maps[int(w)] = np.ascontiguousarray(data[index]).view(np.uint64).reshape(len(mine), w)
        self.folded = {}

    def at_width(self, rows: np.ndarray, w: int) -> np.ndarray:
        """Bitmaps of rows that are ``w`` words wide or twice that; the wider ones are folded."""
        out = np.empty((len(rows), w), np.uint64)
        same = self.width[rows] == w
        out[same] = self.maps[w][self.place[rows[same]]] if same.any() else 0
        if not same.all():
            if w not in self.folded:
                m = self.maps[2 * w]
                self.folded[w] = m[:, :w] ^ m[:, w:]
            out[~same] = self.folded[w][self.place[rows[~same]]]
        return out

    def bounded(self, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that no bound rules out, with the bound on their overlap over the sizes."""
        na, nb = self.n[a], self.n[b]
        need = -(-percent * (na + nb) // (100 + percent))  # least overlap of a link
        left = np.minimum(na - self.pos[a], nb - self.pos[b])  # this shingle and what follows
        ok = (
            (self.comp[a] != self.comp[b])
            & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            & (left >= need)
            & ((self.i[a] == self.j[a]) | (self.block[a] != self.block[b]))
            & ((self.t[a] < 0) | (self.band[a] == self.t[a]) | (self.band[b] == self.t[b]))
        )
        a, b, need = a[ok], b[ok], need[ok]
        widths = np.minimum(self.width[a], self.width[b])
        most = np.zeros(len(a), np.int64)
        for w in np.unique(widths):
            mine = np.flatnonzero(widths == w)
            step = max(1, (1 << 20) // int(w))
            for k in range(0, len(mine), step):
                part = mine[k : k + step]
                differ = _popcount(self.at_width(a[part], int(w)) ^ self.at_width(b[part], int(w)))
                most[part] = (self.n[a[part]] + self.n[b[part]] - differ) // 2
        ok = most >= need
        a, b = a[ok], b[ok]
        return a, b, most[ok] / (self.n[a] + self.n[b])

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sizes = np.diff(self.starts)
        small = sizes[self.tile] <= 48
        rows = np.flatnonzero(small)
        for d in range(1, int(sizes[sizes <= 48].max(initial=1))):
            near = rows[:-d][self.tile[rows[:-d]] == self.tile[rows[d:]]]
            if len(near):
                yield self.bounded(near, near + d, percent)
        for k in np.flatnonzero(sizes > 48):
            first, m = self.starts[k], sizes[k]
            step = max(1, (1 << 19) // int(m))
            for r in range(0, m, step):
                a, b = np.nonzero(np.arange(r, min(m, r + step))[:, None] < np.arange(m)[None, :])
                yield self.bounded(first + r + a, first + b, percent)


def _forest(u: np.ndarray, v: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Indexes of a spanning forest of best edges, grown from all nodes at once."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    label, chosen = np.arange(len(nodes)), []
    order = np.argsort(-score, kind="stable")
    while True:
        order = order[label[u[order]] != label[v[order]]]
        if not len(order):
            return np.unique(np.concatenate(chosen)) if chosen else np.empty(0, np.int64)
        both = np.stack([label[u[order]], label[v[order]]], axis=1).ravel()
        best = order[np.unique(both, return_index=True)[1] // 2]
        best = np.unique(best)
        chosen.append(best)
        while True:  # labels meet at the least one along the chosen edges
            low = np.minimum(label[u[best]], label[v[best]])
            after = label.copy()
            np.minimum.at(after, label[u[best]], low)
            np.minimum.at(after, label[v[best]], low)
            after = after[after[label]]
            if (after == label).all():
                break
            label = after


def _tile_pairs(percent: int, every: bool, most: int = 30_000):
    """Pairs of sorted tile rows that pass the bounds: all, or a spanning forest of them."""

    def found(table: pa.Table) -> pa.RecordBatch:
        rows = _Rows(table)
        parts = [x for x in rows.pairs(percent) if len(x[0])]
        a, b, score = (np.concatenate([x[k] for x in parts]) if parts else np.empty(0, np.int64) for k in range(3))
        if not every and len(a):
            kept = _forest(rows.comp[a], rows.comp[b], score)
            a, b = a[kept], b[kept]
        low, high = np.minimum(rows.id[a], rows.id[b]), np.maximum(rows.id[a], rows.id[b])
        both = np.unique(np.stack([low, high], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], ["a", "b"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < most and sum(x.nbytes for x in held) < 1 << 23:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table[c].to_numpy() for c in ("token", "t", "i", "j")]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last tile may go on
            if cut:
                yield found(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks())

    return tiles


def _in_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of shared shingles, dealt to the tiles in which they meet.

    ``rows`` has token, id, comp, n and pos. Tokens all of whose rows are in one component are dropped.
    """
    groups = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("many"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    met = rows.join(groups.where("low <> high").select("token", "many"), "token")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) - 1e-9).cast("long")
    met = met.withColumn("band", band)
    none = F.lit(0).cast("long")
    small = met.where(F.col("many") <= TILE).withColumns(
        {"t": F.lit(-1).cast("long"), "i": none, "j": none, "block": none}
    )
    # bands of a ratio of the threshold: sizes that can link lie in one band or in two that follow
    # each other, which the rounding of the logarithm leaves room for
    large = met.where(F.col("many") > TILE).withColumn("t", F.explode(F.array(F.col("band"), F.greatest(F.col("band") - 1, none))))
    large = large.distinct()
    counts = large.groupBy("token", "t").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).alias("blocks"))
    blocked = large.join(counts, ["token", "t"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(none, F.col("blocks") - 1))
    dealt = blocked.withColumn("other", other).withColumns(
        {"i": F.least("block", "other"), "j": F.greatest("block", "other")}
    )
    names = ["token", "t", "i", "j", "id", "comp", "n", "pos", "block", "band"]
    return small.select(*names).unionByName(dealt.select(*names))


def _candidates(rows: DataFrame, bits: DataFrame, percent: int, every: bool) -> DataFrame:
    """Distinct pairs (a < b) of classes in different components that pass all bounds."""
    tiled = _in_tiles(rows, percent).join(bits, "id")
    keys = ["token", "t", "i", "j"]
    sorted_rows = tiled.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_rows.mapInArrow(_tile_pairs(percent, every), "a long, b long").distinct()


def _intersections(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, r = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(s, r, assume_unique=True))
                keep.append(100 * common >= percent * (len(s) + len(r) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def _linked(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Those of the pairs that reach the threshold, from the sets themselves."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    few = ids.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    sets = written(wanted.mapInArrow(_full_sets(size, flat=False), "id long, shingles binary"), "near-sets")
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_intersections(percent), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of an edge (a, b): the least id that its edges reach.

    Each round takes the least label among the neighbours and then follows labels to their
    own, so that distances shrink by half.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "near-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "near-labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("near"))
        low = labels.join(near, labels.id == near.a).select("id", F.least("comp", "near").alias("low"), "comp")
        low = written(low, "near-low")
        over = low.select(F.col("id").alias("low"), F.col("low").alias("over"))
        jumped = low.join(over, "low", "left").select(
            "id", F.least("low", F.coalesce("over", "low")).alias("comp"), F.col("comp").alias("was")
        )
        jumped = written(jumped, "near-labels")
        labels = jumped.select("id", "comp")
        if jumped.where("comp <> was").isEmpty():
            return labels


def _relabelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``rows`` with ``comp``, the component of ``id`` so far."""
    if comps is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after further links."""
    if comps is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        known = comps.select(F.col("id").alias(end), F.col("comp").alias("c" + end))
        ends = ends.join(known, end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
    over = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("comp", "over")
    moved = comps.join(over.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("over", "comp").alias("comp"))
    new = over.join(comps, "id", "left_anti").select("id", F.col("over").alias("comp"))
    return written(moved.unionByName(new), "near-comps")


def _without_ids(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` that are not among ``others``, which go to every task only if they are few."""
    few = others.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(others) if few else others, keys, "left_anti")


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a ``KEY`` of each row, and whether it differs from ``doc_id`` anywhere.

    Rows whose id is null or repeated are written once with numbers below all ids, which stay the same from then on.
    """
    own = F.col("doc_id").cast("long")
    ids = docs.select(own.alias("id"))
    again = written(ids.groupBy("id").count().where("id is null or count > 1").select(F.col("id").alias("__near_id")), "near-repeated")
    if again.isEmpty():
        return docs.withColumn(KEY, own), False
    low = min(0, ids.agg(F.min("id")).first()[0] or 0)
    every = low < -(1 << 62)  # no room for numbers below: all rows are numbered
    few = again.count() <= BROADCAST_IDS
    other = F.broadcast(again) if few else again
    same = own.eqNullSafe(F.col("__near_id"))
    repeated = docs if every else docs.join(other, same, "left_semi")
    numbered = written(repeated.withColumn(KEY, F.lit(0 if every else low - 1) - F.monotonically_increasing_id()), "near-numbered")
    if every:
        return numbered, True
    return docs.join(other, same, "left_anti").withColumn(KEY, own).unionByName(numbered), True


def near_classes(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``.

    Two documents link when the shingles they share are at least ``percent`` of those of either.
    """
    keyed, differs = _keyed(docs)
    found = _key_classes(keyed, percent, size)
    if not differs:
        return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("own").alias("component_id"))
    return _named(keyed, found).select("doc_id", "n_shingles", "component_id")


def _named(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the ``doc_id`` of its rows, the least of each component and the key of a row that has it."""
    ids = keyed.select(F.col(KEY).alias("id"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = written(found.join(ids, "id"), "near-named")
    # a struct of least values puts nulls first, hence the flag
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("least")
    heads = rows.groupBy("own").agg(least).select("own", F.col("least.doc_id").alias("component_id"), F.col("least.id").alias("head"))
    return rows.join(heads, "own")


def _key_classes(keyed: DataFrame, percent: int, size: int) -> DataFrame:
    """Per row: its key ``id``, ``n_shingles`` and ``own``, the least key of its component."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    texts = keyed.select(F.col(KEY).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    last = frequent_shingles(texts, size)
    rows = written(texts.mapInArrow(_summaries(percent, size, last), SET_SCHEMA), "near-rows")
    full = rows.where("n > 0")
    classes = written(full.groupBy("digest").agg(F.min("id").alias("rep")), "near-classes")
    copies = full.select("id", "digest").join(classes, "digest").where("id <> rep").select("id", "digest")
    heads = _without_ids(full, written(copies, "near-copies"), ["id", "digest"])
    postings = heads.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("token")
    shared = written(postings.join(counts, "token").select("token", "id", "n", "pos"), "near-shared")
    # the prefixes, most of the table, are not needed from here on
    bits = written(heads.select("id", "bits"), "near-bits")
    named = written(rows.select("id", "n", "digest").join(classes, "digest", "left").select("id", "n", "rep"), "near-ids")
    removed(keyed.sparkSession, rows)
    first = shared.groupBy("id").agg(F.min(F.struct("pos", "token", "n")).alias("x")).select("id", "x.token", "x.n", "x.pos")
    comps, checked = None, None
    for step in (first, shared, None):
        pairs = _candidates(_relabelled(shared if step is None else step, comps), bits, percent, every=step is None)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        if pairs.isEmpty():
            continue
        links = written(_linked(pairs, texts, percent, size), "near-links")
        checked = pairs if checked is None else checked.unionByName(pairs)
        if not links.isEmpty():
            comps = _merged(comps, links)
    shown = named.withColumn("own", F.coalesce("rep", "id"))
    if comps is not None:
        shown = shown.join(comps.select(F.col("id").alias("own"), "comp"), "own", "left").withColumn("own", F.coalesce("comp", "own"))
    return shown.select("id", F.col("n").alias("n_shingles"), "own")


def first_of_each_class(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """``docs`` with one row of each component, that of the least id; of rows with this id, any one."""
    keyed, differs = _keyed(docs)
    found = _key_classes(keyed, percent, size)
    if differs:
        found = _named(keyed, found).select("id", F.col("head").alias("own"))
    others = written(found.where("id <> own").select(F.col("id").alias(KEY)), "near-others")
    return _without_ids(keyed, others, [KEY]).select(*[F.col(f"`{c}`") for c in docs.columns])
