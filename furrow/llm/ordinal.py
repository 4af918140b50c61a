"""Ordinal regression of graded ratings on hashed text.

Grades 0 to K - 1 share one weight per hashed word; ordered thresholds turn the weighted sum
s into P(grade >= k) = 1 / (1 + exp(theta_k - s)). A document's features are its distinct words, with and
without signs, and the beginnings of words, each with the same value and together of fixed length. Features
that few labelled documents have get no weight. Weights and thresholds are fitted by adaptive gradient steps
on the cumulative-link likelihood.

The fit takes a sample of labelled documents of at most ``SAMPLE`` rows, by a hash of the id, in one task; scoring
takes whole texts of all documents. The model is ``BUCKETS`` numbers, whatever the corpus.

A null or empty text has no words and gets the grade of a sum of zero. Labels without a document and null grades are not
used; without any label the fit raises an error unless the table of documents is empty, too. Repeated
rows are scored alike. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.shingles import ALPHANUMERIC, BYTE_VALUE, IN_WORD, PLACE, mix, text_slices, word_hashes

BITS = 20
BUCKETS = 1 << BITS
BEGINNING = 6  # bytes of a word's beginning
SAMPLE = 20_000
EPOCHS = 8
STEP = 0.3
DECAY = 0.01
SEEN = 8  # labelled documents that must have a feature
SCALE = 4.0  # length of a document's features


def beginnings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first bytes of each alphanumeric word that is long enough, and their number before each row."""
    inside = ALPHANUMERIC[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = inside[offsets[:-1][offsets[:-1] < len(data)]]
    starts = np.flatnonzero(first[: max(0, len(data) - BEGINNING + 1)])
    row_end = offsets[np.searchsorted(offsets, starts, "right")]
    starts = starts[starts + BEGINNING <= row_end]
    hashes, whole = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
    for k in range(BEGINNING):
        piece = data[starts + k]
        hashes += BYTE_VALUE[piece] * PLACE[16 + k]
        whole &= ALPHANUMERIC[piece]
    starts, hashes = starts[whole], mix(hashes[whole])
    return hashes, np.searchsorted(starts, offsets)


def text_features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text the sorted distinct buckets of its words, with and without signs, and of their beginnings."""
    for _, data, offsets in text_slices(texts):
        parts = []
        for of in (IN_WORD, ALPHANUMERIC):
            hashes, at = word_hashes(data, offsets, of)
            parts.append(((hashes >> np.uint64(64 - BITS)).astype(np.int32), at))
        hashes, at = beginnings(data, offsets)
        parts.append(((hashes >> np.uint64(64 - BITS)).astype(np.int32), at))
        for k in range(len(offsets) - 1):
            yield np.unique(np.concatenate([p[at[k] : at[k + 1]] for p, at in parts]))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    used: np.ndarray  # buckets that count

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K - 1, one row per text."""
        sums = np.array([_sum(self.weights, self.used, x) for x in text_features(texts)])
        return _link(sums[:, None] - self.thresholds[None, :])


def _link(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _sum(weights: np.ndarray, used: np.ndarray, x: np.ndarray) -> float:
    x = x[used[x]]
    return float(weights[x].sum()) * SCALE / np.sqrt(max(len(x), 1))


def fit_arrays(
    features: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = EPOCHS, seen: int = SEEN, seed: int = 3
) -> OrdinalModel:
    """Adaptive gradient steps, one document after the other in a fixed random order."""
    rng = np.random.default_rng(seed)
    used = np.bincount(np.concatenate(features), minlength=BUCKETS) >= min(seen, max(1, len(features) // 20))
    features = [x[used[x]] for x in features]
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)]).clip(1e-3, 1 - 1e-3)
    theta, theta_squares = np.sort(-np.log(share / (1 - share))), np.full(n_grades - 1, 1e-2)
    for _ in range(epochs):
        for i in rng.permutation(len(features)):
            x, y = features[i], int(grades[i])
            value = SCALE / np.sqrt(max(len(x), 1))
            s = weights[x].sum() * value
            # P(y) = F(s - theta_y) - F(s - theta_{y+1}); slopes of its log by s and by both thresholds
            up = _link(s - theta[y - 1]) if y else 1.0
            low = _link(s - theta[y]) if y < n_grades - 1 else 0.0
            p = max(up - low, 1e-9)
            by_up, by_low = up * (1 - up) / p, low * (1 - low) / p
            g = np.clip(by_up - by_low, -3, 3) * value - DECAY * weights[x]
            squares[x] += g * g
            weights[x] += STEP * g / np.sqrt(squares[x])
            for k, t in ((y - 1, -by_up), (y, by_low)):
                if 0 <= k < n_grades - 1:
                    t = float(np.clip(t, -3, 3))
                    theta_squares[k] += t * t
                    theta[k] += 0.5 * STEP * t / np.sqrt(theta_squares[k])
            theta.sort()
    return OrdinalModel(weights.astype(np.float32), theta, used)


def _fit_task(n_grades: int, epochs: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, grades = [], []
        for batch in batches:
            features += list(text_features(batch.column(0)))
            grades += batch.column(1).to_pylist()
        if not grades:
            return
        model = fit_arrays(features, np.array(grades), n_grades, epochs)
        parts = [model.weights, model.thresholds, np.packbits(model.used)]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["weights", "thresholds", "used"])

    return fit


def fit_grades(rated: DataFrame, n_grades: int, sample: int = SAMPLE, epochs: int = EPOCHS) -> OrdinalModel | None:
    """From ``doc_id``, ``text`` and ``grade``; None without a row."""
    rows = rated.where(F.col("grade").isNotNull())
    total = rows.count()
    picked = rows.withColumn("turn", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(11)))
    if total > sample:
        # the threshold leaves a little below the bound; the limit makes the bound hold
        share = 0.95 * sample / total
        picked = picked.where(F.pmod("turn", F.lit(1_000_000)) < int(1_000_000 * share)).limit(sample)
    one = picked.select(F.coalesce("text", F.lit("")).alias("text"), F.col("grade").cast("int").alias("grade"), "turn")
    one = one.repartition(1).sortWithinPartitions("turn", "text").drop("turn")
    found = one.mapInArrow(_fit_task(n_grades, epochs), "weights binary, thresholds binary, used binary").collect()
    if not found:
        return None
    used = np.unpackbits(np.frombuffer(found[0][2], np.uint8)).astype(bool)
    return OrdinalModel(np.frombuffer(found[0][0], np.float32), np.frombuffer(found[0][1], np.float64), used)


def score_grades(docs: DataFrame, model: OrdinalModel, keep_from: float = 0.5) -> DataFrame:
    """Per document: expected grade, the tail probabilities ``p_ge_1``, ... and ``kept``.

    ``kept`` tells whether the highest grade is at least as likely as ``keep_from``.
    """
    k = len(model.thresholds)
    tails = [f"p_ge_{i + 1}" for i in range(k)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.tails(batch.column(1))
            columns = [batch.column(0), pa.array(p.sum(axis=1), pa.float64()), *[pa.array(p[:, i], pa.float64()) for i in range(k)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p[:, -1] >= keep_from)], ["doc_id", "expected_grade", *tails, "kept"])

    schema = "doc_id long, expected_grade double, " + ", ".join(f"{t} double" for t in tails) + ", kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(score, schema)


def label_grades(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Graded documents: 0 for toxic ones, 1 for others of low quality, 2 for good ones."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    graded = labels.select(F.col("doc_id").alias("__id"), grade.alias("grade")).where("grade is not null")
    return docs.join(graded, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "grade")


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_grades(label_grades(docs, labels), 3)
    if model is None:
        if not docs.isEmpty():
            raise ValueError("no labelled document to learn from")
        model = OrdinalModel(np.zeros(BUCKETS, np.float32), np.zeros(2), np.zeros(BUCKETS, bool))
    return score_grades(docs, model)
