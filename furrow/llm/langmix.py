"""Language proportions of documents by expectation-maximisation over known languages.

Learning counts letter trigrams (bytes of lower-cased words with a blank at either end) per language over all
labelled documents given. The counts have at most ``BUCKETS`` entries per language, so the model is bounded, and
at most ``MAX_LANGUAGES`` languages are accepted; more raise an error.

A document is a mixture: each of its words comes from one language, with the likelihood of its
trigrams. EM estimates the proportions. Languages are ordered by their share under all of them, and
sets of one, two, ... of the first are compared by likelihood less a penalty for each further
language; the search ends where one more does not pay. The prediction is the largest proportion.

A null text and one without a letter is ``und`` with score 0 and no proportions, as is every text when no language
was learned. Null ids and repeated rows are treated like any other. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.shingles import SLICE

BUCKETS = 1 << 16
MAX_LANGUAGES = 256
ROUNDS = 12
PENALTY = 4.0  # times half the log of the number of words, per further language
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def word_trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams centred on each letter byte, and where each word begins among them."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    letter = _LETTER[data]
    clean = np.where(letter, data, np.uint8(32)).astype(np.uint32)
    at = np.flatnonzero(letter)
    code = (clean[at - 1] << np.uint32(16)) | (clean[at] << np.uint32(8)) | clean[at + 1]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(16)
    return bucket.astype(np.int64), np.flatnonzero(np.diff(at, prepend=-2) != 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def add(lang: str, texts: list[str]) -> None:
        found = [word_trigrams(t)[0] for t in texts]
        sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
        sums[lang] += np.bincount(np.concatenate(found), minlength=BUCKETS)

    for batch in batches:
        held: dict[str, list[str]] = {}
        size = 0
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size > SLICE:
                for k, ts in held.items():
                    add(k, ts)
                held, size = {}, 0
        for k, ts in held.items():
            add(k, ts)
        if len(sums) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])


class LanguageModel:
    """Log-likelihoods of trigram buckets, one row per language in code point order."""

    def __init__(self, langs: list[str], logs: np.ndarray) -> None:
        self.langs, self.logs = langs, logs

    @classmethod
    def fit(cls, labelled: DataFrame) -> LanguageModel:
        """From the columns ``text`` and ``lang``; rows with a null in either do not count."""
        rows = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        known = rows.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        counts = known.toPandas()
        langs = sorted(counts["lang"].unique(), key=lambda x: x.encode())
        if len(langs) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        table = np.full((len(langs), BUCKETS), 0.5)
        for i, lang in enumerate(langs):
            mine = counts[counts["lang"] == lang]
            table[i, mine["bucket"].to_numpy(np.int64)] += mine["n"].to_numpy(float)
        return cls(langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))

    def proportions(self, text: str | None) -> dict[str, float]:
        """Shares of the languages that the penalised likelihood keeps; empty if nothing can be said."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return {}
        buckets, starts = word_trigrams(text)
        if not len(starts):  # letters that no byte class holds
            return {}
        words = np.add.reduceat(self.logs[:, buckets], starts, axis=1).astype(np.float64)
        top = words.max(axis=0)
        likely = np.exp(words - top)
        alone = words.sum(axis=1)
        first = int(np.argmax(alone))
        shares, _ = _em(likely, 4)
        order = [first, *(int(k) for k in np.argsort(-shares, kind="stable") if k != first)]
        fee = PENALTY * 0.5 * np.log(len(starts) + 1)
        best, kept = alone[first], {first: 1.0}
        for k in range(2, len(order) + 1):
            some = order[:k]
            pi, log_sum = _em(likely[some], ROUNDS)
            value = log_sum + top.sum() - fee * (k - 1)
            if value <= best:
                break
            best, kept = value, dict(zip(some, map(float, pi)))
        return {self.langs[k]: p for k, p in kept.items() if p > 0}


def _em(likely: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions after some rounds from even ones, and the log-likelihood at them."""
    pi = np.full(len(likely), 1 / len(likely))
    for _ in range(rounds):
        joint = likely * pi[:, None]
        total = joint.sum(axis=0) + 1e-300
        pi = (joint / total).mean(axis=1)
    return pi, float(np.log(pi @ likely + 1e-300).sum())


def language_mixture(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score and ``proportions`` (a map)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.map_(pa.string(), pa.float64())
        for batch in batches:
            found = [model.proportions(t.as_py()) for t in batch.column(len(keep))]
            best = [max(p.items(), key=lambda x: x[1]) if p else (UNKNOWN, 0.0) for p in found]
            columns = [
                *[batch.column(k) for k in range(len(keep))],
                pa.array([b[0] for b in best], pa.string()),
                pa.array([min(1.0, b[1]) for b in best], pa.float64()),
                pa.array([list(p.items()) for p in found], kinds),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "proportions"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, lang_pred string, score double, proportions map<string,double>"
    return docs.select(*keep, "text").mapInArrow(predict, schema)


def held_out_predictions(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from the documents whose id's checksum leaves a remainder, predicts all.

    A null id has no checksum and counts as held out.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    marked = docs.select("doc_id", "text", "lang", F.coalesce(rest == 0, F.lit(True)).alias("held_out"))
    model = LanguageModel.fit(marked.where(~F.col("held_out")))
    return language_mixture(marked, model, ["doc_id", "held_out"])
