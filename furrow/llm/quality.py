"""Quality rules from how far a document's histograms lie from those of real languages.

Two histograms are taken of each document: characters by class, and the most common words
of each language against all other words. A language's reference is the sum of the
histograms of its documents that pass the length and repetition rules. The distance is
that of Jensen and Shannon with logarithms to base 2, the square root of the divergence,
so it lies between 0 and 1. A document is kept if one language is near enough by
both histograms; its label is not used for that. Texts below a length are not judged by
a histogram, since a few words say nothing about a distribution.

The text is read once, without a shuffle: counts are written to the shared folder,
references are sums over them, one row per known language.

Native DataFrame functions only. A null or empty text has no words and fails the length
rule. A null or unknown ``lang`` does not count towards a reference. With no reference at
all (an empty table, no known language) the histograms decide nothing. Other columns
are kept, whatever their names. Repeated rows are judged alike, each on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.keys import attach
from furrow.llm.words import BLANK_RUN, let, with_columns_of, words_of
from furrow.session import written

# fixed values: the most common function words of each language
COMMON_WORDS: Mapping[str, Sequence[str]] = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "with"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui"),
}
SYMBOLS = "#*$%&|<>"
SENTENCE_MARKS = ".,;:!?'\"()-"

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
MIN_CHARS_JUDGED = 200
MIN_WORDS_JUDGED = 150
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.29
N_CLASSES = 6
_Q = "__q_"


def repeated_words(words: Column) -> Column:
    """Words inside a window of three words that occurs at least twice in the array.

    Windows are sorted by hash, and those with an equal neighbour come back in the
    order of the text; each adds the words up to the next one, three at most.
    """

    def counted(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        windows = F.transform(
            starts,
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
        twice = let(
            F.sort_array(windows),
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]),
                ),
                lambda e: e["i"],
            ),
        )
        return let(
            F.sort_array(twice),
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    return F.when(F.size(words) >= 3, let(words, counted)).otherwise(0).cast("long")


def _tally(words: Column) -> Column:
    """Map from each distinct element of an array to how often it occurs, from runs of the sorted array."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull()
        )
        return let(
            starts,
            lambda at: F.map_from_arrays(
                F.transform(at, lambda i: F.get(s, i)),
                F.transform(at, lambda i, k: F.coalesce(F.get(at, k + 1), F.size(s)) - i),
            ),
        )

    return let(F.sort_array(words), runs)


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def count_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and both histograms under names of their own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    spelled = known + [w[:1].upper() + w[1:] for w in known]
    split = docs.withColumns(
        {
            _Q + "words": words_of(text),
            # all but the lower-case letters and the blanks: a small part of an ordinary text
            _Q + "rest": _without(text, r"[a-z\x20\x09-\x0D]+"),
            _Q + "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    words, rest, lines = F.col(_Q + "words"), F.col(_Q + "rest"), F.col(_Q + "lines")
    counted = split.withColumns(
        {
            _Q + "n_words": F.size(words).cast("long"),
            _Q + "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
            _Q + "n_symbols": (F.char_length(rest) - F.char_length(F.translate(rest, SYMBOLS, ""))).cast("long"),
            _Q + "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            _Q + "n_repeat_words": repeated_words(words),
            _Q + "tally": _tally(F.transform(F.filter(words, lambda w: w.isin(spelled)), F.lower)),
            _Q + "upper": F.char_length(_without(rest, "[^A-Z]+")),
            _Q + "digits": F.char_length(_without(rest, "[^0-9]+")),
            _Q + "marks": F.char_length(_without(rest, f"[^{_escaped(SENTENCE_MARKS)}]+")),
            _Q + "ascii": F.char_length(_without(rest, r"[^\x21-\x7E]+")),
            _Q + "n_rest": F.char_length(rest),
        }
    )
    c = lambda name: F.col(_Q + name)
    classes = F.array(
        c("word_chars") - c("n_rest"),  # lower-case letters
        c("upper"),
        c("digits"),
        c("marks"),
        c("ascii") - c("upper") - c("digits") - c("marks"),  # other signs
        c("n_rest") - c("ascii"),  # letters and signs beyond ASCII
    ).cast("array<long>")
    histogram = F.array(*[F.coalesce(F.try_element_at(c("tally"), F.lit(w)), F.lit(0)).cast("long") for w in known])
    return counted.withColumns({_Q + "classes": classes, _Q + "hits": histogram}).drop(
        *[_Q + x for x in ("words", "rest", "lines", "tally", "upper", "digits", "marks", "ascii", "n_rest")]
    )


def _escaped(chars: str) -> str:
    return "".join("\\" + x for x in chars)


def _known() -> list[str]:
    return sorted({w for ws in COMMON_WORDS.values() for w in ws})


def base_failed() -> Column:
    n, r = F.col(_Q + "n_words"), F.col(_Q + "n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEATED * n)


def _normal(counts: Column) -> Column:
    """Shares of an array of counts; null where they sum to nothing."""
    return let(
        F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))),
        lambda n: F.when(n > 0, F.transform(counts, lambda x: F.coalesce(x, F.lit(0)) / n)),
    )


def _word_bins(lang: str) -> Column:
    """Counts of the common words of a language, and of all other words."""
    known = _known()
    hits = F.array(*[F.col(_Q + "hits")[known.index(w)] for w in COMMON_WORDS[lang]])
    seen = F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.concat(hits, F.array(F.col(_Q + "n_words") - seen))


def language_references(features: DataFrame) -> DataFrame:
    """One row: per language the shares in all its sound documents, null without any."""
    known = _known()
    sound = features.where(F.col("lang").isin(list(COMMON_WORDS)) & ~base_failed())
    sums = []
    for lang in COMMON_WORDS:
        of = lambda x, lang=lang: F.sum(F.when(F.col("lang") == lang, x))
        hits = [of(F.col(_Q + "hits")[known.index(w)]) for w in COMMON_WORDS[lang]]
        rest = of(F.col(_Q + "n_words"))
        sums += [
            F.array(*[of(F.col(_Q + "classes")[i]) for i in range(N_CLASSES)]).alias(f"c_{lang}"),
            F.array(*hits).alias(f"h_{lang}"),
            rest.alias(f"n_{lang}"),
        ]
    summed = sound.agg(*sums)
    out = []
    for lang in COMMON_WORDS:
        seen = F.aggregate(F.col(f"h_{lang}"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
        bins = F.concat(F.col(f"h_{lang}"), F.array(F.col(f"n_{lang}") - seen))
        out += [_normal(F.col(f"c_{lang}")).alias(f"{_Q}c_{lang}"), _normal(bins).alias(f"{_Q}w_{lang}")]
    return summed.select(*out)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; null where one is null."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    twice = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    # greatest() passes over nulls
    return F.when(twice.isNotNull(), F.sqrt(F.least(F.greatest(twice / 2, F.lit(0.0)), F.lit(1.0))))


def judged(features: DataFrame, references: DataFrame) -> DataFrame:
    """Adds the nearest language with both distances to it, ``base_failed`` and ``kept`` (prefixed)."""
    both = attach(features, references, [])
    shares = both.withColumns(
        {_Q + "p": _normal(F.col(_Q + "classes"))} | {f"{_Q}p_{lang}": _normal(_word_bins(lang)) for lang in COMMON_WORDS}
    )
    far = shares.withColumns(
        {f"{_Q}dc_{lang}": distance(F.col(_Q + "p"), F.col(f"{_Q}c_{lang}")) for lang in COMMON_WORDS}
        | {f"{_Q}dw_{lang}": distance(F.col(f"{_Q}p_{lang}"), F.col(f"{_Q}w_{lang}")) for lang in COMMON_WORDS}
    )
    options = []
    for lang in COMMON_WORDS:
        c, w = F.col(f"{_Q}dc_{lang}"), F.col(f"{_Q}dw_{lang}")
        options.append(
            F.when(
                (c + w).isNotNull(),
                F.struct((c + w).alias("both"), c.alias("by_class"), w.alias("by_word"), F.lit(lang).alias("lang")),
            )
        )
    nearest = far.withColumn(_Q + "near", F.least(*options))
    strange = (
        (F.col(_Q + "word_chars") >= MIN_CHARS_JUDGED) & (F.col(_Q + "near.by_class") > MAX_CLASS_DISTANCE)
    ) | ((F.col(_Q + "n_words") >= MIN_WORDS_JUDGED) & (F.col(_Q + "near.by_word") > MAX_WORD_DISTANCE))
    return nearest.withColumn(_Q + "base_failed", base_failed()).withColumn(
        _Q + "kept", ~F.col(_Q + "base_failed") & ~F.coalesce(strange, F.lit(False))
    )


def quality_report(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, the nearest language with both distances, and the verdict."""
    slim = with_columns_of(docs, {"doc_id": "long", "text": "string", "lang": "string"}).select("doc_id", "text", "lang")
    features = written(count_features(slim).drop("text"), "quality-counts")
    c = lambda name: F.col(_Q + name)
    return judged(features, language_references(features)).select(
        "doc_id",
        *[c(x).alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        c("near.lang").alias("nearest_lang"),
        F.round(c("near.by_class"), 6).alias("class_distance"),
        F.round(c("near.by_word"), 6).alias("word_distance"),
    )


def sound_documents(docs: DataFrame) -> DataFrame:
    """The documents the rules keep, with their own columns; counts travel beside the text once.

    The verdict is handed on by a generator, as a plain filter on it would be moved below the
    steps that lead to it and would repeat them.
    """
    all_columns = with_columns_of(docs, {"text": "string", "lang": "string"})
    features = written(count_features(all_columns), "quality-documents")
    own = [F.col(f"`{c}`") for c in docs.columns]
    verdict = judged(features, language_references(features)).select(*own, F.explode(F.array(F.col(_Q + "kept"))).alias(_Q + "kept"))
    return verdict.where(F.col(_Q + "kept")).select(*own)


def _report_sql() -> str:
    quoted = lambda ws: ", ".join(f"'{w}'" for w in ws)
    words = r"[^\x20\x09-\x0D]+"
    count = lambda pattern: f"length(regexp_replace(rest, '{pattern}', '', 'g'))"
    marks = "".join("''" if x == "'" else "\\" + x for x in SENTENCE_MARKS)
    known = _known()
    spelled = known + [w[:1].upper() + w[1:] for w in known]
    pairs = ", ".join(f"('{lang}', '{w}')" for lang, ws in COMMON_WORDS.items() for w in ws)
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t, lang FROM documents),
a AS (SELECT *, regexp_extract_all(t, '{words}') AS w, regexp_replace(t, '[a-z\\x20\\x09-\\x0D]+', '', 'g') AS rest,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{words}')] AS l FROM d),
n AS (SELECT i, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(rest) AS n_rest,
  length(rest) - {count('[#*$%&|<>]+')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  {count('[^A-Z]+')} AS c1, {count('[^0-9]+')} AS c2, {count(f'[^{marks}]+')} AS c3, {count(r'[^\x21-\x7E]+')} AS ascii FROM a),
u AS (SELECT i, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM a),
v AS (SELECT i, k, x, lead(x, 1) OVER s AS y, lead(x, 2) OVER s AS z FROM u WINDOW s AS (PARTITION BY i ORDER BY k)),
g AS (SELECT i, k, z IS NOT NULL AND count(*) OVER (PARTITION BY i, x, y, z) > 1 AS twice FROM v),
r AS (SELECT i, count(*) FILTER (inside) AS n_repeat_words FROM (
  SELECT i, bool_or(twice) OVER (PARTITION BY i ORDER BY k ROWS 2 PRECEDING) AS inside FROM g) GROUP BY i),
b AS (SELECT n.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEATED} * n_words AS base_failed FROM n LEFT JOIN r USING (i)),
c AS (SELECT i, unnest([0, 1, 2, 3, 4, 5]) AS bin, unnest([word_chars - n_rest, c1, c2, c3, ascii - c1 - c2 - c3, n_rest - ascii]) AS n FROM b),
h AS (SELECT i, lower(x) AS word, count(*) AS n FROM u WHERE x IN ({quoted(spelled)}) GROUP BY ALL),
cw AS (SELECT * FROM (VALUES {pairs}) t(lang2, word)),
hw AS (SELECT b.i, lang2, cw.word, coalesce(h.n, 0) AS n FROM b CROSS JOIN cw LEFT JOIN h ON h.i = b.i AND h.word = cw.word),
wb AS (SELECT i, lang2, word, n FROM hw UNION ALL SELECT i, lang2, NULL, min(n_words) - sum(n) FROM hw JOIN b USING (i) GROUP BY i, lang2),
rc AS (SELECT lang AS lang2, bin, sum(n) AS n FROM c JOIN b USING (i) WHERE lang IN ({quoted(COMMON_WORDS)}) AND NOT base_failed GROUP BY ALL),
rw AS (SELECT lang2, word, sum(n) AS n FROM wb JOIN b USING (i) WHERE lang = lang2 AND NOT base_failed GROUP BY ALL),
pc AS (SELECT i, bin, n / nullif(sum(n) OVER (PARTITION BY i), 0) AS p FROM c),
qc AS (SELECT lang2, bin, n / nullif(sum(n) OVER (PARTITION BY lang2), 0) AS q FROM rc),
pw AS (SELECT i, lang2, word, n / nullif(sum(n) OVER (PARTITION BY i, lang2), 0) AS p FROM wb),
qw AS (SELECT lang2, word, n / nullif(sum(n) OVER (PARTITION BY lang2), 0) AS q FROM rw),
dc AS (SELECT i, lang2, sqrt(least(greatest(sum({_TERM_SQL}) / 2, 0), 1)) AS by_class FROM pc JOIN qc USING (bin) WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY ALL),
dw AS (SELECT i, pw.lang2, sqrt(least(greatest(sum({_TERM_SQL}) / 2, 0), 1)) AS by_word
  FROM pw JOIN qw ON pw.lang2 = qw.lang2 AND pw.word IS NOT DISTINCT FROM qw.word WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY ALL),
near AS (SELECT * FROM dc JOIN dw USING (i, lang2) QUALIFY row_number() OVER (PARTITION BY i ORDER BY by_class + by_word, by_class, by_word, lang2) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce((word_chars >= {MIN_CHARS_JUDGED} AND by_class > {MAX_CLASS_DISTANCE}) OR (n_words >= {MIN_WORDS_JUDGED} AND by_word > {MAX_WORD_DISTANCE}), false) AS kept,
  lang2 AS nearest_lang, round(by_class, 6) AS class_distance, round(by_word, 6) AS word_distance
FROM b LEFT JOIN near USING (i)"""


_TERM_SQL = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END"
REPORT_SQL = _report_sql()
