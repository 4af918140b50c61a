"""Benchmark decontamination by template: finds questions whose numbers, names or units were changed.

Texts become token templates: a number, a unit after a number and a capitalised word inside a sentence
are replaced by a placeholder of their type, everything else is lower-cased and stripped of
punctuation. Windows of ``WINDOW`` tokens are joined by hash. A match is a document, an item and their shift
against each other. Its windows show which value stands in a slot of the item and of
the document; one name of the item must stand for one of the document, or the match does not
count. A number or unit of the item may become several: the match then has a lower ``consistency``, but counts.
A document is contaminated by an item when consistent matches cover at
least ``MIN_COVER`` percent of the item's windows.

A capitalised word that opens a sentence is no slot by itself. Where a text shows the word as a name elsewhere,
its windows are taken in both forms, with the word and with a name in its place; so are those of the first
word of an item, which a document may show inside a sentence.

Windows of the item with fewer than ``MIN_LITERAL`` literal tokens match too much as templates and are indexed by
their exact tokens, values included; so are items shorter than a window, as one window of their own length. All
windows of an item are thus indexed, and a verbatim copy matches whatever it is made of. Documents are
searched for exact windows only of the lengths that the index holds. The windows of the benchmark are counted; up to
``BROADCAST_WINDOWS`` they are sent to every task, so the windows of documents are not shuffled, and beyond that
the join is left to Spark.

Native DataFrame functions only. Null and empty texts have no windows. A document is a row: rows of one id, null
too, that differ in text are matched, reported and dropped each by itself; rows equal in id and text are reported
once and dropped together. Repeated benchmark rows are each reported.
Empty tables give an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.words import let
from furrow.session import written

WINDOW = 8
MIN_LITERAL = 4
MIN_COVER = 40
MIN_CONSISTENT = 0.9
BROADCAST_WINDOWS = 1_000_000  # rows of about 60 bytes
BROADCAST_IDS = 1_000_000
TEXT_KEY = "__text_key"

# fixed values: units that follow a number
UNITS = (
    "%", "°c", "°f", "€", "cents", "centimeters", "cm", "days", "dollars", "euros", "feet", "ft", "g", "gb", "grams", "h",
    "hours", "inches", "kb", "kg", "kilograms", "kilometers", "km", "kwh", "l", "lb", "liters", "mb", "meters", "mg", "mi",
    "miles", "min", "minutes", "ml", "mm", "months", "mph", "ms", "pounds", "seconds", "tons", "weeks", "yards", "years",
)
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
_FIRST_LITERAL = "\x04"
_WINDOWS = "array<struct<pos:int,h:bigint,first:string,last:string,plain:boolean>>"
_WINDOWS_LITERAL = _WINDOWS.replace(">>", ",literals:int>>")


def _unit_pattern() -> str:
    words = sorted((u for u in UNITS if u[0].isalpha()), key=lambda u: (-len(u), u))
    return rf"(?i)({NUMBER}[0-9.,:/]+)\s*(?:({'|'.join(words)})(?![\p{{L}}\p{{N}}])|([%€]|°[cf](?![\p{{L}}\p{{N}}])))"


def tokens_of(text: Column) -> Column:
    """Array of tokens; a slot is a placeholder followed by the value that stood there."""
    clean = text
    for mark in (NAME, NUMBER, UNIT):
        clean = F.replace(clean, F.lit(mark), F.lit(" "))
    named = F.regexp_replace(clean, r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)", NAME + "$1")
    numbered = F.regexp_replace(named, r"(?<![0-9])[0-9]+(?:[.,:/][0-9]+)*", f" {NUMBER}$0 ")
    measured = F.lower(F.regexp_replace(numbered, _unit_pattern(), f"$1 {UNIT}$2$3 "))
    parts = F.split(measured, r"(?:[^\p{L}\p{N}\x01-\x03%€°.,:/]|[.,:/](?![0-9])|(?<![0-9])[.,:/]|(?<!\x03)[%€°])+")
    return F.filter(parts, lambda x: x != "")


def _template(token: Column) -> Column:
    return F.when(token < _FIRST_LITERAL, F.substring(token, 1, 1)).otherwise(token)


def _slot(tokens: Column, i: Column) -> Column:
    return F.when(F.get(tokens, i) < _FIRST_LITERAL, F.get(tokens, i))


def windows_of(tokens: Column, literal: bool = False) -> Column:
    """Array of (pos, h, first, last, plain): the window's hash and the slots at both of its ends.

    With ``literal`` also the number of tokens that are no placeholders.
    """

    def of(t: Column) -> Column:
        hashes = F.transform(t, lambda x: F.xxhash64(_template(x)))

        def at(h: Column, i: Column) -> Column:
            fields = [
                i.alias("pos"),
                F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]).alias("h"),
                _slot(t, i).alias("first"),
                _slot(t, i + (WINDOW - 1)).alias("last"),
                F.lit(True).alias("plain"),
            ]
            if literal:
                part = F.slice(t, i + 1, WINDOW)
                fields.append(F.size(F.filter(part, lambda x: x >= _FIRST_LITERAL)).alias("literals"))
            return F.struct(*fields)

        return let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(t) - WINDOW), lambda i: at(h, i)))

    return F.when(F.size(tokens) >= WINDOW, let(tokens, of))


def _renamed(tokens: Column, opening: bool = False) -> Column:
    """Array of (pos, token): words that the text shows as names elsewhere, as names; with ``opening`` also the first token."""

    def of(t: Column) -> Column:
        words = F.transform(F.filter(t, lambda x: x.startswith(NAME)), lambda x: F.substring(x, 2, 1 << 30))
        both = F.array_intersect(words, t)
        seen = lambda b: F.transform(
            t, lambda x, i: F.when(F.array_contains(b, x) | ((i == 0) & (x >= _FIRST_LITERAL) & F.lit(opening)), i)
        )
        none = F.array().cast("array<int>")
        at = lambda b: F.when((F.size(b) > 0) | F.lit(opening), F.filter(seen(b), lambda i: i.isNotNull())).otherwise(none)
        return let(both, at)

    return let(tokens, of)


def renamed_windows(tokens: Column, literal: bool = False, opening: bool = False) -> Column:
    """Array like that of ``windows_of``: the windows around words that may be names, with names in their places."""

    def of(t: Column, at: Column) -> Column:
        named = F.transform(t, lambda x, i: F.when(F.array_contains(at, i), F.concat(F.lit(NAME), x)).otherwise(x))
        last = F.size(t) - WINDOW
        near = F.transform(at, lambda p: F.sequence(F.least(F.greatest(p - (WINDOW - 1), F.lit(0)), last), F.least(p, last)))
        starts = F.array_distinct(F.flatten(near))
        return let(named, lambda n: F.transform(starts, lambda i: _window(n, i, literal)))

    none = F.array().cast(_WINDOWS_LITERAL if literal else _WINDOWS)
    whole = lambda t: let(_renamed(t, opening), lambda at: F.when(F.size(at) > 0, of(t, at)).otherwise(none))
    return F.when(F.size(tokens) >= WINDOW, let(tokens, whole)).otherwise(none)


def _window(tokens: Column, i: Column, literal: bool) -> Column:
    fields = [
        i.alias("pos"),
        F.xxhash64(*[F.xxhash64(_template(F.get(tokens, i + k))) for k in range(WINDOW)]).alias("h"),
        _slot(tokens, i).alias("first"),
        _slot(tokens, i + (WINDOW - 1)).alias("last"),
        F.lit(False).alias("plain"),
    ]
    if literal:
        fields.append(F.size(F.filter(F.slice(tokens, i + 1, WINDOW), lambda x: x >= _FIRST_LITERAL)).alias("literals"))
    return F.struct(*fields)


def _exact(tokens: Column, i: Column, size: int) -> Column:
    """The window of ``size`` exact tokens at ``i``; a name counts as its word, whatever stands before it."""
    words = [F.replace(F.get(tokens, i + k), F.lit(NAME), F.lit("")) for k in range(size)]
    none = F.lit(None).cast("string")
    return F.struct(i.alias("pos"), F.xxhash64(F.lit(size), *words).alias("h"), none.alias("first"), none.alias("last"), F.lit(False).alias("plain"))


def _poor_starts(tokens: Column) -> Column:
    """Where the windows with fewer than ``MIN_LITERAL`` literal tokens start, from the places of the slots alone."""
    reach = WINDOW - MIN_LITERAL  # a poor window holds this many slots after its first one

    def around(p: Column) -> Column:
        def starts(k: Column) -> Column:
            low, high = F.greatest(F.get(p, k + reach) - (WINDOW - 1), F.lit(0)), F.least(F.get(p, k), F.size(tokens) - WINDOW)
            return F.when(F.get(p, k + reach) - F.get(p, k) < WINDOW, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - (reach + 1)), starts)))

    slots = F.filter(F.transform(tokens, lambda x, i: F.when(x < _FIRST_LITERAL, i)), lambda i: i.isNotNull())
    return let(slots, lambda p: F.when((F.size(p) > reach) & (F.size(tokens) >= WINDOW), around(p)).otherwise(F.array().cast("array<int>")))


def exact_windows(tokens: Column, size: int) -> Column:
    """Array like that of ``windows_of``, of exact tokens: all of a shorter ``size``, the poor ones of ``WINDOW``."""
    if size == WINDOW:
        return let(tokens, lambda t: F.transform(_poor_starts(t), lambda i: _exact(t, i, size)))
    every = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - size), lambda i: _exact(t, i, size))
    return F.when(F.size(tokens) >= size, let(tokens, every)).otherwise(F.array().cast(_WINDOWS))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per indexed window: item, h, item_pos, item_first, item_last, item_windows, item_plain, exact, named.

    ``exact`` is the length of a window of exact tokens, and null for a template; ``named`` tells of windows of an item with
    a word that it shows as a name elsewhere.
    """
    rows = items.select(F.col(id_col).alias("item_id"), tokens_of(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    counted = rows.withColumn("item_windows", F.greatest(F.size("t") - (WINDOW - 1), F.lit(1)))
    parts = []
    for form, named in ((windows_of(F.col("t"), literal=True), False), (renamed_windows(F.col("t"), literal=True, opening=True), True)):
        templates = counted.select("item_id", "item_windows", F.inline(form), (F.lit(named) & (F.size(_renamed(F.col("t"))) > 0)).alias("named"))
        parts.append(templates.where(F.col("literals") >= MIN_LITERAL).drop("literals").withColumn("exact", F.lit(None).cast("int")))
    for size in range(1, WINDOW + 1):
        those = counted if size == WINDOW else counted.where(F.size("t") == size)
        parts.append(those.select("item_id", "item_windows", F.inline(exact_windows(F.col("t"), size)), F.lit(False).alias("named"), F.lit(size).alias("exact")))
    return reduce(DataFrame.unionByName, parts).select(
        "item_id", "h", F.col("pos").alias("item_pos"), F.col("first").alias("item_first"), F.col("last").alias("item_last"), "item_windows", F.col("plain").alias("item_plain"), "exact", "named"
    )


def _text_key(docs: DataFrame) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(docs["text"])


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, cover, consistency, total_windows, total_cover) of each match of document and item.

    ``cover`` is the percentage of the item's windows found as plain templates, ``total_cover``, which decides, that of the
    ``total_windows`` found in any form. ``consistency`` the least share of slot values
    that stand for one value among the matches that count.
    """
    return _matches(docs, items).drop(TEXT_KEY)


def _matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The result of ``contaminated`` with the key of the text."""
    index = written(benchmark_windows(items), "template-windows")
    few = index.count() <= BROADCAST_WINDOWS
    sizes = [r[0] for r in index.select("exact").distinct().where("exact is not null").collect()]  # at most WINDOW of them

    renamed = not index.where("named").isEmpty()

    def pieces_of(t: Column) -> Column:
        more = [exact_windows(t, size) for size in sorted(sizes)] + ([renamed_windows(t)] if renamed else [])
        return F.concat(F.coalesce(windows_of(t), F.array().cast(_WINDOWS)), *more) if more else windows_of(t)

    tokens = tokens_of(F.col("text"))
    windows = let(tokens, pieces_of) if sizes or renamed else pieces_of(tokens)
    # the outer form: the other one makes the optimiser test the arrays for rows, and compute them twice for that
    pieces = docs.select("doc_id", _text_key(docs).alias(TEXT_KEY), windows.alias("w")).select("doc_id", TEXT_KEY, F.inline_outer("w"))
    met = pieces.join(F.broadcast(index) if few else index, "h").withColumn("shift", F.col("pos") - F.col("item_pos"))
    pair = lambda a, b: F.when(F.col(a).isNotNull(), F.struct(F.col(a).alias("item"), F.col(b).alias("doc")))
    # a match has at most as many rows as the item has windows
    matches = met.groupBy("doc_id", TEXT_KEY, "item_id", "item_windows", "shift").agg(
        F.collect_set(F.when(F.col("plain") & F.col("item_plain"), F.col("item_pos"))).alias("found"),
        F.collect_set("item_pos").alias("found_all"),
        F.array_union(F.collect_set(pair("item_first", "first")), F.collect_set(pair("item_last", "last"))).alias("slots"),
    )
    # how far the values of the item stand for one value each
    single = lambda slots: F.when(
        F.size(slots) > 0, F.size(F.array_distinct(F.transform(slots, lambda s: s["item"]))) / F.size(slots)
    ).otherwise(1.0)
    names = F.filter("slots", lambda s: s["item"].startswith(NAME))
    consistent = matches.where(single(names) >= MIN_CONSISTENT).withColumn("consistency", single(F.col("slots")))
    union = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    total = consistent.groupBy("doc_id", TEXT_KEY, "item_id", "item_windows").agg(
        union("found").alias("windows"), union("found_all").alias("total_windows"), F.min("consistency").alias("consistency")
    )
    share = lambda n: 100.0 * n / F.col("item_windows")
    return total.where(100 * F.col("total_windows") >= MIN_COVER * F.col("item_windows")).select(
        "doc_id",
        "item_id",
        "windows",
        "item_windows",
        F.round(share(F.col("windows")), 3).alias("cover"),
        F.round("consistency", 6).alias("consistency"),
        "total_windows",
        F.round(share(F.col("total_windows")), 3).alias("total_cover"),
        TEXT_KEY,
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that an item contaminates."""
    found = _matches(docs, items).select(F.col("doc_id").alias("__leak"), F.col(TEXT_KEY).alias("__leak_text")).distinct()
    leaks = written(found, "template-leaks")
    few = leaks.count() <= BROADCAST_IDS
    same = docs["doc_id"].eqNullSafe(F.col("__leak")) & (_text_key(docs) == F.col("__leak_text"))
    return docs.join(F.broadcast(leaks) if few else leaks, same, "left_anti")
