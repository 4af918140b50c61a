import re
from collections import defaultdict

import regex

from furrow.llm import templates as M

SPLIT = regex.compile(r"(?:[^\p{L}\p{N}\x01-\x03%€°.,:/]|[.,:/](?![0-9])|(?<![0-9])[.,:/]|(?<!\x03)[%€°])+")


def tokens(text):
    text = re.sub("[\x01-\x03]", " ", text or "")
    text = regex.sub(r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)", "\x01\\1", text)
    text = re.sub(r"(?<![0-9])[0-9]+(?:[.,:/][0-9]+)*", lambda m: f" \x02{m[0]} ", text)
    text = regex.sub(M._unit_pattern(), lambda m: f"{m[1]} \x03{m[2] or m[3]} ", text).lower()
    return [x for x in SPLIT.split(text) if x]


def brute(docs, items):
    """{(doc_id, item_id): cover} from sets of plain windows."""
    shape = lambda t: tuple(x[0] if x < "\x04" else x for x in t)
    out = {}
    for d, text in docs:
        t = tokens(text)
        where = defaultdict(list)
        for i in range(len(t) - M.WINDOW + 1):
            where[shape(t[i : i + M.WINDOW])].append(i)
        for k, item in items:
            q = tokens(item)
            n = len(q) - M.WINDOW + 1
            found = defaultdict(set)
            for j in range(max(n, 0)):
                w = shape(q[j : j + M.WINDOW])
                if sum(x >= "\x04" for x in w) >= M.MIN_LITERAL:
                    for i in where.get(w, ()):
                        found[i - j].add(j)
            good = set()
            for shift, at in found.items():
                ends = {x for j in at for x in (j, j + M.WINDOW - 1) if q[x] < "\x04"}
                pairs = {(q[x], t[x + shift]) for x in ends}
                if not pairs or len({a for a, _ in pairs}) / len(pairs) >= M.MIN_CONSISTENT:
                    good |= at
            if good and 100 * len(good) >= M.MIN_COVER * n:
                out[d, k] = round(100 * len(good) / n, 3)
    return out


ITEM = "On Monday the farmer Alice sold 12 baskets of 5 kg each to Bob for 30 euros, then Alice gave 12 more baskets away and asked how many were left."
OTHER = "On Monday the farmer Carla sold 47 baskets of 8 lb each to Dirk for 99 dollars, then Carla gave 47 more baskets away and asked how many were left."
MIXED = "On Monday the farmer Carla sold 47 baskets of 8 lb each to Carla for 99 dollars, then Emma gave 31 more baskets away and asked how many were left."
PLAIN = "The weather on the coast was mild, and the boats came back with little fish for 12 days, as the old men in the harbour had said they would."


def test_changed_values_are_found(spark):
    docs = [(1, "Before. " + ITEM + " After."), (2, f"Some words come first. {OTHER}"), (3, PLAIN), (4, None), (5, ""), (6, ITEM.upper()[:60]), (None, ITEM)]
    items = [(7, ITEM), (7, ITEM), (8, "too short"), (9, None)]
    got = M.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r.cover for r in got.collect()}
    assert found == brute(docs, items)
    assert set(found) == {(1, 7), (2, 7), (None, 7)}


def test_slots_must_agree(spark):
    docs, items = [(1, MIXED)], [(7, ITEM)]
    got = M.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == set(brute(docs, items)) == set()


def test_same_as_brute_force(spark, small):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in small.collect()]
    want = brute(rows, [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): r.cover for r in M.contaminated(small, items).collect()}
    assert got == want and want
    kept = M.clean_documents(small, items)
    assert kept.columns == small.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_without_broadcast(spark, small, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(tuple, M.contaminated(small, items).collect()))
    monkeypatch.setattr(M, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, M.contaminated(small, items).collect())) == want


def test_hard_rows(spark, hard, none):
    items = spark.createDataFrame([(1, "The cat and the dog of the house is in it. The cat and"), (2, "")], "item_id long, text string")
    assert {r.doc_id for r in M.contaminated(hard, items).collect()} == {1}
    assert M.clean_documents(hard, items).count() == hard.count() - 2
    assert M.contaminated(none, items).count() == 0
    assert M.clean_documents(hard, items.limit(0)).count() == hard.count()


POOR = [
    (1, "Compute 12 + 7 - 3 + 45 * 2 - 18 + 6 * 9 - 30 + 4."),
    (2, "Find the median of the values 3, 8, 12, 15, 4, 9, 20, 31, 7, 5, 11 and 2."),
    (3, "What is 6 times 7"),
    (4, "1729"),
    (5, "Meet Anna, Bela, Carl, Dora, Emil, Fritz, Gerd, Hans, Ida, Jan and Karl."),
]


def test_verbatim_copies_of_poor_and_short_items(spark):
    docs = [(k, f"Some words stand before it, and then comes {text} After that more words follow.") for k, text in POOR]
    docs += [(10 + k, text) for k, text in POOR] + [(20, "Compute 13 + 8 - 4 + 46 * 3 - 19 + 7 * 8 - 31 + 5."), (21, "What is 6 times 8"), (22, None), (23, "what")]
    got = M.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(POOR, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d + k, k) for d in (0, 10) for k, _ in POOR}
    assert {r.total_cover for r in got if r.doc_id > 10} == {100.0}


TOM = "Tom has 3 apples and 3 pears in a basket, and gives 3 of the fruits to his friend Anna before lunch; how many are left when he eats 1 more?"
PAT = "Tom has 7 apples and 9 pears in a basket, and gives 4 of the fruits to his friend Clara before lunch; how many are left when he eats 2 more?"
RUN = "Marta walks quickly to the old market. Marta meets a man who asks Marta for help. Marta smiles at him. Marta then goes home."
SET = RUN.replace("Marta", "Helga")


def test_repeated_number_may_split_and_first_words_may_be_names(spark):
    docs = [(1, PAT), (2, SET), (3, "He said that tom was there, and then " + TOM)]
    items = [(7, TOM), (8, RUN)]
    got = M.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    assert set(found) == {(1, 7), (2, 8), (3, 7)}
    assert found[1, 7].total_cover == 100.0 and found[1, 7].consistency < 0.9
    assert found[2, 8].total_cover == 100.0 and found[3, 7].total_cover == 100.0


def test_rows_of_one_id_are_told_apart(spark):
    one, two = PAT, PAT.replace("Clara", "Doris")
    rows = [(k, t) for k in (None, 5) for t in (one, two, PLAIN, None)] + [(5, one), (7, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, TOM)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in M.contaminated(docs, items).collect()) == ["5", "5", "7", "None", "None"]
    left = sorted((str(r.doc_id), str(r.text)) for r in M.clean_documents(docs, items).collect())
    assert left == sorted((str(k), str(t)) for k, t in rows if t in (PLAIN, None))
