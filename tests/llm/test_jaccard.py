import random

import numpy as np
import pyarrow as pa
import pytest

from furrow.llm import jaccard as J
from furrow.llm.shingles import shingle_sets, text_slices


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, percent=80):
    """(doc_id, n_shingles, component_id), sorted, from all pairs of rows that share a shingle."""
    return sorted(_by_row(rows, percent))


def _by_row(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    having = {}
    for i, s in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(i)
    seen = set()
    for many in having.values():
        for k, i in enumerate(many):
            for j in many[:k]:
                if (j, i) not in seen:
                    seen.add((j, i))
                    common = len(sets[i] & sets[j])
                    if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                        parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def ours(docs, percent=80):
    return sorted(tuple(r) for r in J.near_classes(docs, percent).select("doc_id", "n_shingles", "component_id").collect())


def test_sets_equal_those_of_plain_python():
    texts = ["A b\tC d e F g", "", " \n", None, "one two", "ÀB c d é\x0b f g  h", "x" * 5000 + " y z w v u", "a a a a a a a a"]
    rows = []
    for first, data, offsets in text_slices(pa.array([t or "" for t in texts]), 50):
        rows += [len(s) for s in shingle_sets(data, offsets)]
    assert rows == [len(shingles(t)) for t in texts]
    same = [list(shingle_sets(d, o)) for _, d, o in text_slices(pa.array(["A B c d e", "a b C D E", "b a c d e"]))][0]
    assert same[0] == same[1] and same[0] != same[2]


def test_against_all_pairs(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert ours(small) == brute(rows)


@pytest.mark.parametrize("tile, seen", [(4, 3), (1024, 8)])
def test_chains_of_edits_and_shared_passages(spark, monkeypatch, tile, seen):
    """Near copies around the threshold, a passage in most texts, copies, and tiles cut into blocks."""
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "SAMPLE_SEEN", seen)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 90))]
        at = rng.randrange(len(base))
        base[at:at] = passage if rng.random() < 0.7 else []
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = word()
            texts += [" ".join(t)] * rng.choice([1, 1, 1, 3])
            base = t if rng.random() < 0.5 else base
    rng.shuffle(texts)
    rows = list(enumerate([*texts, None, "", "few words", "Few WORDS", " "]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(want) - 10
    assert ours(docs) == want


def test_bitmap_bound_never_undercuts():
    rng = np.random.default_rng(1)
    for n in (1, 5, 63, 64, 65, 400):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: len(a) // 2], rng.integers(0, 2**63, n // 3 + 1).astype(np.uint64)])
        x, y = (np.frombuffer(J._bitmap(s), np.uint64) for s in (a, b))
        w = min(len(x), len(y))
        fold = lambda m: m if len(m) == w else np.bitwise_xor.reduce(m.reshape(-1, w), axis=0)
        differ = int(np.bitwise_count(fold(x) ^ fold(y)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_hard_rows(hard):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.near_classes(hard).collect()}
    assert (2, 0, 2) in got and (3, 0, 3) in got and (4, 0, 4) in got and (9, 1, 9) in got
    assert (None, 3, None) in got and (1, 11, 1) in got and (6, 700, 6) in got
    assert J.near_classes(hard).count() == hard.count()


def test_no_rows(none):
    assert J.near_classes(none).count() == 0


def test_threshold_is_checked(small):
    with pytest.raises(ValueError):
        J.near_classes(small, 0)


@pytest.mark.parametrize("low", [-3, -(2**63)])
def test_rows_of_one_id_link_by_their_texts(spark, low):
    """Null and repeated ids: neighbours of unrelated texts stay apart, and one row of each component stays."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = lambda t: t + " end"
    rows = [(5, a), (5, b), (11, near(a)), (12, near(b)), (None, c), (None, d), (None, near(d)), (7, near(c)), (5, ""), (5, None), (low, a + " more"), (9, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: 2**63 if x is None else x
    want = [(d, n, None if x == 2**63 else x) for (d, _), (_, n, x) in zip(rows, _by_row([(key(i), t) for i, t in rows]))]
    got = [tuple(r) for r in J.near_classes(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {x for _, _, x in got} == {5, 7, 9, None, low}
    kept = sorted(((r.doc_id, r.text) for r in J.first_of_each_class(docs).collect()), key=str)
    left = [(5, b), (5, ""), (5, None), (7, near(c)), (low, a + " more"), (9, "x y")]
    assert [x for x in kept if x[0] is not None] == sorted(left, key=str)
    assert [x for x in kept if x[0] is None] in ([(None, d)], [(None, near(d))])


def test_many_rows_of_one_id(spark):
    """A third of the rows have no id: each is one row, and copies among them are one component."""
    rows = [(i if i % 3 else None, " ".join(f"w{i // 2}x{k}" for k in range(20))) for i in range(600)]
    got = [tuple(r) for r in J.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    keyed = [(2**63 if i is None else i, t) for i, t in rows]
    want = [(None if i == 2**63 else i, n, None if x == 2**63 else x) for (i, _), (_, n, x) in zip(keyed, _by_row(keyed))]
    assert sorted(got, key=str) == sorted(want, key=str)
