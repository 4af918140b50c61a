import random
from collections import defaultdict

import numpy as np

from furrow.llm import chunks as C


def ends(data):
    """The same cuts, one byte after another."""
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = (h * 2 + int(C.GEAR[b])) % 2**32
        n = i + 1 - start
        if (n >= C.LEAST and h >> (32 - C.MASK_BITS) == 0) or n == C.MOST or i + 1 == len(data):
            out.append(i + 1)
            start = i + 1
    return out


def brute(rows):
    holders, chunks = defaultdict(set), {}
    for d, t in rows:
        data, start = t.encode(), 0
        chunks[d] = []
        for e in ends(data):
            chunks[d].append((start, e, data[start:e]))
            holders[data[start:e]].add(d)
            start = e
    out = set()
    for d, mine in chunks.items():
        spans = []
        for a, b, x in mine:
            if len(holders[x]) < 2:
                continue
            first = min(holders[x])
            if spans and spans[-1][0] + spans[-1][1] == a:
                s = spans[-1]
                spans[-1] = (s[0], s[1] + b - a, s[2] + 1, s[3], s[4] + (b - a) * (first < d))
            else:
                spans.append((a, b - a, 1, first, (b - a) * (first < d)))
        out |= {(d, *s) for s in spans if s[1] >= C.SPAN}
    return out


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij é") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(70))
    rows = []
    for i in range(40):
        own = [word() for _ in range(rng.randrange(0, 200))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, " ".join(own[:at] + ([passage] if i % 3 == 0 else []) + own[at:])))
    rows += [(50, rows[5][1]), (51, "x " + rows[5][1]), (52, ""), (53, "a" * 3000), (54, "a" * 3000)]
    return rows, passage


def test_cuts_byte_by_byte():
    rng = np.random.default_rng(2)
    for n in (0, 1, 23, 24, 25, 256, 257, 5000):
        data = rng.integers(97, 110, n, dtype=np.uint8)
        assert C.chunk_ends(data) == ends(data.tobytes())


def test_spans_against_brute_force(spark):
    rows, _ = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {tuple(r) for r in C.repeated_spans(docs).select("doc_id", "start", "n_bytes", "n_chunks", "first_doc_id", "removed_bytes").collect()}
    assert got == brute(rows)
    assert {0, 3, 6, 50, 51, 53, 54} <= {g[0] for g in got}
    alone = {i for i in range(40) if i % 3 and i != 5}
    assert not alone & {g[0] for g in got}


def test_repeats_are_cut_out(spark):
    rows, passage = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in C.without_repeats(docs).collect()}
    assert left[0] == rows[0][1] and left[5] == rows[5][1] and left[50] == ""
    assert passage[100:250] in left[0] and not any(passage[100:250] in left[i] for i in range(3, 40, 3))
    assert left[1] == rows[1][1]


def test_hard_rows(hard, none):
    assert C.repeated_spans(hard).count() == 0  # copies under one id are one document
    assert sorted(map(str, C.without_repeats(hard).collect())) == sorted(map(str, hard.collect()))
    assert C.repeated_spans(none).count() == 0 and C.without_repeats(none).count() == 0


def test_null_id_is_a_document(spark):
    rows, passage = texts()
    docs = spark.createDataFrame([(None, passage), (4, passage)], "doc_id long, text string")
    assert {(r.doc_id, r.first_doc_id) for r in C.repeated_spans(docs).collect()} == {(None, None), (4, None)}


def test_copies_of_a_text_with_a_shared_passage(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage, own, other = words(120), words(120), words(40)
    rows = [(1, other + " " + passage), (2, passage + " " + own), (3, passage + " " + own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in C.without_repeats(docs).collect()}
    assert left[1] == rows[0][1] and left[3] == ""
    assert own in left[2] and len(left[2]) < len(own) + len(passage) / 3
    spans = C.repeated_spans(docs).where("doc_id = 2").collect()
    assert {(r.removed_bytes == 0, r.first_doc_id) for r in spans} == {(False, 1), (True, 2)}
    assert all(r.removed_bytes in (0, r.n_bytes) for r in spans)


def test_rows_of_one_id_are_cut_each_by_itself(spark):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    p, q, z, own = words(90), words(100), words(40), words(60)
    rows = [(1, p), (5, p + " " + z), (5, q), (None, own), (None, q[:200] + own[:150])]
    left = C.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, r.text) for r in left)
    assert len(got) == 5 and (1, p) in got and (0, own) in got and (0, rows[4][1]) in got
    (a, b) = sorted((t for d, t in got if d == 5), key=len)
    assert z in a and len(a) < len(z) + 200 and q[200:] in b  # each of them loses only what another id holds
