import math
import re
from collections import Counter

import pytest

from furrow.llm import quality as Q

WORD = re.compile("[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def classes(text):
    out = [0] * 6
    for c in text or "":
        if c in Q.SENTENCE_MARKS:
            out[3] += 1
        elif "a" <= c <= "z":
            out[0] += 1
        elif "A" <= c <= "Z":
            out[1] += 1
        elif "0" <= c <= "9":
            out[2] += 1
        elif "\x21" <= c <= "\x7e":
            out[4] += 1
        elif c not in " \t\n\x0b\x0c\r":
            out[5] += 1
    return out


def bins(text, lang):
    words = WORD.findall(text or "")
    common = [sum(w in (c, c[:1].upper() + c[1:]) for w in words) for c in Q.COMMON_WORDS[lang]]
    return [*common, len(words) - sum(common)]


def far(a, b):
    if not sum(a) or not sum(b):
        return None
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    kl = lambda x, y: sum(u * math.log2(2 * u / (u + v)) for u, v in zip(x, y) if u)
    return math.sqrt(min(1, max(0, (kl(p, q) + kl(q, p)) / 2)))


def verdicts(rows):
    """Brute force over (text, lang)."""
    known = [(t, lang, base(t)) for t, lang in rows]
    failed = [b[0] < 50 or 100 * b[4] > 50 * b[0] for _, _, b in known]
    refs = {}
    for lang in Q.COMMON_WORDS:
        mine = [t for (t, x, _), f in zip(known, failed) if x == lang and not f]
        total = lambda xs, size: [sum(x[i] for x in xs) for i in range(size)]
        refs[lang] = total([classes(t) for t in mine], 6), total([bins(t, lang) for t in mine], len(Q.COMMON_WORDS[lang]) + 1)
    out = []
    for (t, _, b), f in zip(known, failed):
        near = [(c + w, c, w, x) for x, (rc, rw) in refs.items() for c in [far(classes(t), rc)] for w in [far(bins(t, x), rw)] if c is not None and w is not None]
        bad = False
        if near:
            _, c, w, _ = min(near)
            bad = (b[1] >= Q.MIN_CHARS_JUDGED and c > Q.MAX_CLASS_DISTANCE) or (b[0] >= Q.MIN_WORDS_JUDGED and w > Q.MAX_WORD_DISTANCE)
        out.append((*b, f, not f and not bad, min(near)[1] if near else None))
    return out


def compare(docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    want = sorted(((r.doc_id, *v) for r, v in zip(rows, verdicts([(r.text, r.lang) for r in rows]))), key=str)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance"]
    got = sorted((tuple(r[n] for n in names) for r in Q.quality_report(docs).collect()), key=str)
    assert [x[:-1] for x in got] == [x[:-1] for x in want]
    assert [x[-1] for x in got] == [x[-1] if x[-1] is None else pytest.approx(x[-1], abs=1e-6) for x in want]


def test_same_as_brute_force(small):
    compare(small)


def test_hard_rows(hard):
    compare(hard)
    kept = Q.sound_documents(hard)
    assert kept.columns == hard.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.quality_report(hard).collect() if r.kept}


def test_no_rows(none):
    assert Q.quality_report(none).count() == 0
    assert Q.sound_documents(none).count() == 0


@pytest.mark.parametrize("lang", ["en", "de"])
def test_symbols_go_and_prose_stays(spark, lang):
    prose = " ".join(f"{w} {x}" for w, x in zip(list(Q.COMMON_WORDS[lang]) * 12, [f"w{chr(97 + i % 26)}ord" for i in range(400)]))
    other = " ".join(f"{w}{chr(97 + i % 26)} {chr(97 + i // 26)}x{chr(97 + i % 7)}" for i, w in enumerate(list(Q.COMMON_WORDS[lang]) * 12))
    rows = [(i, prose + f" {chr(97 + i)}", lang) for i in range(5)] + [(9, re.sub(r" ", "%%% ", prose), lang), (10, other, lang)]
    got = {r.doc_id: r.kept for r in Q.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 9: False, 10: False}
