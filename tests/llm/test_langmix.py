import zlib

import pytest

from furrow.llm import langmix as L


@pytest.fixture(scope="module")
def model(spark, small):
    return L.LanguageModel.fit(small)


def test_counts_are_those_of_plain_python(spark, small, model):
    rows = [(r.text, r.lang) for r in small.collect()]
    assert model.langs == sorted({lang for _, lang in rows})
    grams = set()
    for text, _ in rows[:20]:
        data = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in f" {text.lower()} ".encode())
        grams |= {data[i - 1 : i + 2] for i in range(1, len(data) - 1) if data[i] != 32}
    buckets = {((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % 2**32) >> 16 for g in grams}
    assert {int(b) for text, _ in rows[:20] for b in L.word_trigrams(text)[0]} == buckets


def test_held_out_accuracy(small):
    got = {r.doc_id: r for r in L.held_out_predictions(small).collect()}
    rows = small.collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= g.score <= 1 for g in got.values())


def test_mixture_is_found(small, model):
    by = {}
    for r in small.orderBy("doc_id").collect():
        by.setdefault(r.lang, []).extend(r.text.split())
    mixed = model.proportions(" ".join(by["fr"][:300] + by["de"][:100]))
    assert set(mixed) == {"fr", "de"} and 0.6 < mixed["fr"] < 0.9
    assert set(model.proportions(" ".join(by["es"][:300]))) == {"es"}


def test_hard_rows(hard, none):
    got = {r.doc_id: r for r in L.held_out_predictions(hard).collect()}
    for i in (2, 3, 4, 7 if got[7].lang_pred == "und" else 2):
        assert got[i].lang_pred == "und" and got[i].score == 0
    assert got[None].held_out and got[7].lang_pred != "und"  # the x of <x> is a letter
    assert L.held_out_predictions(none).count() == 0
    assert {r.lang_pred for r in L.held_out_predictions(hard.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
