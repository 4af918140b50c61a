import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from furrow.llm import wavelet as V
from furrow.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \n", "a\x01b \x01 c", "<|endoftext|> x<|startoftext|>y", "é ́ it's 12ab!!??", "\xa0a b\x1cc", "ĀÉ ĀÉ", "x" * 3000]


@pytest.fixture(scope="module")
def whole():
    k = Tokenizer.from_file(PATH)
    return lambda t: [*k.encode(t or "", add_special_tokens=False).ids, 2]


def brute(rows, whole):
    out, start = [], 0
    for d, t in rows:
        ids = whole(t)
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_words_give_the_ids_of_the_text(whole, small):
    texts = ODD + [r.text for r in small.limit(60).collect()]
    got = [[*map(int, x), 2] for x in V.WordEncoder(PATH).encode([t.encode() for t in texts])]
    assert got == [whole(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 2048, 5000])
def test_matrix(n):
    rng = np.random.default_rng(n)
    x = rng.choice(np.array([0, 1, 2, 3, 900, 49407], np.uint16), n)
    m = V.WaveletMatrix.of(x, 16)
    m = V.WaveletMatrix.unpacked(n, *m.packed())
    assert (m.tokens() == x).all()
    for i in rng.integers(0, n, 40) if n else []:
        assert m.access(int(i)) == x[i]
    for t in (0, 3, 900, 49407, 5, 1 << 20):
        assert m.rank(t, n) == (x == t).sum() and m.rank(t, n // 2) == (x[: n // 2] == t).sum()
        assert (m.positions(t) == np.flatnonzero(x == t)).all()


@pytest.mark.parametrize("shard_tokens", [1, 3000, 1 << 22])
def test_round_trip(spark, small, whole, shard_tokens):
    rows = sorted((r.doc_id, r.text) for r in small.collect())
    got = V.encoded_documents(small.repartition(7), shard_tokens=shard_tokens).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(rows, whole)


def test_lookup(spark, small, whole):
    path = scratch_path(spark, "wavelet-test")
    V.write_shards(small, path, shard_tokens=5000)
    rows = {r.doc_id: whole(r.text) for r in small.collect()}
    token = rows[0][3]
    assert {tuple(r) for r in V.occurrences(spark, path, token).collect()} == {
        (d, i) for d, ids in rows.items() for i, t in enumerate(ids) if t == token
    }
    counts = {r.token: r.n for r in V.token_counts(spark, path, [token, 2]).collect()}
    assert counts == {t: sum(ids.count(t) for ids in rows.values()) for t in (token, 2)}


def test_slices_give_the_ids_of_whole_texts(whole, small):
    texts = [r.text or "" for r in small.collect()][:60] + ["", " ", "x" * 5000, "one\ttwo\n" * 900, " a" * 3000]
    encoder = V.WordEncoder(PATH)
    data = [t.encode() for t in texts]
    want = [x.tolist() for x in encoder.encode(data)]
    for most in (1, 7, 1000, 1 << 20):
        assert [x.tolist() for x in encoder.encode_slices(data, most)] == want
    assert [w + [2] for w in want] == [list(map(int, whole(t))) for t in texts]


def test_hard_rows(hard, whole):
    got = sorted((tuple(r) for r in V.encoded_documents(hard).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 1, 2, 3, 4, 6, 7, 8, 9]
    texts = {r.doc_id: r.text for r in hard.collect()}
    assert got == brute([(d, texts[d]) for d, *_ in got], whole)


def test_no_rows(none):
    assert V.encoded_documents(none).count() == 0


class Asked(dict):
    """A dictionary that counts how often it is asked."""

    times = 0

    def get(self, *key):
        self.times += 1
        return super().get(*key)


def test_a_word_of_a_slice_is_looked_up_once(whole):
    texts = [" The cat  and\tthe cat, é été\n", "", None, "and and", "x" * 40] * 300
    data = [(t or "").encode() for t in texts]
    encoder = V.WordEncoder(PATH)
    want = [x.tolist() for x in encoder.encode(data)]
    assert [w + [2] for w in want] == [whole(t) for t in texts]
    encoder.memory = Asked(encoder.memory)
    assert [x.tolist() for x in encoder.encode(data)] == want
    assert encoder.memory.times <= 10


def test_words_with_closing_signs_go_by_piece(whole):
    encoder = V.WordEncoder(PATH)
    words = [w + s for w in ("are", "The", "ÉTÉ", "naïve", "straße") for s in ("###", "$$$", ".***", ",%%%", "&&&", "!#*$%&", "", ".")]
    for w in words:
        ids = encoder._of_pieces(w.encode())
        assert ids is not None and [*map(int, np.frombuffer(ids, encoder.kind)), 2] == whole(w)
    for w in ("", "###", "it's", "a1", "x#y", "Āa", "<|endoftext|>"):
        assert encoder._of_pieces(w.encode()) is None
