import hashlib
import random
import re

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from furrow.llm import infill as I

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (key, n, "plain", None, None, sha(text), sha(text)), text
    if h[3] % 100 < 20:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (key, n, form, len(prefix), len(middle), sha(out), sha(text)), out


def made(n, seed=5):
    rng = random.Random(seed)
    pool = ["ab", "Q", "é", "\n", " ", "<", "P>", "<S", ">", "漢字", "\U0001f600", "7", "x" * 30, "<M", "ı"]
    return [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 120)))) for i in range(n)]


@pytest.mark.parametrize("frame", [1, 3, 16, I.FRAME])
def test_against_brute_force(spark, frame):
    """Frames of any size, also those that cut through letter runs and beside markers."""
    rows = [*made(150), (200, "a" * 5000), (201, "a" * 700 + "é" * 300), (None, "no id here"), (202, None), (203, ""), (204, "has <S> in it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = I.pack_texts(docs, frame=frame)
    got = {r.doc_id: tuple(r) for r in I.digests(I.transformed(store)).collect()}
    texts = {r.doc_id: (r.form, r.text) for r in I.output_texts(I.transformed(store)).collect()}
    for key, text in rows:
        want, out = brute(key, text)
        assert got[key] == want
        assert texts[key] == (want[2], out)
    assert {r[2] for r in got.values()} == {"plain", "psm", "spm"}


def test_frames_are_independent_and_seekable(spark):
    rows = made(60, seed=8)
    store = I.pack_texts(spark.createDataFrame(rows, "doc_id long, text string"), frame=9)
    for r in store.collect():
        text = dict(rows)[r.doc_id]
        pieces = [zstandard.ZstdDecompressor().decompress(f).decode() for f in reversed(r.frames)][::-1]
        assert "".join(pieces) == text and r.n == len(UNIT.findall(text)) and r.n_chars == len(text)
        assert r.chars_before == [len("".join(pieces[:k])) for k in range(len(pieces))]
    got = {r.doc_id: r.part for r in I.unit_ranges(store, F.lit(3), F.least(F.col("n"), F.lit(11))).collect()}
    assert got == {i: "".join(UNIT.findall(t)[3:11]) for i, t in rows}


def test_only_cut_frames_are_decompressed(monkeypatch):
    text = ("word, " * 40_000).encode()
    n, chars, units, before, frames = I.pack(text, 1 << 12)
    read = []
    monkeypatch.setattr(I.Frames, "piece", lambda self, k, of=I.Frames.piece: read.append(k) or of(self, k))
    stored = I.Frames(frames)
    a, b = (stored.place(u, n, units, before)[0] for u in (1000, 60_000))
    out = I.assemble(stored, "psm", a, b, zstandard.ZstdCompressor())
    assert len(set(read)) <= 6 and len(frames) > 50
    assert sum(f is g for f in frames for g in out) >= len(frames) - 2


def test_restoring_uses_the_output_alone():
    packer = zstandard.ZstdCompressor()
    parts = {"psm": b"<P>one<<S>two<M>three", "spm": b"<S>two<P>one<<M>three"}
    for form, whole in parts.items():
        for size in (1, 2, 5, 100):
            output = I.Frames([packer.compress(whole[k : k + size]) for k in range(0, len(whole), size)])
            restored = b"".join(p for kind, p in I.stream_output(output, form) if kind == "restored")
            assert restored == b"one<threetwo"


def test_hard_rows(hard, none):
    got = I.digests(I.transformed(I.pack_texts(hard)))
    want = sorted((brute(r.doc_id, r.text)[0] for r in hard.collect()), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert I.digests(I.transformed(I.pack_texts(none))).collect() == []


def test_batches_stay_small():
    schema = pa.schema([("a", pa.int64())])
    sizes = [b.num_rows for b in I._batches(((I.FLUSH // 2, (k,)) for k in range(7)), schema)]
    assert sizes == [2, 2, 2, 1]


def test_query(spark):
    from furrow.llm.registry import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in QUERIES["op13_infill_frames"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {brute(r.doc_id, r.text)[0] for r in docs.collect()}
