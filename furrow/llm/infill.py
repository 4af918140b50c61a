"""Fill-in-the-middle documents over seekable compressed frames.

A unit is a run of ASCII letters or any other single code point. ``pack_texts`` stores every text as
independent zstandard frames of about ``FRAME`` bytes, cut between code points, with the number of units and
code points that begin before each frame. A unit belongs to the frame in which it begins, so a letter run longer than
a frame needs no frame of its own. A place is found by decompressing the one frame that holds it.

``transformed`` draws two cuts and a form per document from the SHA-256 of its id and orders the parts:

* plain: the text, where it is empty or holds a marker, and for a share of the documents;
* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

Its output is again a list of frames: those inside a part are taken over as they are, only frames that a
cut goes through are written anew. ``digests`` streams the frames of the output in order, finds the markers in
the stream, and streams its parts in the order of the text, so the restored text comes from output and form
alone. At no time is more than one frame of a text decompressed in these steps, and nothing is shuffled.

Nulls: a null text is empty, a null id hashes as no digits. Rows are independent of each other, so repeated
rows and ids give repeated results. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.words import let

FRAME = 1 << 16
LEVEL = 3
FLUSH = 1 << 23  # bytes of frames per Arrow batch that a task hands on
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
STORE = "doc_id long, marked boolean, n long, n_chars long, units_before array<long>, chars_before array<long>, frames array<binary>"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def unit_starts(data: np.ndarray, after_letter: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a code point, and which begin a unit; ``after_letter`` tells of the byte before."""
    first = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    inside = np.empty(len(data), bool)
    inside[:1] = after_letter
    inside[1:] = letter[:-1]
    return first, first & ~(letter & inside)


def _frame_ends(data: np.ndarray, size: int) -> list[int]:
    ends, at = [], 0
    while at < len(data):
        at = min(at + size, len(data))
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        ends.append(at)
    return ends


def pack(text: bytes, size: int = FRAME, packer: zstandard.ZstdCompressor | None = None):
    """(units, code points, units before each frame, code points before each frame, frames)."""
    packer = packer or zstandard.ZstdCompressor(level=LEVEL)
    data = np.frombuffer(text, np.uint8)
    units = chars = at = 0
    units_before, chars_before, frames = [], [], []
    for end in _frame_ends(data, size):
        piece = data[at:end]
        first, starts = unit_starts(piece, bool(at and _LETTER[data[at - 1]]))
        units_before.append(units)
        chars_before.append(chars)
        frames.append(packer.compress(piece))
        units += int(np.count_nonzero(starts))
        chars += int(np.count_nonzero(first))
        at = end
    return units, chars, units_before, chars_before, frames


class Frames:
    """One stored text: the bytes of its frames in order, and how many bytes come before each."""

    def __init__(self, frames: list, unpacker: zstandard.ZstdDecompressor | None = None) -> None:
        self.frames = frames
        self.unpacker = unpacker or zstandard.ZstdDecompressor()
        sizes = [zstandard.frame_content_size(f) for f in frames]
        self.before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def piece(self, k: int) -> bytes:
        return self.unpacker.decompress(self.frames[k])

    def stream(self, start: int, stop: int) -> Iterator[bytes]:
        """The bytes from ``start`` to ``stop``, one frame at a time."""
        k = int(np.searchsorted(self.before, start, "right")) - 1
        while start < stop:
            piece = self.piece(k)[start - int(self.before[k]) : stop - int(self.before[k])]
            yield piece
            start += len(piece)
            k += 1

    def place(self, unit: int, n: int, units_before: np.ndarray, chars_before: np.ndarray) -> tuple[int, int]:
        """Bytes and code points before a unit; those of the whole text for unit ``n``."""
        if unit >= n:
            return len(self), -1
        k = int(np.searchsorted(units_before, unit, "right")) - 1
        data = np.frombuffer(self.piece(k), np.uint8)
        # a frame may begin inside a run of letters that the frame before it counts
        after = bool(k) and _LETTER[self.piece(k - 1)[-1]] and bool(len(data)) and bool(_LETTER[data[0]])
        first, starts = unit_starts(data, bool(after))
        at = int(np.flatnonzero(starts)[unit - int(units_before[k])])
        return int(self.before[k]) + at, int(chars_before[k]) + int(np.count_nonzero(first[:at]))


def assemble(text: Frames, form: str, first: int, second: int, packer: zstandard.ZstdCompressor) -> list:
    """Frames of the output, given the bytes before the two cuts; whole frames are not touched."""

    def part(start: int, stop: int) -> Iterator:
        while start < stop:
            k = int(np.searchsorted(text.before, start, "right")) - 1
            lo, hi = int(text.before[k]), int(text.before[k + 1])
            if start == lo and stop >= hi:
                yield text.frames[k]
            else:
                yield packer.compress(text.piece(k)[start - lo : stop - lo])
            start = min(stop, hi)

    if form == PLAIN:
        return list(text.frames)
    mark = packer.compress
    prefix, middle, suffix = part(0, first), part(first, second), part(second, len(text))
    if form == PSM:
        return [mark(PREFIX), *prefix, mark(SUFFIX), *suffix, mark(MIDDLE), *middle]
    return [mark(SUFFIX), *suffix, mark(PREFIX), *prefix, mark(MIDDLE), *middle]


def _find_marks(pieces: Iterable[bytes], marks: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
    """Hands on the pieces; with each, where the marks found so far begin, one after the other."""
    found: list[int] = []
    tail, offset = b"", 0
    for piece in pieces:
        window = tail + piece
        base, at = offset - len(tail), 0
        while len(found) < len(marks):
            at = window.find(marks[len(found)], at)
            if at < 0:
                break
            found.append(base + at)
            at += len(marks[0])
        offset += len(piece)
        tail = window[max(at, len(window) - 2) :] if at >= 0 else window[-2:]
        yield piece, found


def stream_output(output: Frames, form: str) -> Iterator[tuple[str, bytes]]:
    """Pieces of the output in order, tagged ``output``, then those of the text rebuilt from it, ``restored``."""
    if form == PLAIN:
        for piece in output.stream(0, len(output)):
            yield "output", piece
            yield "restored", piece
        return
    order = [PREFIX, SUFFIX, MIDDLE] if form == PSM else [SUFFIX, PREFIX, MIDDLE]
    found: list[int] = []
    for piece, found in _find_marks(output.stream(0, len(output)), order):
        yield "output", piece
    ends = [*found[1:], len(output)]
    spans = {mark: (at + len(mark), end) for mark, at, end in zip(order, found, ends)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        for piece in output.stream(*spans[mark]):
            yield "restored", piece


def _batches(rows: Iterable[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, each with its size, as batches of about ``FLUSH`` bytes."""
    held, size = [], 0
    for weight, row in rows:
        held.append(row)
        size += weight + 64
        if size >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _stored_rows(batch: pa.RecordBatch, at: int) -> Iterator[list]:
    """Per row its frames as buffers, without a copy."""
    column = batch.column(at)
    offsets, values = column.offsets.to_pylist(), column.values
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield [memoryview(values[k].as_buffer()) for k in range(a, b)]


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> DataFrame:
    """One row per text: its id, whether it holds a marker, its counts and its frames (``STORE``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.contains(text, F.lit("<P>")) | F.contains(text, F.lit("<S>")) | F.contains(text, F.lit("<M>"))
    longs = pa.list_(pa.int64())
    schema = pa.schema([
        ("doc_id", pa.int64()), ("marked", pa.bool_()), ("n", pa.int64()), ("n_chars", pa.int64()),
        ("units_before", longs), ("chars_before", longs), ("frames", pa.list_(pa.binary())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)

        def rows():
            for batch in batches:
                for key, held, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                    packed = pack(text.as_buffer(), frame, packer)
                    yield sum(map(len, packed[4])), (key.as_py(), held.as_py(), *packed)

        yield from _batches(rows(), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), marked.alias("marked"), text.cast("binary").alias("text")).mapInArrow(run, STORE)


def _draw(key: Column) -> Column:
    """The first four groups of eight hex digits of the SHA-256 of ``1:`` and the id, as numbers."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    group = lambda h, k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
    return let(digest, lambda h: F.array(*[group(h, k) for k in range(4)]))


def plan_cuts(store: DataFrame) -> DataFrame:
    """Adds ``form`` and the units before the first and the second cut, ``first`` and ``second``."""
    drawn = store.withColumn("__h", _draw(F.col("doc_id")))
    h = lambda k: F.get(F.col("__h"), k)
    plain = (F.col("n") == 0) | F.col("marked") | (h(2) % 100 >= PLAIN_FROM)
    return drawn.withColumns({
        "form": F.when(plain, PLAIN).when(h(3) % 100 < SPM_BELOW, SPM).otherwise(PSM),
        "first": F.least(h(0) % (F.col("n") + 1), h(1) % (F.col("n") + 1)),
        "second": F.greatest(h(0) % (F.col("n") + 1), h(1) % (F.col("n") + 1)),
    }).drop("__h")


def transformed(store: DataFrame) -> DataFrame:
    """Per stored text: ``doc_id``, ``n``, ``form``, code points of prefix and middle, and the frames of the output."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
        ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("frames", pa.list_(pa.binary())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, unpacker = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

        def one(key, n, n_chars, form, first, second, units_before, chars_before, frames):
            text = Frames(frames, unpacker)
            if form == PLAIN:
                return key, n, form, None, None, assemble(text, form, 0, 0, packer)
            a, chars_a = text.place(first, n, units_before, chars_before)
            b, chars_b = text.place(second, n, units_before, chars_before)
            chars_a, chars_b = (n_chars if c < 0 else c for c in (chars_a, chars_b))
            return key, n, form, chars_a, chars_b - chars_a, assemble(text, form, a, b, packer)

        def rows():
            for batch in batches:
                plain = [batch.column(k).to_pylist() for k in range(8)]
                for values, frames in zip(zip(*plain), _stored_rows(batch, 8)):
                    row = one(*values, frames)
                    yield sum(map(len, row[-1])), row

        yield from _batches(rows(), schema)

    columns = ["doc_id", "n", "n_chars", "form", "first", "second", "units_before", "chars_before", "frames"]
    return plan_cuts(store).select(*columns).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"
    )


def digests(outputs: DataFrame) -> DataFrame:
    """``outputs`` with the SHA-256 of the output and of the text rebuilt from it in place of the frames."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            found = {"output": [], "restored": []}
            for form, frames in zip(batch.column(2).to_pylist(), _stored_rows(batch, 5)):
                sums = {"output": hashlib.sha256(), "restored": hashlib.sha256()}
                for kind, piece in stream_output(Frames(frames, unpacker), form):
                    sums[kind].update(piece)
                for kind, value in sums.items():
                    found[kind].append(value.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found["output"]), pa.array(found["restored"])], schema=schema)

    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return outputs.select(*columns, "frames").mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    )


def output_texts(outputs: DataFrame) -> DataFrame:
    """The training texts themselves: ``doc_id``, ``form`` and ``text``."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()

        def rows():
            for batch in batches:
                for key, form, frames in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _stored_rows(batch, 2)):
                    text = b"".join(unpacker.decompress(f) for f in frames)
                    yield len(text), (key, form, text.decode())

        yield from _batches(rows(), schema)

    return outputs.select("doc_id", "form", "frames").mapInArrow(run, "doc_id long, form string, text string")


def unit_ranges(store: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Per stored text the part from unit ``start`` up to ``stop``, read from the frames that hold it: ``doc_id``, ``part``."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()

        def rows():
            for batch in batches:
                plain = [batch.column(k).to_pylist() for k in range(6)]
                for (key, n, a, b, units, chars), frames in zip(zip(*plain), _stored_rows(batch, 6)):
                    text = Frames(frames, unpacker)
                    places = [text.place(min(max(u, 0), n), n, units, chars)[0] for u in (a, b)]
                    part = b"".join(text.stream(*places))
                    yield len(part), (key, part.decode())

        yield from _batches(rows(), schema)

    picked = store.select("doc_id", "n", start.cast("long").alias("__a"), stop.cast("long").alias("__b"), "units_before", "chars_before", "frames")
    return picked.mapInArrow(run, "doc_id long, part string")
