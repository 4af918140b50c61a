"""Token ids of documents as wavelet matrices, one compressed file for each shard.

Documents are range-partitioned by ``doc_id`` and encoded in that order; a shard is closed
before the document that would take it above ``shard_tokens``. Each shard is one Parquet file
of one row, written by Spark, so that a lost task leaves nothing behind: the ids and
lengths of its documents, and for each bit of a token id, highest first, a bit-plane
with its number of zeros and running counts of ones, both compressed. Tokens are reordered from plane to
plane, zeros first, which is what makes access, counting (rank) and occurrence lookup
(select) possible without unpacking the sequence.

Encoding works on distinct words: the tokenizer's pre-tokenizer cuts at white space, so a
text's ids are those of its words one after another. Arrow finds the distinct words of about ``SLICE`` bytes of
text, each is looked up once, and Arrow puts their ids in the places of the words. A word of letters and closing signs goes to the model
piece by piece, if that is seen to give the tokenizer's own ids. A bounded memory of words is kept for each Python worker; texts
longer than a slice are cut between words.

A null text is empty and has the end id only. Documents of null id come first. Rows of equal
id are separate documents, in the order of a hash of their text. An empty table gives no file and an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.session import scratch_path

SHARD_TOKENS = 1 << 22
END_ID = 2
COUNT_EVERY = 2048  # bits between two running counts
WORDS_KEPT = 1_200_000  # a worker's memory, some 200 bytes a word
SLICE = 1 << 22  # bytes of text whose words are held at a time
SHARD_SCHEMA = (
    "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, "
    "zeros array<long>, planes array<binary>, counts array<binary>"
)
SEPARATOR = "\x01"
# letters that stand for themselves in NFC, and signs that make a piece of their own after them
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
SIGNS = b".,;:!?#*$%&"
BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


class WaveletMatrix:
    """Bit-planes of a sequence, highest bit first."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], counts: list[np.ndarray]) -> None:
        self.n, self.planes, self.zeros, self.counts = n, planes, zeros, counts

    @classmethod
    def of(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, counts = [], [], []
        x = tokens
        for k in range(bits - 1, -1, -1):
            ones = (x & x.dtype.type(1 << k)).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            counts.append(_running(planes[-1]))
            zeros.append(len(x) - int(np.count_nonzero(ones)))
            down = np.empty_like(x)
            np.compress(~ones, x, out=down[: zeros[-1]])
            np.compress(ones, x, out=down[zeros[-1] :])
            x = down
        return cls(len(tokens), planes, zeros, counts)

    def tokens(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        out = np.zeros(self.n, np.uint32)
        for k, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, np.uint32)
            up[~ones] = out[:z]
            up[ones] = out[z:] | np.uint32(1 << k)
            out = up
        return out

    def _ones(self, k: int, i: int) -> int:
        """Ones before position i of a plane."""
        block, plane = i // COUNT_EVERY, self.planes[k]
        first = block * (COUNT_EVERY // 8)
        whole = int(np.bitwise_count(plane[first : i // 8]).sum())
        rest = int(plane[i // 8] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0
        return int(self.counts[k][block]) + whole + rest

    def access(self, i: int) -> int:
        value = 0
        for k, z in enumerate(self.zeros):
            bit = int(self.planes[k][i // 8] >> (i % 8)) & 1
            i = z + self._ones(k, i) if bit else i - self._ones(k, i)
            value = 2 * value + bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences before i lie below the last plane."""
        low, high = 0, i
        for k, z in enumerate(self.zeros):
            a, b = self._ones(k, low), self._ones(k, high)
            if token >> (len(self.zeros) - 1 - k) & 1:
                low, high = z + a, z + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before position i."""
        if token < 0 or token >> len(self.zeros):
            return 0
        low, high = self._range(token, i)
        return high - low

    def positions(self, token: int) -> np.ndarray:
        """All positions of the token: its range below the last plane, carried up by select."""
        if token < 0 or token >> len(self.zeros):
            return np.empty(0, np.int64)
        low, high = self._range(token, self.n)
        at = np.arange(low, high)
        for k in range(len(self.zeros) - 1, -1, -1):
            if not len(at):
                break
            ones = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            bit = token >> (len(self.zeros) - 1 - k) & 1
            at = np.flatnonzero(ones)[at - self.zeros[k]] if bit else np.flatnonzero(~ones)[at]
        return np.sort(at)

    def packed(self) -> tuple[list[int], list[bytes], list[bytes]]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        return self.zeros, [press(p.tobytes()) for p in self.planes], [press(c.tobytes()) for c in self.counts]

    @classmethod
    def unpacked(cls, n: int, zeros: list[int], planes: list[bytes], counts: list[bytes]) -> WaveletMatrix:
        import zstandard

        get = lambda b, kind: np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)
        return cls(n, [get(p, np.uint8) for p in planes], zeros, [get(c, np.uint32) for c in counts])


def _running(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of ``COUNT_EVERY`` bits, one more entry for the end."""
    size = COUNT_EVERY // 8
    padded = np.zeros(-(-len(plane) // size) * size, np.uint8)
    padded[: len(plane)] = plane
    per = np.bitwise_count(padded.reshape(-1, size)).sum(axis=1, dtype=np.uint32)
    return np.r_[np.uint32(0), np.cumsum(per, dtype=np.uint32)]


def _byte_signs() -> list[str]:
    """The characters by which byte-level vocabularies name bytes: printable ones name themselves, others follow 255."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


BYTE_SIGNS = _byte_signs()


class WordEncoder:
    """Ids of whole texts through a memory of words; see the module's docstring."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.bits = max(1, top.bit_length())
        self.kind, self.code = (np.uint16, "H") if self.bits <= 16 else (np.uint32, "I")
        self.mark = self._encoded(SEPARATOR)
        self.memory: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.kept = WORDS_KEPT
        self.by_piece = self._pieces_agree()

    def _encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _pieces_agree(self) -> bool:
        """Whether letters and signs may go to the model on their own: tried on every letter and sign there is."""
        letters = [chr(c) for c in range(0x41, 0x100) if PLAIN.fullmatch(chr(c))]
        probes = [a + b for a, b in zip(letters, letters[7:] + letters[:7])]
        probes += ["".join(letters[k : k + 9]) + m for k in range(0, len(letters), 5) for m in (".", ",", ";", ":", "!!", "?!", "...")]
        signs = SIGNS.decode()
        probes += [letters[k % len(letters)] + a + b for k, a in enumerate(signs) for b in ["", *signs, ".***"]]
        probes += ["The", "isn", "s", "ll,", "ve", "DON.", "Straße", "für,", "ÉÉÉ!", "naïvement;"]
        try:
            return all(self._of_pieces(w.encode()) == np.array(self._encoded(w), self.kind).tobytes() for w in probes)
        except (AttributeError, TypeError, ValueError):
            return False

    def _of_piece(self, piece: bytes) -> bytes:
        """Ids of small letters, or of signs, alone."""
        ids = self.memory.get(piece) or self.older.get(piece)
        if ids is None:
            shown = piece.decode() if piece.isascii() else "".join([BYTE_SIGNS[b] for b in piece])
            ids = array(self.code, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
            self.memory[piece] = ids
        return ids

    def _of_pieces(self, word: bytes) -> bytes | None:
        letters = word.rstrip(SIGNS)
        if letters.isalpha():  # bytes know ASCII letters only
            small = letters.lower()
        else:
            shown = letters.decode()
            if not PLAIN.fullmatch(shown):
                return None
            small = shown.lower().encode()
        ids = self._of_piece(small)
        return ids if len(letters) == len(word) else ids + self._of_piece(word[len(letters) :])

    def _learn(self, words: list[bytes]) -> None:
        if self.by_piece:
            rest = []
            for w in words:
                found = self._of_pieces(w)
                if found is None:
                    rest.append(w)
                else:
                    self.memory[w] = found
            words = rest
        plain = [w for w in words if SEPARATOR.encode() not in w] if len(self.mark) == 1 else []
        for k in range(0, len(plain), 100):
            part = plain[k : k + 100]
            ids = np.array(self._encoded(f" {SEPARATOR} ".join(w.decode() for w in part)), self.kind)
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(part) - 1:
                continue  # a word has the mark's id, too
            at = [0, *(cuts + 1), len(ids) + 1]
            for w, a, b in zip(part, at[:-1], at[1:]):
                self.memory[w] = ids[a : b - 1].tobytes()
        for w in words:
            if w not in self.memory:
                self.memory[w] = np.array(self._encoded(w.decode()), self.kind).tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if len(self.memory) > self.kept // 2:  # words met again move on to the new half, the others are forgotten
            self.memory, self.older = {}, self.memory
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))  # empty words beside outer blanks
        coded = split.values.dictionary_encode()
        words = _listed(coded.dictionary)
        ids = list(map(self.memory.get, words))
        new = []
        for w in [w for w, x in zip(words, ids) if x is None]:
            if w in self.older:
                self.memory[w] = self.older[w]
            else:
                new.append(w)
        self._learn(new)
        memory = self.memory
        ids = [memory[w] if x is None else x for w, x in zip(words, ids)]
        placed = pa.array(ids, pa.binary()).take(coded.indices)
        _, offsets, data = placed.buffers()
        tokens = np.frombuffer(data or b"", self.kind)
        ends = np.frombuffer(offsets, np.int32, len(placed) + 1) // tokens.itemsize
        at = ends[split.offsets.to_numpy()]
        for a, b in zip(at[:-1], at[1:]):
            yield tokens[a:b]

    def encode_slices(self, texts: Iterable[bytes], most: int = SLICE) -> Iterator[np.ndarray]:
        """Like ``encode``, but holds the words of about ``most`` bytes at a time; a longer text is cut between words."""
        some: list[bytes] = []
        held = 0
        for text in texts:
            if some and held + len(text) > most:
                yield from self.encode(some)
                some, held = [], 0
            if len(text) <= most:
                some.append(text)
                held += len(text)
            else:
                yield np.concatenate([x for part in _cut(text, most) for x in self.encode([part])])
        if some:
            yield from self.encode(some)


def _listed(words: pa.Array) -> list[bytes]:
    """The words, none of which has a blank, as bytes; an array's own list is made several times slower."""
    if not len(words):
        return []
    row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(row, " ")[0].as_buffer().to_pybytes().split(b" ")


def _each(texts: pa.Array) -> Iterator[bytes]:
    for k in range(0, len(texts), 256):
        for t in texts.slice(k, 256).to_pylist():
            yield (t or "").encode()


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """The text in pieces of ``most`` bytes and the rest of the word they end in."""
    start = 0
    while start < len(text):
        blank = BLANK.search(text, start + most)
        end = blank.start() if blank else len(text)
        yield text[start:end]
        start = end


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _shards(vocabulary: str, end_id: int, shard_tokens: int, words_kept: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = _encoder(public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary)
        encoder.kept = words_kept
        end = np.array([end_id], encoder.kind)
        seq, docs, pieces, held = 0, [], [], 0

        def close() -> pa.RecordBatch:
            sequence = np.concatenate(pieces)
            zeros, planes, counts = WaveletMatrix.of(sequence, encoder.bits).packed()
            row = {
                "part": part, "seq": seq, "n_tokens": len(sequence), "doc_ids": docs, "lengths": [len(p) for p in pieces],
                "zeros": zeros, "planes": planes, "counts": counts,
            }
            return pa.RecordBatch.from_pylist([row], schema=SHARD_ARROW)

        for batch in batches:
            for d, tokens in zip(batch.column(0).to_pylist(), encoder.encode_slices(_each(batch.column(1)))):
                if held and held + len(tokens) + 1 > shard_tokens:
                    yield close()
                    seq, docs, pieces, held = seq + 1, [], [], 0
                docs.append(d)
                pieces.append(np.concatenate([tokens, end]))
                held += len(tokens) + 1
        if docs:
            yield close()

    return build


SHARD_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary())),
    ]
)


def write_shards(
    docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
    words_kept: int = WORDS_KEPT,
) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) in ascending order of id into shard files below ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    shards = ordered.mapInArrow(_shards(vocabulary, end_id, shard_tokens, words_kept), SHARD_SCHEMA)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, shard_start): tokens before each shard. Only counters are read and moved."""
    sizes = shards.select("part", "seq", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    inside = sizes.withColumn("inside", before(Window.partitionBy("part").orderBy("seq")))
    return inside.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("inside")).alias("shard_start"))


def _matrix(batch: pa.RecordBatch, k: int) -> tuple[dict, WaveletMatrix]:
    row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
    return row, WaveletMatrix.unpacked(row["n_tokens"], row["zeros"], row["planes"], row["counts"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "part", "seq", "inside", "n_tokens", "ids_crc32"]
    for batch in batches:
        for k in range(batch.num_rows):
            row, matrix = _matrix(batch, k)
            data = matrix.tokens().astype("<u4")
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
            n = len(crc)
            columns = [
                pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(n, row["part"]), pa.int32()), pa.array(np.full(n, row["seq"]), pa.int32()),
                pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: its place among all tokens, their number and checksum."""
    shards = read_shards(spark, path)
    docs = shards.mapInArrow(_documents, "doc_id long, part int, seq int, inside long, n_tokens long, ids_crc32 long")
    placed = docs.join(shard_starts(shards), ["part", "seq"])
    return placed.select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences over all shards, by rank."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, matrix = _matrix(batch, k)
                n = [matrix.rank(t, row["n_tokens"]) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(n, pa.int64())], ["token", "n"])

    columns = read_shards(spark, path).select("n_tokens", "zeros", "planes", "counts")
    return columns.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, position) of every occurrence of a token, by select."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, matrix = _matrix(batch, k)
                at = matrix.positions(token)
                ends = np.cumsum(row["lengths"])
                doc = np.searchsorted(ends, at, "right")
                starts = ends - row["lengths"]
                ids = pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at - starts[doc], pa.int64())], ["doc_id", "position"])

    columns = read_shards(spark, path).select("n_tokens", "doc_ids", "lengths", "zeros", "planes", "counts")
    return columns.mapInArrow(find, "doc_id long, position long")


def encoded_documents(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", shard_tokens: int = SHARD_TOKENS, words_kept: int = WORDS_KEPT
) -> DataFrame:
    """Write ``docs`` to shard files in the shared folder and describe each document from them.

    ``words_kept`` bounds the words a Python worker remembers; fewer take less memory and more time.
    """
    path = scratch_path(docs.sparkSession, "wavelet")
    write_shards(docs, path, vocabulary, END_ID, shard_tokens, words_kept)
    return document_digests(docs.sparkSession, path)
