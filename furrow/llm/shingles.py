"""Words and word shingles of Arrow text columns as 64-bit hashes, in NumPy.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A to Z lower-cased. The
hash of a word is a polynomial of random values of its bytes modulo 2**64; that of a
shingle mixes the hashes of its words. Texts are taken in slices of about ``SLICE`` bytes,
so the memory in use does not follow the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
PLACE = _RNG.integers(1, 2**62, 64, dtype=np.uint64) * _U(2) + _U(1)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)
IN_WORD = np.ones(256, bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False
# letters, digits and all bytes of code points beyond ASCII
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, n), _powers(_INVERSE, n)


_TABLES = _Tables()


def text_slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows of up to ``most`` bytes, one row at least."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def word_hashes(data: np.ndarray, offsets: np.ndarray, of: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, runs of bytes in ``of``, in order, and how many come before each row and the end."""
    inside = of[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    before[offsets] = False  # a row begins anew
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(data) + 1, bool)
    after[:-1] = inside
    after[-1] = False
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    _TABLES.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * _TABLES.up[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _TABLES.down[starts]
    return mix(hashes), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """Per row its sorted distinct shingle hashes; a text of fewer words is one shingle."""
    words, at = word_hashes(data, offsets)
    total = len(words) - size + 1
    grams = np.zeros(max(total, 0), np.uint64)
    for k in range(size):
        grams += words[k : k + len(grams)] * PLACE[k]
    grams = mix(grams)
    for a, b in zip(at[:-1], at[1:]):
        n = b - a
        if n >= size:
            yield np.unique(grams[a : b - size + 1])
        elif n:
            yield mix(np.array([np.sum(words[a:b] * PLACE[8 : 8 + n])], np.uint64) + _U(n))
        else:
            yield np.empty(0, np.uint64)
