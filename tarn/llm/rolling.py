"""Fingerprints of words, word runs and byte strings, for many texts at once in numpy.

A text column arrives as one buffer of bytes with offsets. A fingerprint is a
polynomial modulo the prime 2**61 - 1: of a word in its pieces of seven bytes, of
a run of words in the fingerprints of its words. Two different inputs of k
coefficients agree for at most k of all bases, so that no kind of text collides
by its structure. Two lanes with bases of their own give 122 bits.

Short windows of bytes, whose candidates are compared byte by byte afterwards,
have a cheaper hash modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes of text worked on at once; only a single longer text goes beyond it.
SLICE_BYTES = 1 << 19

_BASE_BYTE = np.uint64(0x9E3779B97F4A7C1B)

PRIME = np.uint64(2**61 - 1)
# One base for each lane.
PIECE_BASES = (0x0B4F3A1C5D7E9263, 0x15C9E27A43B1D80F)
WORD_BASES = (0x1A6D42F9B3C5E871, 0x0E73B59D1F84A2C7)
PIECE_BYTES = 7
# Pieces of a word up to which all words are worked on together.
LONG_WORD = 16


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift, multiply)."""
    x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 11)
# A-Z as a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
_MASKS = np.array([2 ** (8 * n) - 1 for n in range(8)], np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to ``size``."""
    up = np.full(size + 1, base, np.uint64)
    down = np.full(size + 1, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(base: np.uint64, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As many powers as asked for, or more: sizes are rounded up to be reused."""
    return _powers(int(base), max(SLICE_BYTES, 1 << int(size).bit_length()))


class Prefix:
    """Sums up to each position, from which short windows of bytes get their hash.

    Not for stretches of 1,024 bytes or more: modulo 2**64 some of them collide.
    """

    def __init__(self, values: np.ndarray, base: np.uint64):
        up, self._down = powers(base, len(values))
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def rolling(self, width: int) -> np.ndarray:
        """The hash of every stretch of ``width`` values."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self._sums[width:] - self._sums[:n]) * self._down[:n]


def byte_prefix(data: np.ndarray) -> Prefix:
    return Prefix(_BYTE_VALUES[data], _BASE_BYTE)


def times(a: np.ndarray, b) -> np.ndarray:
    """Products modulo the prime of values below it, by halves of 31 and 30 bits."""
    half, rest = np.uint64(31), np.uint64(30)
    low, quarter = np.uint64(2**31 - 1), np.uint64(2**30 - 1)
    b = np.asarray(b, np.uint64)
    a_high, a_low, b_high, b_low = a >> half, a & low, b >> half, b & low
    middle = a_low * b_high + a_high * b_low
    whole = a_high * b_high * np.uint64(2) + (middle >> rest) + ((middle & quarter) << half) + a_low * b_low
    return reduced(whole)


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit value modulo the prime."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def run_fingerprints(values: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """The fingerprint of every ``width`` neighbours, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = WORD_BASES[lane]
    # ``done`` is a prefix of the bits of ``width``; ``out`` the fingerprints of so many.
    out, done = values, 1
    for bit in bin(width)[3:]:
        power = pow(base, done, int(PRIME))
        out = reduced(times(out[:-done], power) + out[done:])
        done *= 2
        if bit == "1":
            out = reduced(times(out[:-1], base) + values[done : done + len(out) - 1])
            done += 1
    return out[:n]


def fingerprint(values: np.ndarray, base: int) -> int:
    """That of a whole array, by halving it again and again."""
    while len(values) > 1:
        if len(values) % 2:
            values = np.concatenate((np.zeros(1, np.uint64), values))
        values = reduced(times(values[::2], base) + values[1::2])
        base = base * base % int(PRIME)
    return int(values[0]) if len(values) else 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first row, row after the last, bytes, offsets.

    A null text is empty. Runs hold at most ``limit`` bytes, or one text.
    """
    kind = pa.large_binary()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string() if pa.types.is_string(texts.type) else texts.type)
    texts = texts.cast(kind).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer or b"", np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        begin, end = offsets[first], offsets[last]
        yield first, last, data[begin:end], offsets[first : last + 1] - begin
        first = last


class Words:
    """The words of a run of texts: stretches of bytes other than white space.

    ``starts`` and ``ends`` are byte positions; ``first[i]`` is the number of
    the first word of text i, and ``first`` has one entry more than texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None):
        inside = ~IS_SPACE[data] if inside is None else inside
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        bounds = offsets[1:-1]
        bounds = bounds[(bounds > 0) & (bounds < len(data))]
        begins[bounds] = inside[bounds]
        stops[bounds - 1] = inside[bounds - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def fingerprints(self, data: np.ndarray, fold: bool = False, lane: int = 0, most: int | None = None) -> np.ndarray:
        """That of each word, or of its first ``most`` bytes; with ``fold``, A-Z count as a-z.

        The first coefficient is the length, the others are pieces of seven bytes.
        """
        data = FOLDED[data] if fold else data
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        lengths = self.ends - self.starts
        lengths = lengths if most is None else np.minimum(lengths, most)
        base, out = PIECE_BASES[lane], lengths.astype(np.uint64)
        pieces = -(-lengths // PIECE_BYTES)
        short = np.flatnonzero(pieces <= LONG_WORD)
        for k in range(int(pieces[short].max()) if len(short) else 0):
            at = short if k == 0 else short[pieces[short] > k]
            rest = np.minimum(lengths[at] - k * PIECE_BYTES, PIECE_BYTES)
            piece = eight[self.starts[at] + k * PIECE_BYTES] & _MASKS[rest]
            out[at] = reduced(times(out[at], base) + piece)
        for i in np.flatnonzero(pieces > LONG_WORD):
            begin, n = int(self.starts[i]), int(lengths[i])
            at = np.arange(0, n, PIECE_BYTES)
            piece = eight[begin + at] & _MASKS[np.minimum(n - at, PIECE_BYTES)]
            out[i] = fingerprint(np.concatenate((np.array([n], np.uint64), piece)), base)
        return out

    def hashes(self, data: np.ndarray, fold: bool = False, most: int | None = None) -> np.ndarray:
        """Fingerprints of one lane with their bits spread over 64."""
        return mix(self.fingerprints(data, fold, most=most), 3)

    def rows(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    least, size = values, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
