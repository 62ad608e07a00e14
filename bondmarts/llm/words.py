"""Words, word hashes and shingles of whole Arrow batches of texts, as numpy arrays.

A word is a run of bytes other than space and \\x09-\\x0D of the UTF-8 text, after lower-casing A-Z only, so it equals
the pattern `[^\\x20\\x09-\\x0D]+`. Words are hashed without cutting the text into Python strings: with P the running sum of
byte * B^position (mod 2^64, B odd and so invertible), the hash of bytes s..e is (P[e] - P[s]) * B^-s, then mixed.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)
# Odd multipliers that tell the places of a shingle apart.
_PLACES = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that separate words when punctuation does not belong to them: ASCII without letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, U), np.ones(1, U)]
#: Bytes of text that are turned into arrays at a time; a longer text is a chunk of its own.
CHUNK = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_B, _B_INVERSE)):
            table = np.full(max(n, 1 << 16), base, U)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=U)
    return _powers[0], _powers[1]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with about `size` bytes of text each; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, texts.slice(start, end - start)
        start = end


class Words:
    """Words of the texts of one chunk: byte spans, hashes, and the first word of every text in `at`."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = _SPACE):
        texts = texts.fill_null(b"") if texts.null_count else texts
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - first
        self.bytes = _LOWER[data]
        space = separators[data]
        begins = np.zeros(len(data) + 1, bool)  # a new text begins here, or the data ends
        begins[self.offsets] = True
        inner = ~space
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], after[-1] = True, True
            before[1:] = space[:-1] | begins[1:-1]
            after[:-1] = space[1:] | begins[1:-1]
        self.starts = np.flatnonzero(inner & before)
        self.ends = np.flatnonzero(inner & after) + 1
        self.at = np.searchsorted(self.starts, self.offsets)
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((self.bytes.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
        self._sums, self._down = sums, down
        raw = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.hashes = mix(raw + (self.ends - self.starts).astype(U) * _PLACES[1])

    def stems(self, size: int = 5) -> np.ndarray:
        """Hash of the first bytes of every word; it differs from that of a whole word."""
        ends = np.minimum(self.ends, self.starts + size)
        return mix((self._sums[ends] - self._sums[self.starts]) * self._down[self.starts] + _PLACES[4])

    def bare(self) -> np.ndarray:
        """Hash of every word without ASCII punctuation around it; a word of nothing else keeps it."""
        inner = np.append(np.flatnonzero(~PUNCTUATION[self.bytes]), len(self.bytes))
        starts = inner[np.searchsorted(inner, self.starts)]
        ends = inner[np.searchsorted(inner, self.ends) - 1] + 1
        none = starts >= self.ends
        starts, ends = np.where(none, self.starts, starts), np.where(none, self.ends, ends)
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(U) * _PLACES[1])

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]].tobytes()

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from every word on, across texts too; use it only where n words of one text follow."""
        m = max(len(self.hashes) - n + 1, 0)
        total = np.zeros(m, U)
        for i in range(n):
            total += self.hashes[i : i + m] * _PLACES[i % 5] * U(2 * (i // 5) + 1)
        return mix(total)

    def shingles(self, n: int = 5) -> Iterator[np.ndarray]:
        """Of each text the sorted distinct hashes of its n-word shingles; with fewer words, of the whole sequence."""
        grams = self.grams(n)
        for a, b in zip(self.at[:-1], self.at[1:]):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                total = np.full(1, b - a, U)
                for h in self.hashes[a:b]:
                    total = mix(total * _PLACES[0] + h)
                yield total
            else:
                yield np.zeros(0, U)


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text, row by row."""
    for _, part in chunks(texts):
        yield from Words(part).shingles(n)
