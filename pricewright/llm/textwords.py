"""Words of a batch of texts as numpy arrays: positions and 64-bit hashes.

Texts are handled as UTF-8 bytes, many at a time.  Memory is about 60 bytes per byte of a
chunk; a chunk holds ``chunk_bytes`` of text, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 * 1024 * 1024

_U = np.uint64
#: Odd multipliers for word and window hashes, from a fixed seed.
_ODD = np.random.default_rng(20240131).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _table(separators: list[tuple[int, int]]) -> np.ndarray:
    """For each byte 1 if it belongs to a word."""
    table = np.ones(256, np.uint8)
    for first, last in separators:
        table[first : last + 1] = 0
    return table


#: Words between ASCII white space; words of ASCII letters, digits and all beyond ASCII.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@dataclass
class Words:
    """Words of several texts: word k is ``data[start[k]:end[k]]``, text d has words ``first[d]:first[d + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def left(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))

    def hashes(self, salt: int = 0) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, _U)
        powers, inverse = _powers(len(self.data), salt)
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        terms = (self.data.astype(_U) + _U(1)) * powers[: len(self.data)]
        terms *= np.cumsum(inside[:-1]).astype(_U)
        sums = np.add.reduceat(terms, self.start) * inverse[self.start]
        return mix(sums ^ (self.end - self.start).astype(_U))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if salt not in _tables or len(_tables[salt][0]) < n:
        base = int(_ODD[200 + salt])
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(min(1 << (n - 1).bit_length(), max(n, CHUNK_BYTES)), b, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _tables[salt] = (out[0], out[1])
    return _tables[salt]


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """For each start the hash of ``size`` consecutive word hashes; shorter by size - 1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k in range(size):
        out += words[k : k + n] * _ODD[64 * salt + k]
    return mix(out)


def chunks(batch: pa.RecordBatch, column: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``chunk_bytes`` of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + chunk_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null: empty."""
    kind = pa.large_binary()
    column = pc.fill_null(column.cast(kind), pa.scalar(b"", kind))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[offsets[d]:offsets[d + 1]]``; ``lower`` lower-cases A-Z."""
    if lower:
        data = _LOWER[data]
    inside = table[data]
    before = np.empty_like(inside)
    before[:1] = 0
    before[1:] = inside[:-1]
    bounds = offsets[offsets < len(data)]
    before[bounds] = 0
    start = np.flatnonzero(inside > before)
    after = np.empty_like(inside)
    after[-1:] = 0
    after[:-1] = inside[1:]
    after[bounds[bounds > 0] - 1] = 0
    end = np.flatnonzero(inside > after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in one of the intervals ``start <= i < end``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def starts_of_windows(words: Words, size: int) -> np.ndarray:
    """First words of the windows of ``size`` words that lie within one text."""
    return np.flatnonzero(words.left >= size)
