"""Words, lines and hashes of whole Arrow text columns, by NumPy on their UTF-8 bytes.

A text is never turned into Python objects word by word: the bytes of a column are classed by a
table of 256 entries, and words, windows and their 64-bit hashes come from array operations.
All the word classes in use treat every byte of a multi-byte character alike, so bytes do.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 2 << 20

SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: [^\x20\x09-\x0D]
NOT_SPACE = ~SPACES
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower(): digits, a-z and all beyond ASCII
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    return _LOWER[data]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if offsets is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def flat(column) -> pa.Array:
    """One Array of what may be a ChunkedArray."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) and column.num_chunks != 1 else column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in the named column, or one row."""
    at, _ = buffers(batch.column(name))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n, i + 65536)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """Words of the texts of a column: start and end bytes, and where each text's words begin."""

    def __init__(self, at: np.ndarray, data: np.ndarray, is_word: np.ndarray):
        mask = is_word[data]
        before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        full = at[1:] > at[:-1]
        before[at[:-1][full]] = False
        after[at[1:][full] - 1] = False
        self.at, self.data, self.mask = at, data, mask
        self.start, self.end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
        #: words[first[i]:first[i + 1]] are those of text i
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def place(self) -> np.ndarray:
        """For each word its place in its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)

    def hashes(self) -> np.ndarray:
        return spans(self.data, self.start, self.end)

    def windows(self, size: int) -> np.ndarray:
        """For each word whether ``size`` words begin there in its text."""
        return self.place() + size <= np.repeat(self.count, self.count)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (SplitMix64's finish)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], by one pass of prefix sums; equal bytes give equal hashes anywhere."""
    n = len(data)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _powers(_BASE, n), out=prefix[1:])
    value = (prefix[end] - prefix[start]) * _powers(_INVERSE, n + 1)[start]
    return mix(value ^ (end - start).astype(U64) * U64(_STEP))


def rolled(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of each run of ``size`` items; len(hashes) - size + 1 of them, regardless of texts' ends."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    step = U64((_STEP + 2 * salt * 0x9E3779B97F4A7C15) & (1 << 64) - 1 | 1)
    for i in range(size):
        out *= step
        out += hashes[i : i + n]
    return mix(out ^ U64((size + 977 * salt) & 0xFFFF))


def covered(starts: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n items lie in any of the runs [start, start + size)."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return np.cumsum(edges[:-1]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
