"""Words, word hashes and n-gram hashes of whole Arrow batches, as numpy arrays.

Every operator that hashes text goes through these helpers, inside a task, over
the Arrow batches Spark hands to ``mapInArrow``.  A batch is cut into chunks by
bytes, so memory follows ``max_bytes`` (or the longest single text), not the
number of rows in a batch.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; because those
separators are ASCII, working on UTF-8 bytes gives the same words as working on
code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 64


def mix(a: np.ndarray, b: np.ndarray | np.uint64 | int = 0) -> np.ndarray:
    """A 64-bit hash of the ordered pair (a, b), element by element."""
    h = a + np.uint64(0x2545F4914F6CDD1D)
    h ^= h >> _S32
    h *= _MUL
    h ^= b if isinstance(b, np.ndarray) else np.uint64(b)
    h ^= h >> np.uint64(29)
    h *= _MUL2
    h ^= h >> _S32
    return h


@dataclass
class Words:
    """Words of some texts, text after text; ``of`` holds the first word's index for each text, and the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray
    first_byte: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.of)

    def hashes(self) -> np.ndarray:
        length = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
        h = mix(length.astype(np.uint64))
        at, left, rows = self.start, length, None
        while len(at):
            lane = lanes[at] & KEEP[np.minimum(left, 8)]
            if rows is None:
                h = mix(h, lane)
            else:
                h[rows] = mix(h[rows], lane)
            more = np.flatnonzero((left > 8) & ((length if rows is None else length[rows]) <= LONG_WORD))
            rows = more if rows is None else rows[more]
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(length > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return h

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a[i] and b[i] have the same bytes, for each i."""
        size = self.end - self.start
        out = size[a] == size[b]
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
        at, rows = 0, np.flatnonzero(out)
        while len(rows):
            keep = KEEP[np.minimum(size[a[rows]] - at, 8)]
            out[rows] = ((lanes[self.start[a[rows]] + at] ^ lanes[self.start[b[rows]] + at]) & keep) == 0
            at += 8
            rows = rows[out[rows] & (size[a[rows]] > at)]
        return out

    def windows(self, k: int) -> np.ndarray:
        """True for each word at which k words of the same text begin."""
        return np.arange(len(self.start)) + k <= np.repeat(self.of[1:], self.n)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """At i, a hash of the k hashes from i on; entries within k-1 of the end are of no use."""
    out, at, width, run = None, 0, 1, h
    while True:
        if k & width:
            part = np.roll(run, -at) if at else run
            out = mix(part, np.uint64(k)) if out is None else mix(out, part)
            at += width
        if at >= k:
            return out
        run, width = mix(run, np.roll(run, -width)), width * 2


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offset of each value, and of the end; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separator: np.ndarray = _SEPARATOR) -> Words:
    """The words of some texts; separator: for each byte whether it is none of a word."""
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), offsets)
    sep = separator[data]
    before = np.empty(len(sep) + 1, bool)
    before[0] = before[-1] = True
    before[1:] = sep
    after = before[1:].copy()
    after[:-1] = sep[1:]
    after[-1] = True
    before = before[:-1].copy()
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    start = np.flatnonzero(~sep & before)
    end = np.flatnonzero(~sep & after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose texts have at most max_bytes (or that are one row), with the texts' bytes and offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        row, rows = 0, batch.num_rows
        while row < rows:
            to = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
            to = min(rows, max(row + 1, to))
            yield batch.slice(row, to - row), data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
            row = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        # a C library without malloc_trim gives memory back by itself or not at all
        pass


def longs(h: np.ndarray) -> pa.Array:
    """uint64 hashes as Spark's signed longs."""
    return pa.array(h.view(np.int64))


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))
