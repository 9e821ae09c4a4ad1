"""Words, word n-grams and winnowing over whole Arrow batches with numpy.

A word is a run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``. UTF-8 never uses these bytes inside
another character, so the work is done on the raw bytes of a column, a quarter of a megabyte at a time, and the
memory a task needs follows the size of one Arrow batch and not of the table.

Hashes are 64 bits wide and depend on the words alone: the same words give the same hash in any
document, batch or executor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
# Odd multipliers of the rolling hashes (any odd numbers do).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = _Powers(BYTE_BASE)
_WORD_POWERS = _Powers(WORD_BASE)


@dataclass
class Words:
    """The words of a batch: ``first[d]:first[d + 1]`` are those of document d."""

    hashes: np.ndarray  # uint64
    start: np.ndarray  # byte offsets into ``data``
    end: np.ndarray
    first: np.ndarray  # int64, one more than documents
    data: np.ndarray  # uint8, as read

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """All words of the texts of a column; A-Z only are lower-cased, and only if asked for."""
    data, offsets = text_bytes(column)
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(data):
        stop = _cut(data, offsets, at)
        h, s, e = _chunk(data[at:stop], offsets[(offsets > at) & (offsets < stop)] - at, lower)
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return Words(
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        start,
        np.concatenate(ends) if ends else np.zeros(0, np.int64),
        np.searchsorted(start, offsets),
        data,
    )


def _cut(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """Where a chunk that begins at ``at`` ends: never inside a word."""
    stop = at + CHUNK_BYTES
    if stop >= len(data):
        return len(data)
    end_of_document = offsets[np.searchsorted(offsets, stop)]
    while stop < end_of_document:
        spaces = np.flatnonzero(_SPACE[data[stop : min(stop + 65536, end_of_document)]])
        if len(spaces):
            return stop + int(spaces[0])
        stop += 65536
    return int(end_of_document)


def _chunk(data, breaks, lower):
    plain = _LOWER[data] if lower else data
    inside = ~_SPACE[plain]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[breaks] = inside[breaks]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[breaks - 1] = inside[breaks - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _BYTE_POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[plain] * up[:-1], out=total[1:])
    hashes = (total[end] - total[start]) * down[start]
    return mix(hashes ^ (end - start).astype(np.uint64)), start, end


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word position, document) of every n-gram inside a document."""
    count = np.diff(words.first)
    if len(words.hashes) < n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty
    docs = words.documents()
    at = np.arange(len(words.hashes))
    whole = at + n <= words.first[docs + 1]
    at = at[whole]
    up, down = _WORD_POWERS.upto(len(words.hashes) + 1)
    total = np.zeros(len(words.hashes) + 1, np.uint64)
    np.cumsum(words.hashes * up[:-1], out=total[1:])
    grams = mix((total[at + n] - total[at]) * down[at])
    docs = docs[whole]
    return grams, at - words.first[docs], docs


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


def text_of(words: Words, keep: np.ndarray, document: int) -> bytes:
    """The kept words of a document, joined by one space."""
    lo, hi = words.first[document], words.first[document + 1]
    data = words.data
    parts = [
        data[s:e].tobytes()
        for s, e, k in zip(words.start[lo:hi].tolist(), words.end[lo:hi].tolist(), keep[lo:hi].tolist())
        if k
    ]
    return b" ".join(parts)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            stop = min(max(stop, at + 1), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
    # Workers live on after a task; what its batches took goes back.
    pa.default_memory_pool().release_unused()
