"""Words of whole texts as numpy arrays: boundaries, 64-bit hashes, runs of words.

Texts are read in place from Arrow buffers. A word is a run of anything but the six ASCII
white-space bytes. A hash is a multilinear sum over random 64-bit coefficients, mixed, so it
depends on the bytes alone: the same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
CHUNK = 1 << 20  # bytes handled at once; a longer text is a chunk of its own


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix generator."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Coefficients:
    """Random odd 64-bit numbers by index, grown to the longest word seen."""

    def __init__(self, seed: int) -> None:
        self.seed, self.table = U64(seed), np.zeros(0, dtype=U64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            size = max(64, 1 << int(n - 1).bit_length())
            self.table = mixed((np.arange(1, size + 1, dtype=U64) + self.seed) * U64(0x9E3779B97F4A7C15)) | U64(1)
        return self.table


LETTERS = Coefficients(1 << 32)
PLACES = (Coefficients(1 << 33), Coefficients(1 << 34))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.cast(pa.large_binary() if wide else pa.binary()).fill_null(b"")
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        yield first, last
        first = last


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``data``, and the first word's index of each row.

    ``offsets`` bound the rows inside ``data`` and begin at 0; words don't cross them.
    """
    inside = ~SPACE[data]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    parts = (data[within + np.repeat(starts, lengths)].astype(U64) + U64(1)) * LETTERS.upto(int(lengths.max()))[within]
    return mixed(np.add.reduceat(parts, first) + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


def runs(words: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    """Hash of the ``n`` words from each word on (the last n - 1 words begin none)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    by = PLACES[kind].upto(n)
    out = words[:m] * by[0]
    for j in range(1, n):
        out += words[j : j + m] * by[j]
    return mixed(out)


def documents(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, bytes | None]]:
    """Row number and word hashes of each text, in order, plus the chunk's parts for callers
    that need the words: (row, hashes, (data, starts, ends))."""
    data, offsets = buffers(column)
    for a, b in chunks(offsets):
        part = data[offsets[a] : offsets[b]]
        if lower:
            part = LOWER[part]
        starts, ends, first = bounds(part, offsets[a : b + 1] - offsets[a])
        h = hashes(part, starts, ends)
        for row in range(a, b):
            i, j = first[row - a], first[row - a + 1]
            yield row, h[i:j], (part, starts[i:j], ends[i:j])
