"""Whole texts as numpy arrays: words, lines and windows of an Arrow batch as 64-bit hashes, without per-word Python.

Hashes are equal in every process. Two different words, lines or windows share a hash with a probability of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
_PIECE = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_set(members: bytes) -> np.ndarray:
    """A table of 256 booleans, true for the given bytes."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes outside [\x20\x09-\x0D]; UTF-8 keeps all other code points above them.
NOT_SPACE = ~byte_set(b"\t\n\x0b\x0c\r ")
NOT_NEWLINE = ~byte_set(b"\n")
#: Letters and digits of ASCII, and every byte of a code point beyond ASCII.
WORD_BYTES = byte_set(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Hasher:
    """Finds maximal runs of member bytes and hashes each run; runs end where a text ends."""

    def __init__(self, members: np.ndarray, fold: np.ndarray | None = None):
        self.members = members
        values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
        self.values = values if fold is None else values[fold]
        self._grow(_PIECE)

    def _grow(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        self.up = np.concatenate(([np.uint64(1)], np.full(n, _BASE, np.uint64))).cumprod(dtype=np.uint64)
        self.down = np.concatenate(([np.uint64(1)], np.full(n, inverse, np.uint64))).cumprod(dtype=np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end byte of each run, and for each text the number of its first run (one more at the end)."""
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = self.members[data]
        opens = inside[1:] & ~inside[:-1]
        closes = inside[:-1] & ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        opens[cuts] |= inside[cuts + 1]
        closes[cuts] |= inside[cuts]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
        hashes = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + _PIECE, "right")))
            size = int(ends[to - 1] - base)
            if size >= len(self.up):
                self._grow(size)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(self.values[data[base : base + size]] * self.up[:size], out=sums[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            hashes[at:to] = (sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64) * _STEP
            at = to
        return mix(hashes), starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words that stays within a text, with the number of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = hashes[:n].copy()
    for k in range(1, size):
        total = total * np.uint64(_BASE) + hashes[k : n + k]
    text_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + size <= text_end[:n])
    return mix(total[at]), at


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is a text of no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a string column in pieces of at most ``most`` bytes, or one longer text: rows, bytes, offsets."""
    data, offsets = texts_of(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def sums_per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between neighbouring bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def owner(first: np.ndarray) -> np.ndarray:
    """For each run the number of the text it lies in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
