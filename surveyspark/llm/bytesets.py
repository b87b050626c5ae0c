"""Vectorised views of Arrow text columns: one byte buffer, document offsets, runs of word bytes and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd multiplier and its inverse modulo 2^64.
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)


def table(bad: str) -> np.ndarray:
    """256 flags, true for bytes outside ``bad``."""
    t = np.ones(256, bool)
    t[list(bad.encode("latin-1"))] = False
    return t


#: Bytes that are no white space of ASCII.
NOT_SPACE = table("\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n in _kept:
        return _kept[n]
    out = []
    for base in (_P, _INV):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    _kept.clear()
    _kept[n] = out[0], out[1]
    return _kept[n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that none holds more than ``limit`` bytes of text or one document."""
    for b in batches:
        _, off = text_bytes(b.column(column))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def runs(data: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of word bytes; none crosses a document."""
    n = len(data)
    inside = word[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(off, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial from prefix sums, then mixed with the length.

    Long buffers are taken in parts, since the sums need some 40 bytes for each; ranges must then start in order.
    """
    n, part = len(data), 1 << 21
    if n > part and len(starts) > 1:
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + part // 2, "right")))
            a, e = int(starts[i]), int(ends[i:j].max())
            out[i:j] = hashes(data[a:e], starts[i:j] - a, ends[i:j] - a) if e - a <= part or j == i + 1 else np.concatenate(
                [hashes(data[x:y], np.zeros(1, np.int64), np.array([y - x])) for x, y in zip(starts[i:j].tolist(), ends[i:j].tolist())])
            i = j
        return out
    size = 1 << max(21, int(n).bit_length())
    up, down = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
