"""Vectorised text work on Arrow string columns: words, word hashes and shingle hashes as numpy arrays.

A column is handled as one byte buffer with offsets, in slices of a few MB, so that a task holds little
memory however large the Arrow batch is. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 3_000_000
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of rows holding about limit bytes each; a longer row stands alone."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def word_spans(
    data: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ (or of runs of inside) and each row's number of words."""
    inside = ~_SPACE[data] if inside is None else inside
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offs[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] |= inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    base = int(starts[0])
    body = data[base:]
    value = _BYTE[body]
    edge = np.zeros(len(body) + 1, np.int8)
    edge[starts - base] += 1
    edge[ends - base] -= 1
    covered = np.cumsum(edge[:-1], dtype=np.int8) > 0
    value[:] = np.where(covered, value, 0)
    gaps = np.empty(len(starts), np.int64)
    gaps[:-1] = starts[1:] - starts[:-1]
    gaps[-1] = len(body) - (starts[-1] - base)
    place = np.arange(len(body)) - np.repeat(starts - base, gaps)
    value *= _PLACE[place & 0xFFFF] + (place >> 16).astype(np.uint64)
    return mix(np.add.reduceat(value, starts - base) ^ (lengths.astype(np.uint64) << np.uint64(40)))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of width words, with each row's number of them; a shorter row is one run."""
    counts = np.asarray(counts, np.int64)
    out = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), out
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    at = np.repeat(first - np.concatenate(([0], np.cumsum(out)))[:-1], out) + np.arange(int(out.sum()))
    size = np.repeat(np.minimum(counts, width), out)
    total = np.zeros(len(at), np.uint64)
    for j in range(width):
        part = words[np.minimum(at + j, n - 1)] * _SHINGLE[j]
        if j:
            part[size <= j] = 0
        total += part
    return mix(total ^ size.astype(np.uint64)), out


def distinct_per_row(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order, rows one after another, with their number by row."""
    if not len(hashes):
        return hashes, np.zeros(len(counts), np.int64)
    hashes, ends = hashes.copy(), np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        hashes[a:b].sort()
    row = np.repeat(np.arange(len(counts)), counts)
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[keep], np.bincount(row[keep], minlength=len(counts))


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80
