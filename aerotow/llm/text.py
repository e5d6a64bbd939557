"""Word positions and hashes of whole Arrow string columns, computed on the UTF-8 bytes with numpy.

Tasks work on slices of a few megabytes of text, so memory follows the slice (or the longest single text), not
the partition. A null text is the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a lower-cased text: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: Words [^\x20\x09-\x0D]+: runs between ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[0x20] = False
SPACED[0x09:0x0E] = False

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers(dict):
    """Power tables by base; a copy that is sent to a task starts empty."""

    def __reduce__(self):
        return _Powers, ()


_powers = _Powers()


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls have no bytes; offsets start at 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a run of texts: byte ranges [starts, ends) in ``data``; text d has words first[d] .. first[d+1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n), out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * _power_table(_INVERSE, n)[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))


def words(arr: pa.Array, kind: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes of ``kind``; no run crosses the end of a text."""
    data, offsets = buffers(arr)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hash of each run of ``size`` consecutive word hashes (windows may cross texts)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out *= np.uint64(0xA24BAED4963EE407)
        out += h[j:j + n]
    return mix(out)


def window_ok(w: Words, size: int) -> np.ndarray:
    """For each window start, whether the window ends inside its text."""
    n = max(0, len(w.starts) - size + 1)
    return np.arange(n) + size <= w.first[1:][w.owner()[:n]]
