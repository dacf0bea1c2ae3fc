"""Word and piece spans of UTF-8 buffers with 64-bit hashes, computed with numpy for a whole Arrow batch at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; segments are cut at white space and may be longer where a word is.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Spans(NamedTuple):
    starts: np.ndarray  # byte positions in the buffer
    ends: np.ndarray
    doc: np.ndarray  # row of the batch
    hashes: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows); null counts as empty."""
    arr = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * SEGMENT:
            _powers[which] = have
    return have[:n]


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each [start, end) of the bytes: a polynomial over byte values modulo 2^64, then mixed."""
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[low] * _power("up", _BASE, len(low)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", _INVERSE, len(low) + 1)[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def segments(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of about SEGMENT bytes that end at a row's end or at white space."""
    cuts, at, n = [], 0, len(raw)
    row_ends = set(offsets.tolist())
    while at < n:
        to = min(n, at + SEGMENT)
        while to < n and to not in row_ends and not _ASCII_SPACE[raw[to]]:
            nxt = np.flatnonzero(_ASCII_SPACE[raw[to : to + SEGMENT]])
            step = int(nxt[0]) if len(nxt) else min(SEGMENT, n - to)
            row = int(offsets[np.searchsorted(offsets, to, side="left")])
            to = min(to + step, row)
        cuts.append((at, to))
        at = to
    return cuts


def _edges(raw: np.ndarray, inner: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of `inner` that do not cross a row's start."""
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    at_row = row_starts[row_starts < len(raw)]
    first[at_row] |= inner[at_row]
    last = inner.copy()
    last[:-1] &= ~inner[1:]
    before = at_row[at_row > 0] - 1
    last[before] |= inner[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(column: pa.Array) -> Spans:
    """The words `[^\\x20\\x09-\\x0D]+` of each row, hashed with A-Z lower-cased."""
    raw, offsets = utf8(column)
    parts = []
    for lo, hi in segments(raw, offsets):
        seg = raw[lo:hi]
        rows = offsets[(offsets >= lo) & (offsets < hi)] - lo
        starts, ends = _edges(seg, ~_ASCII_SPACE[seg], rows)
        parts.append((starts + lo, ends + lo, span_hashes(_LOWER[seg], starts, ends)))
    if not parts:
        return Spans(*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Spans(starts, ends, np.searchsorted(offsets, starts, side="right") - 1, hashes)
