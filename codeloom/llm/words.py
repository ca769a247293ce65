"""Words of whole Arrow batches as numpy arrays: runs of bytes other than space and control white space.

A word is ``[^\\x20\\x09-\\x0D]+``. Its hash is a 64-bit polynomial over random values of its bytes, so words of a whole
batch are hashed without making a Python object of any. A long text is taken in slices cut at white space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

SLICE_BYTES = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_random = np.random.default_rng(20240607)
VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_VALUES = VALUES.copy()
LOWER_VALUES[65:91] = VALUES[97:123]
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, size: int) -> np.ndarray:
    """The first ``size`` powers of the base, or of its inverse, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < size:
        out = np.full(max(size, SLICE_BYTES + 4096), _BASE if kind == "base" else _INVERSE, np.uint64)
        out[0] = 1
        np.cumprod(out, out=out)
        if len(out) > 4 * SLICE_BYTES:
            return out
        _powers[kind] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _prefix(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    spread = values[data]
    spread *= _power("base", len(data))[:len(data)]
    np.cumsum(spread, out=sums[1:])
    return sums


def _run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte runs [start, end) from the prefix sums of their slice."""
    raw = (sums[ends] - sums[starts]) * _power("inverse", len(sums))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _STEP)


@dataclass
class Words:
    """Words of the rows of a batch, in order: row, place in the bytes, hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def _slices(data: np.ndarray, offsets: np.ndarray, limit: int, cut: np.ndarray) -> Iterator[tuple[int, int]]:
    low, last = 0, int(offsets[-1])
    while low < last:
        high = min(low + limit, last)
        if high < last:
            edge = int(offsets[np.searchsorted(offsets, high, "right") - 1])
            if edge > low:
                high = edge
            else:
                row_end = int(offsets[np.searchsorted(offsets, low, "right")])
                spaces = np.flatnonzero(cut[data[low:high]])
                if len(spaces):
                    high = low + int(spaces[-1]) + 1
                else:
                    while high < row_end and not cut[data[high]]:
                        high += 1
        yield low, high
        low = high


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, limit: int = SLICE_BYTES) -> Words:
    return runs_of(data, offsets, (IS_SPACE,), lower, limit)[0]


def runs_of(data: np.ndarray, offsets: np.ndarray, breaks: tuple[np.ndarray, ...], lower: bool = False, limit: int = SLICE_BYTES,
            split: Callable | None = None) -> list[Words]:
    """Runs of bytes between breaks, for each table of break bytes. Slices are cut at bytes that are breaks in all tables.

    ``split(chunk, starts, ends)`` may cut runs further.
    """
    values = LOWER_VALUES if lower else VALUES
    cut = np.logical_and.reduce(breaks)
    parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in breaks]
    for low, high in _slices(data, offsets, limit, cut):
        chunk = data[low:high]
        inside = offsets[np.searchsorted(offsets, low, "right"):np.searchsorted(offsets, high, "left")] - low
        sums = _prefix(chunk, values)
        for found, is_break in zip(parts, breaks, strict=True):
            solid = ~is_break[chunk]
            edge = np.empty(len(chunk) + 1, bool)
            edge[0], edge[-1] = solid[0], solid[-1]
            np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
            # a row border inside a run ends one and starts one
            joint = np.unique(inside[solid[inside - 1] & solid[inside]])
            at = np.flatnonzero(edge)
            starts, ends = at[::2], at[1::2]
            if len(joint):
                starts, ends = np.sort(np.concatenate([starts, joint])), np.sort(np.concatenate([ends, joint]))
            if split:
                starts, ends = split(chunk, starts, ends)
            # an Arrow string column has less than 2**31 bytes
            found.append(((starts + low).astype(np.int32), (ends + low).astype(np.int32), _run_hashes(sums, starts, ends)))
    out = []
    for found in parts:
        if not found:
            none = np.zeros(0, np.int64)
            out.append(Words(none, none, none, np.zeros(0, np.uint64)))
            continue
        start, end, hashes = (np.concatenate([p[i] for p in found]) for i in range(3))
        found.clear()
        out.append(Words((np.searchsorted(offsets, start, "right") - 1).astype(np.int32), start, end, hashes))
    return out


def windows(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of ``width`` words of a row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(row[:n] == row[width - 1:])
    out = np.zeros(len(first), np.uint64)
    for k in range(width):
        out = out * _BASE + hashes[first + k]
    return first, mix(out)
