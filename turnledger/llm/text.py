"""Hashes of words and word runs over concatenated UTF-8 texts, one numpy pass per slice.

A slice is a run of whole documents laid end to end as bytes. A word's hash is a
polynomial over its bytes, read from running sums, so the cost is per byte and no Python
object is made per word. Hashes have 64 bits; equal words always agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection, after splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(fold_case: bool) -> np.ndarray:
    """A 64-bit code per byte; with ``fold_case``, ``A-Z`` share the codes of ``a-z``."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


class _Powers:
    """Powers of the base and of its inverse, grown to the longest slice met."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 1 << 16)
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                table = np.full(size, factor, dtype=np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))


_POWERS = _Powers()


@dataclass
class Slice:
    """Documents ``first`` to ``last`` (exclusive) of a batch as one byte buffer."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def document(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Words in reading order: byte ranges, hashes, and where each document's begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a binary column without nulls into slices of about ``limit`` bytes of whole documents."""
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        low = offsets[first]
        yield Slice(first, last, data[low : offsets[last]], offsets[first : last + 1] - low)
        first = last


def words(part: Slice, separators: np.ndarray, codes: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """Words are maximal runs of bytes outside ``separators``; ``cuts`` marks further starts."""
    data, offsets = part.data, part.offsets
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(offsets), dtype=np.int64))
    inside = ~separators[data]
    opens = np.ones(n + 1, dtype=bool)
    opens[1:n] = ~inside[:-1]
    opens[offsets] = True
    if cuts is not None:
        opens[:n] |= cuts
    closes = np.ones(n, dtype=bool)
    closes[:-1] = ~inside[1:]
    closes |= opens[1:]
    starts = np.flatnonzero(inside & opens[:n])
    ends = np.flatnonzero(inside & closes) + 1
    _POWERS.reach(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes[data] * _POWERS.up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _POWERS.down[starts])
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def runs(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words, with the bounds of each document's runs.

    A document of fewer words, but at least one, has one run of all its words.
    """
    counts = found.counts
    number = np.where(counts >= length, counts - length + 1, np.minimum(counts, 1))
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(number, out=bounds[1:])
    first = np.repeat(found.bounds[:-1] - bounds[:-1], number) + np.arange(bounds[-1])
    stop = np.repeat(found.bounds[1:], number)
    total = np.zeros(len(first), dtype=np.uint64)
    padded = np.append(found.hashes, np.zeros(length, dtype=np.uint64))
    for k in range(length):
        at = first + k
        total = total * np.uint64(_BASE) + np.where(at < stop, padded[at], np.uint64(k + 1))
    return mix(total), bounds


def per_document(values: np.ndarray, bounds: np.ndarray, ufunc: np.ufunc, empty) -> np.ndarray:
    """Reduce the values of each document; documents without values get ``empty``."""
    out = np.full((len(bounds) - 1, *values.shape[1:]), empty, dtype=values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[full], axis=0)
    return out


def as_long(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed values Spark stores."""
    return hashes.view(np.int64)
