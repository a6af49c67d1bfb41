"""Array kernels over whole texts: words, hashed words and windows, without a Python loop for each word.

A word is ``[^\\x20\\x09-\\x0D]+``, with A-Z lowered and every other character as it is. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 21

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of x."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64))
_LOWERED = _BYTE.copy()
_LOWERED[65:91] = _BYTE[97:123]


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int = _BASE) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES)
            self.up, self.down = (self._row(b, size) for b in (self.base, self.inverse))
        return self.up, self.down


    @staticmethod
    def _row(base: int, size: int) -> np.ndarray:
        row = np.full(size, base, dtype=U64)
        row[0] = 1
        return np.multiply.accumulate(row)


POWERS = Powers()


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row, and where each begins and the last ends. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2] if len(column) else None
    got = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return got, offsets - offsets[0]


def cut(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes each; a longer text makes a run of its own."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, rows)
        at = min(end, rows)


@dataclass
class Words:
    """Words of a run of texts: their hashes in order, and for each text where its words begin (one more at the end)."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, lowered: bool = True) -> Words:
    """Hash the words of texts that lie one after another in ``data``; no word reaches into the next text."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=U64), np.zeros(len(offsets), dtype=np.int64), none, none)
    space = _SPACE[data]
    before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = POWERS.upto(n)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((_LOWERED if lowered else _BYTE)[data] * up[:n], out=sums[1:])
    return Words(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64)), np.searchsorted(starts, offsets), starts, ends)


_PLACE = mix(np.arange(1001, 1065, dtype=U64)) | U64(1)


def windows(w: Words, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every n-word window; with ``short`` a text of fewer words, but one at least, counts as one window."""
    if n > len(_PLACE):
        raise ValueError(f"windows of {n} words; {len(_PLACE)} at most")
    total = max(0, len(w.hashes) - n + 1)
    got, row = np.zeros(total, dtype=U64), w.row
    for k in range(n):
        got += w.hashes[k : k + total] * _PLACE[k]
    inside = row[:total] == row[n - 1 : n - 1 + total]
    got, at = mix(got[inside]), row[:total][inside]
    if short and len(few := np.flatnonzero((w.counts > 0) & (w.counts < n))):
        place = np.arange(len(w.hashes)) - w.first[row]
        part = np.isin(row, few)
        terms, of = w.hashes[part] * _PLACE[place[part]], row[part]
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        sums = np.add.reduceat(terms, begin)
        got, at = np.r_[got, mix(sums + w.counts[of[begin]].astype(U64))], np.r_[at, of[begin]]
        order = np.argsort(at, kind="stable")
        got, at = got[order], at[order]
    return got, at


def distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes once, ascending. Rows come in ascending order."""
    hashes = hashes.copy()
    new = np.ones(len(row), dtype=bool)
    new[1:] = row[1:] != row[:-1]
    begin = [*np.flatnonzero(new).tolist(), len(row)]
    for a, b in zip(begin, begin[1:], strict=False):
        hashes[a:b].sort()
    new[1:] |= hashes[1:] != hashes[:-1]
    return hashes[new], row[new]


def of_text(texts: list[str | None], lowered: bool = True) -> Words:
    return words(*flat(pa.array(texts, pa.string())), lowered=lowered)


def crc32_ids(n: pa.Array) -> np.ndarray:
    """crc32 of each id written as a decimal number."""
    import zlib

    return np.fromiter((zlib.crc32(str(x).encode()) for x in n.to_pylist()), dtype=np.int64, count=len(n))
