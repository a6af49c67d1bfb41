"""Suffix arrays by induced sorting, a bucket at a time, and common prefixes in text order.

The text is a run of segments, each ended by a separator below all characters; separators count as different, the
last one first and the others in text order, so no comparison goes beyond a segment.
"""

from __future__ import annotations

import numpy as np

from tarn.llm.text import POWERS, U64, mix

SEPARATOR = 1


def joined(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text with characters from 2 on, separators and the end (0); and where each segment begins."""
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    starts = np.r_[0, np.cumsum(sizes + 1)]
    text = np.full(starts[-1] + 1, SEPARATOR, dtype=np.uint16)
    inside = np.ones(len(text), dtype=bool)
    inside[starts[1:] - 1] = False
    inside[-1] = False
    text[inside] = np.frombuffer(b"".join(segments), dtype=np.uint8).astype(np.uint16) + 2
    text[-1] = 0
    return text, starts[:-1]


def classified(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one, and the leftmost-smaller positions."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.zeros(n, dtype=bool)
    smaller[-1] = True
    if len(differs):
        rises = text[differs] < text[differs + 1]
        nearest = np.searchsorted(differs, np.arange(n - 1))
        known = nearest < len(differs)
        smaller[:-1][known] = rises[nearest[known]]
    left = np.zeros(n, dtype=bool)
    left[1:] = smaller[1:] & ~smaller[:-1]
    return smaller, np.flatnonzero(left)


def _deal(places: np.ndarray, chars: np.ndarray, to: list[list[np.ndarray]]) -> None:
    """Append places to the buckets of their characters, in order."""
    if not len(places):
        return
    order = np.argsort(chars, kind="stable")
    places, chars = places[order], chars[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    begin = np.r_[0, cuts]
    for c, part in zip(chars[begin].tolist(), np.split(places, cuts), strict=True):
        to[c].append(part)


def induced(text: np.ndarray, smaller: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order (or, if these are only in order of their first
    characters, in order up to the next such position)."""
    n, top = len(text), int(text.max()) + 1
    none = np.zeros(0, dtype=np.int64)
    cat = lambda parts: np.concatenate(parts) if parts else none
    larger: list[list[np.ndarray]] = [[] for _ in range(top)]
    less: list[list[np.ndarray]] = [[] for _ in range(top)]
    first: list[list[np.ndarray]] = [[] for _ in range(top)]
    _deal(marked, text[marked], first)
    out_larger = []
    for c in range(top):  # suffixes larger than their next, from the left
        wave, got = cat(larger[c]), []
        while len(wave):
            got.append(wave)
            p = wave[wave > 0] - 1
            p = p[~smaller[p]]
            q = text[p]
            _deal(p[q != c], q[q != c], larger)
            wave = p[q == c]
        p = cat(first[c])
        p = p[p > 0] - 1
        p = p[~smaller[p]]
        _deal(p, text[p], larger)
        out_larger.append(cat(got))
        larger[c] = []
    less[0].append(np.array([n - 1]))
    out = [none] * (2 * top)
    for c in range(top - 1, -1, -1):  # suffixes smaller than their next, from the right
        got = []
        wave = cat(less[c])
        if c == SEPARATOR:  # these are in text order, after the last one, which is larger than the end
            wave = np.flatnonzero((text == SEPARATOR) & smaller)[::-1]
        while len(wave):
            got.append(wave)
            p = wave[wave > 0] - 1
            p = p[smaller[p]]
            q = text[p]
            _deal(p[q != c], q[q != c], less)
            wave = p[q == c] if c != SEPARATOR else none
        p = out_larger[c][::-1]
        p = p[p > 0] - 1
        p = p[smaller[p]]
        q = text[p]
        _deal(p[q != SEPARATOR], q[q != SEPARATOR], less)
        out[2 * c], out[2 * c + 1] = out_larger[c], cat(got)[::-1]
        less[c] = []
    return np.concatenate(out)


def _named(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names, in text order, of the pieces from each leftmost-smaller position to the next; equal pieces have one name."""
    n = len(text)
    place = np.full(n, -1, dtype=np.int64)
    place[lms] = np.arange(len(lms))
    k = place[ordered]
    end = np.r_[lms[1:], n - 1][k]
    up, down = POWERS.upto(n + 1)
    sums = np.r_[U64(0), np.cumsum(mix(text.astype(U64)) * up[:n], dtype=U64)]
    code = (sums[end + 1] - sums[ordered]) * down[ordered] + mix((end - ordered).astype(U64))
    # a piece that begins or ends at a separator is like no other
    alone = (text[ordered] <= SEPARATOR) | (text[end] <= SEPARATOR)
    new = np.ones(len(k), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | alone[1:] | alone[:-1]
    names = np.empty(len(lms), dtype=np.int64)
    names[k] = np.cumsum(new) - 1
    return names


def _ranked(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of the reduced text. Its alphabet is large, so ties are settled by ranks of twice the length, again and again."""
    rank, step, m = names.copy(), 1, len(names)
    order = np.argsort(rank, kind="stable")
    while True:
        r = rank[order]
        tied = np.zeros(m, dtype=bool)
        same = r[1:] == r[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        part = order[at]
        ahead = np.where(part + step < m, rank[np.minimum(part + step, m - 1)], -1)
        resort = np.lexsort((ahead, r[at]))
        part, own, ahead = part[resort], r[at], ahead[resort]
        order[at] = part
        # a group's ranks begin where the group does, so that ranks stay in order
        new = np.ones(len(at), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])
        rank = rank.copy()
        rank[part] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[order[~tied]] = np.flatnonzero(~tied)
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    smaller, lms = classified(text)
    rough = induced(text, smaller, lms)
    mark = np.zeros(len(text), dtype=bool)
    mark[lms] = True
    ordered = rough[mark[rough]]
    names = _named(text, lms, ordered)
    if len(lms) and names.max() + 1 < len(lms):
        ordered = lms[_ranked(names)]
    return induced(text, smaller, ordered)


def permuted_reach(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """In text order: whether a suffix and the one before it in the suffix array share ``least`` characters without a separator."""
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    ends = np.flatnonzero(text <= SEPARATOR)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    at = np.flatnonzero((room >= least) & (before >= 0))
    at = at[room[before[at]] >= least]
    data = np.r_[np.where(text >= 2, text - 2, 0).astype(np.uint8), np.zeros(8, dtype=np.uint8)]
    words = np.zeros(n, dtype=U64)
    for k in range(8):
        words |= data[k : k + n].astype(U64) << U64(8 * k)
    for off in [*range(0, least - 7, 8), least - 8]:
        at = at[words[at + off] == words[before[at] + off]]
    out = np.zeros(n, dtype=bool)
    out[at] = True
    return out
