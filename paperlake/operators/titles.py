"""Bounds on the sequence ratio of many pairs of texts at once, for tasks that hold two blocks.

If the ratio of texts with l and m characters is at least r, M >= r (l + m) / 2 characters
match in order.  M is at most the number of characters that the texts share in any order,
counted for a tile of pairs by a matrix product.  Of the grams of the first, each unmatched
character of its own spoils at most ``gram`` and each unmatched one of the other at most
``gram`` - 1, so the rest are shared; and M is at most the longest common subsequence.  All
are counted with hashed grams and characters, whose collisions only let more pairs through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

#: Buckets of numbered grams, of numbered characters and of characters, columns of the matrix
#: product at least and at most, rows compared at a time, candidates at a time.
GRAMS, NUMBERED, CHARS, COLUMNS, TILE, PAIRS = 1024, 2048, 256, (128, 1024), 512, 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _numbered(row: np.ndarray, h: np.ndarray, rows: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets the hashes of each row fall into, repeated ones numbered, and how many
    more they are than their buckets."""
    at = np.lexsort((h, row))
    h, r = h[at], row[at]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])[: len(h)]
    starts = np.flatnonzero(new)
    number = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    h = (h + number.astype(np.uint64)) * _MIX
    h ^= h >> np.uint64(32)
    held = np.zeros((rows, buckets), bool)
    held[r, ((h * _MIX) >> np.uint64(40)).astype(np.int64) % buckets] = True
    return held, np.bincount(r, minlength=rows) - held.sum(axis=1)


class Block:
    """Texts sorted by length with their characters and grams."""

    def __init__(self, ids: list, texts: list[str], gram: int) -> None:
        order = sorted(range(len(ids)), key=lambda i: len(texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(order)), self.lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.chars = np.full((len(order), int(self.lengths.max(initial=0))), CHARS, np.int64)
        self.chars[row, place] = codes % np.uint64(CHARS)
        self.held, self.over = _numbered(row, codes * _MIX, len(order), NUMBERED)
        whole = np.flatnonzero(place + gram <= self.lengths[row])
        h = np.zeros(len(whole), np.uint64)
        for k in range(gram):
            h = (h ^ codes[whole + k]) * _MIX
            h ^= h >> np.uint64(29)
        grams, self.spare = _numbered(row[whole], h, len(order), GRAMS)
        self.grams = np.packbits(grams, axis=1).view(np.uint64)

    def places(self) -> np.ndarray:
        """Bits of the places of each character, for texts of up to 64 characters."""
        out = np.zeros((len(self.ids), CHARS + 1), np.uint64)
        for k in range(min(64, self.chars.shape[1])):
            out[np.arange(len(out)), self.chars[:, k]] |= np.uint64(1 << k)
        out[:, CHARS] = 0
        return out


def matched(l: int, m: int, least: float) -> int:
    """Characters at least that match in texts of these lengths and this ratio."""
    return math.ceil(round(least * (l + m) / 2, 9))


def shared_grams(l: int, m: int, least: float, gram: int) -> float:
    """Grams at least that such texts share; infinite if they cannot have the ratio."""
    both = matched(l, m, least)
    if both > min(l, m):
        return math.inf
    one = lambda x, y: x - gram + 1 - gram * (x - both) - (gram - 1) * (y - both)
    return max(one(l, m), one(m, l))


def common(places: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Longest common subsequences by bits: rows of ``places`` against rows of ``chars``."""
    v = np.full(len(places), ~np.uint64(0))
    rows = np.arange(len(places))
    for k in range(chars.shape[1]):
        u = v & places[rows, chars[:, k]]
        v = (v + u) | (v - u)
    inside = np.where(lengths >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(lengths, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~v & inside).astype(np.int64)


def _shared(x: Block, y: Block, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Matrices whose product is at least the last value for rows of x and y that can have the ratio.

    The columns are the numbered characters that tell most texts apart; all others of x count
    as shared.  Two more columns take the characters away that must match.
    """
    longest = max(int(x.lengths[-1]), int(y.lengths[-1]))
    often = (x.held.sum(axis=0) + y.held.sum(axis=0)) / (len(x.ids) + len(y.ids))
    count = min(max(COLUMNS[0], 2 * longest), COLUMNS[1])
    keep = np.sort(np.argsort(-often * (1 - often), kind="stable")[:count])
    one, other = x.held[:, keep], y.held[:, keep]
    others = x.lengths - one.sum(axis=1)  # with those that collide
    ones = lambda b: np.ones((len(b.ids), 1))
    left = np.hstack([one, (others - least / 2 * x.lengths)[:, None], ones(x)]).astype(np.float32)
    right = np.hstack([other, ones(y), (-least / 2 * y.lengths)[:, None]]).astype(np.float32)
    return left, np.ascontiguousarray(right.T), -0.01 - 1e-6 * longest


def similar(x: Block, y: Block, same: bool, least: float, gram: int) -> Iterator[tuple]:
    """(a, b, ratio) of the pairs of two blocks, or of one with itself, that have the ratio."""
    if not len(x.ids) or not len(y.ids):
        return
    lx, ix = np.unique(x.lengths, return_inverse=True)
    ly, iy = np.unique(y.lengths, return_inverse=True)
    need = np.array([[shared_grams(l, m, least, gram) for m in ly.tolist()] for l in lx.tolist()])
    both = np.array([[matched(l, m, least) for m in ly.tolist()] for l in lx.tolist()])
    places = x.places()
    left, right, enough = _shared(x, y, least)
    for i in range(0, len(x.ids), TILE):
        fits = np.flatnonzero(np.isfinite(need[np.unique(ix[i : i + TILE])]).any(axis=0)[iy])
        if not len(fits):
            continue
        j, end = int(fits[0]), int(fits[-1]) + 1
        found = np.flatnonzero((left[i : i + TILE] @ right[:, j:end]).ravel() >= enough)
        a, b = i + found // (end - j), j + found % (end - j)
        if same:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), PAIRS):
            p, q = a[k : k + PAIRS], b[k : k + PAIRS]
            shared = np.bitwise_count(x.grams[p] & y.grams[q]).sum(axis=1, dtype=np.int64) + x.spare[p]
            some = shared >= need[ix[p], iy[q]]
            p, q = p[some], q[some]
            some = (x.lengths[p] > 64) | (common(places[p], y.chars[q], x.lengths[p]) >= both[ix[p], iy[q]])
            for s, t in zip(p[some].tolist(), q[some].tolist(), strict=True):
                one, other = (x.ids[s], x.texts[s]), (y.ids[t], y.texts[t])
                if other[0] < one[0]:
                    one, other = other, one
                ratio = SequenceMatcher(None, one[1], other[1]).ratio()
                if ratio >= least:
                    yield one[0], other[0], ratio
