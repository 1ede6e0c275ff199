"""Byte-pair merges of many words at once, by vectorised rounds.

A round works on flat symbol arrays of all words: a segmented minimum gives each
word's best pair rank, its occurrences merge leftmost first, and arrays are
compacted, until no pair is left. Where a merge makes a pair that is at least as
good, later occurrences of that round wait, as an agenda would serve the new pair
first.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max


class PairTable:
    """What pairs of symbols merge to: an open hash table in two arrays.

    Symbols are below 2^31; of equal ranks the agenda serves the left pair first.
    """

    def __init__(self, left: list[int], right: list[int], rank: list[int], merged: list[int]):
        keys = np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64)
        slots = 1 << (len(keys) * 4).bit_length()
        self.mask, self.keys, self.value = slots - 1, np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
        for key, slot, r, m in zip(keys.tolist(), self._hash(keys).tolist(), rank, merged, strict=True):
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.mask
            self.keys[slot], self.value[slot] = key, r << 32 | m
        # A symbol that is made after every pair that it stands in can't make a better pair.
        made, used = {}, {}
        for a, b, r, m in zip(left, right, rank, merged, strict=True):
            made[m] = max(made.get(m, -1), r)
            for x in (a, b):
                used[x] = min(used.get(x, r), r)
        self.in_order = all(used.get(x, NONE) > r for x, r in made.items())

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & self.mask

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | merged symbol of each pair, or NONE; a negative symbol never merges."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._hash(keys)
        found = self.keys[slot]
        real = (left >= 0) & (right >= 0)
        out = np.where(real & (found == keys), self.value[slot], NONE)
        todo = np.flatnonzero(real & (found != keys) & (found >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.value[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def merge(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, symbol) of what is left when no pair remains; owners ascend, and each has its symbols together."""
        if not len(symbol):
            return owner, symbol
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = np.full(len(symbol), NONE)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        pair[same] = self.pairs(symbol[same], symbol[same + 1])
        while len(symbol):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = pair >> 32  # of NONE: the largest
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(symbol)]))
            live = best != NONE >> 32
            if not live.all():
                done.append((owner[~live], symbol[~live]))
                symbol, owner, pair, rank, best = (x[live] for x in (symbol, owner, pair, rank, best))
                if not len(symbol):
                    break
            at = _leftmost(np.flatnonzero(rank == best))
            new = pair[at] & 0xFFFFFFFF
            if not self.in_order:
                at, new = self._until_better(at, new, symbol, owner, best)
            symbol[at] = new
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            here = at - np.searchsorted(at, at)  # each earlier merge takes one symbol away
            symbol, owner, pair = symbol[keep], owner[keep], pair[keep]
            fresh = np.r_[here, here[here > 0] - 1]
            inside = np.zeros(len(fresh), bool)
            inner = fresh < len(symbol) - 1
            inside[inner] = owner[fresh[inner]] == owner[fresh[inner] + 1]
            pair[fresh] = NONE
            two = fresh[inside]
            pair[two] = self.pairs(symbol[two], symbol[two + 1])
        owner, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return owner[order], symbol[order]

    def _until_better(self, at: np.ndarray, new: np.ndarray, symbol: np.ndarray, owner: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word's merges, those up to the first that makes a pair as good as the merged one."""
        own = owner[at]
        if len(own) < 2 or not (own[1:] == own[:-1]).any():
            return at, new
        before = np.where(at > 0, symbol[at - 1], -1)
        chained = np.r_[False, at[1:] == at[:-1] + 2]
        before = np.where(chained, np.r_[0, new[:-1]], before)
        before = np.where((at > 0) & (owner[at - 1] == own), before, -1)
        after_at = np.minimum(at + 2, len(symbol) - 1)
        after = np.where((at + 2 < len(symbol)) & (owner[after_at] == own), symbol[after_at], -1)
        made = np.minimum(self.pairs(before, new), self.pairs(new, after))
        stops = made >> 32 <= best[at]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        stopped = np.cumsum(stops) - stops  # stops before this one
        keep = stopped == np.repeat(stopped[begin], np.diff(np.r_[begin, len(own)]))
        return at[keep], new[keep]


def _leftmost(at: np.ndarray) -> np.ndarray:
    """Of occurrences that overlap (neighbours, whatever their pieces), every other one from the left."""
    if len(at) < 2:
        return at
    joined = np.r_[False, np.diff(at) == 1]
    begin = np.flatnonzero(~joined)
    within = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    return at[within % 2 == 0]
