"""Byte-pair merges of many short pieces at once.

Pieces of one length are the rows of a matrix of ids. Each step merges, in every row, the adjacent pair of the lowest rank, the leftmost of equals,
as byte-pair encoding is defined; so all rows that go on have the same length again, and rows without a pair are done.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)


class Merges:
    """pairs: the ids of each merge's two sides and of its result, in the order of their ranks."""

    def __init__(self, pairs: np.ndarray, n_ids: int):
        left, right, self.result = pairs.astype(np.int64).T
        self.n, self.size = n_ids, 1 << 19
        self.keys, self.ranks = np.full(self.size, -1, np.int64), np.full(self.size, NONE, np.int32)
        # linear probing: each round places one of the keys that want a free slot, the others move on
        key, rank = left * n_ids + right, np.arange(len(left), dtype=np.int32)
        slot, self.probes = self._slot(key), 0
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            at, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[at], self.ranks[at] = key[put], rank[put]
            left_over = np.ones(len(key), bool)
            left_over[put] = False
            key, rank, slot = key[left_over], rank[left_over], (slot[left_over] + 1) % self.size
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it isn't merged."""
        key = (a.astype(np.int64) * self.n + b).ravel()
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = at = (slot[open_] + 1) % self.size
            found = self.keys[at]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out.reshape(a.shape)

    def encode(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each piece; symbols: the pieces' first ids one after another, of which each has sizes."""
        starts, done, count = np.cumsum(sizes) - sizes, [], np.zeros(len(sizes), np.int64)
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            ids = symbols[starts[rows][:, None] + np.arange(n)]
            ranks = self.rank(ids[:, :-1], ids[:, 1:])
            while len(rows):
                if ids.shape[1] > 1:
                    at = ranks.argmin(axis=1)
                    least = ranks[np.arange(len(rows)), at]
                    going = least != NONE
                else:
                    going = np.zeros(len(rows), bool)
                if not going.all():
                    done.append((rows[~going], ids[~going]))
                    count[rows[~going]] = ids.shape[1]
                    if not going.any():
                        break
                    rows, ids, ranks, at, least = rows[going], ids[going], ranks[going], at[going], least[going]
                each = np.arange(len(rows))
                ids[each, at] = self.result[least]
                keep = np.ones(ids.shape, bool)
                keep[each, at + 1] = False
                ids = ids[keep].reshape(len(rows), -1)
                keep = np.ones(ranks.shape, bool)
                keep[each, at] = False
                ranks = ranks[keep].reshape(len(rows), -1)
                # the pairs on both sides of the new symbol
                r = np.flatnonzero(at > 0)
                ranks[r, at[r] - 1] = self.rank(ids[r, at[r] - 1], ids[r, at[r]])
                r = np.flatnonzero(at < ranks.shape[1])
                ranks[r, at[r]] = self.rank(ids[r, at[r]], ids[r, at[r] + 1])
        out, starts = np.zeros(int(count.sum()), np.uint32), np.cumsum(count) - count
        for rows, ids in done:
            out[starts[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, count
