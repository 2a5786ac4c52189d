"""Merge rounds of byte-pair vocabularies over flat numpy arrays of symbols.

In a round every segment finds the best rank among its adjacent pairs and
merges that pair from left to right wherever it stands; segments without a pair
leave the arrays, until none is left. Merging all places of a pair at once
equals merging one at a time only if no new pair is as good as the one just
merged. That is proved for each rank when the table is built; at other ranks a
round merges the leftmost place alone, and long segments are merged with a heap.
"""

from __future__ import annotations

import heapq
from functools import cached_property

import numpy as np

NONE = np.int64(1 << 40)
#: Segments beyond this length that hold an unproved rank are merged with a heap.
LONG = 256


class Merges:
    """Pairs of symbols (``left << 32 | right``) with the symbol that each makes and its rank, in a hash table."""

    def __init__(self, pairs: list[int], made: list[int], ranks: list[int]):
        order = np.argsort(pairs)
        self.pairs, self.made, self.ranks = (np.array(x, np.int64)[order] for x in (pairs, made, ranks))
        own = np.full(max(int(self.made.max()), int((self.pairs >> 32).max()), int((self.pairs & 0xFFFFFFFF).max())) + 1, -1)
        own[self.made] = self.ranks
        self.proved = np.ones(int(self.ranks.max()) + 1, bool)
        for side in (self.pairs >> 32, self.pairs & 0xFFFFFFFF):
            self.proved[own[side][(own[side] >= 0) & (self.ranks <= own[side])]] = False
        bits = max(4, (4 * len(self.pairs)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(self.pairs), dtype=np.int32), self.slot(self.pairs)
        self.probes = 0
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & self.mask
            self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among ``pairs``, or -1."""
        keys = left << 32 | right
        out, todo = np.full(len(keys), -1, np.int64), np.flatnonzero((left >= 0) & (right >= 0))
        at = self.slot(keys[todo])
        for _ in range(self.probes):
            held = self.slots[at]
            hit = (held >= 0) & (self.pairs[held] == keys[todo])
            out[todo[hit]] = held[hit]
            more = (held >= 0) & ~hit
            todo, at = todo[more], (at[more] + 1) & self.mask
            if not len(todo):
                break
        return out

    @cached_property
    def table(self) -> dict[int, tuple[int, int]]:
        """Pair to (rank, made), for the heap."""
        return dict(zip(self.pairs.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))


def merge_rounds(symbols: np.ndarray, owner: np.ndarray, v: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that are left, and their segments, in order; ``owner`` numbers the segments, ascending."""
    done_symbols, done_owners = [], []

    def pair_of(left: np.ndarray, right: np.ndarray, same: np.ndarray) -> np.ndarray:
        found = np.full(len(left), -1, np.int64)
        found[same] = v.find(left[same], right[same])
        return found

    def neighbours() -> tuple[np.ndarray, np.ndarray]:
        return np.append(symbols[1:], -1), np.append(owner[1:] == owner[:-1], False)

    right, same = neighbours()
    pair = pair_of(symbols, right, same)
    while len(symbols):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        counts = np.diff(np.append(starts, len(owner)))
        rank = np.where(pair >= 0, v.ranks[pair], NONE)
        least = np.minimum.reduceat(rank, starts)
        over = least == NONE
        if over.any():
            gone = np.repeat(over, counts)
            done_symbols.append(symbols[gone])
            done_owners.append(owner[gone])
            symbols, owner, pair, rank = symbols[~gone], owner[~gone], pair[~gone], rank[~gone]
            starts, counts, least = starts[~over], counts[~over], least[~over]
            if not len(symbols):
                break
        unproved = ~v.proved[least]
        for s in np.flatnonzero(unproved & (counts > LONG)):  # taken out one by one
            mine = owner == owner[np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))[s]]
            ids = _one_by_one(symbols[mine].tolist(), v)
            done_symbols.append(np.array(ids, np.int64))
            done_owners.append(np.full(len(ids), owner[mine][0]))
            pair = np.where(mine, -2, pair)
        if (pair == -2).any():
            stay = pair != -2
            symbols, owner, pair = symbols[stay], owner[stay], pair[stay]
            continue
        best = rank == np.repeat(least, counts)
        places = np.arange(len(best))
        first = best & ~np.append(False, best[:-1] & (owner[1:] == owner[:-1]))
        run = np.maximum.accumulate(np.where(first, places, 0))
        take = best & ((places - run) % 2 == 0)
        if unproved.any():
            leftmost = np.minimum.reduceat(np.where(best, places, len(best)), np.cumsum(np.append(0, counts[:-1])))
            take &= ~np.repeat(unproved, counts) | (places == np.repeat(leftmost, counts))
        symbols = np.where(take, v.made[pair], symbols)
        keep = ~np.append(False, take[:-1])
        new = take[keep]
        symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
        changed = new | np.append(new[1:], False)
        right, same = neighbours()
        pair[changed] = pair_of(symbols[changed], right[changed], same[changed])
    flat, owners = np.concatenate(done_symbols), np.concatenate(done_owners)
    order = np.argsort(owners, kind="stable")
    return flat[order], owners[order]


def _one_by_one(symbols: list[int], v: Merges) -> list[int]:
    """The same merges with a heap, one at a time: n log n for long segments of unproved ranks."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] >= 0 and (found := v.table.get(symbols[at] << 32 | symbols[after[at]])):
            heapq.heappush(heap, (found[0], at, symbols[at], symbols[after[at]], found[1]))

    for at in range(n):
        offer(at)
    gone = [False] * n
    while heap:
        _, at, a, b, new = heapq.heappop(heap)
        to = after[at]
        if gone[at] or to < 0 or symbols[at] != a or symbols[to] != b:
            continue
        symbols[at], gone[to], after[at] = new, True, after[to]
        if after[to] >= 0:
            before[after[to]] = at
        offer(before[at])
        offer(at)
    return [s for s, g in zip(symbols, gone, strict=True) if not g]
