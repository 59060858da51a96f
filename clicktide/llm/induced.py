"""Suffix order by induced sorting, with common-prefix values, on arrays.

A position is of type S if its suffix is smaller than the next one, else of type L.
Sorted S suffixes that follow an L (the seeds) induce the order of all L suffixes,
and these that of all S suffixes.  Seeds are named by a first induction and sorted
by name; equal names are told apart by the order of what follows, by doubling.

Queues by first character hold what has been induced; a queue is taken up whole,
as often as it is refilled, so that the work is done on arrays.
"""

from __future__ import annotations

import numpy as np


def types(t: np.ndarray) -> np.ndarray:
    """Whether each position is of type S; the last one is."""
    n = len(t)
    new = np.ones(n, dtype=bool)
    new[1:] = t[1:] != t[:-1]
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], n) - 1
    smaller = np.ones(len(starts), dtype=bool)
    smaller[:-1] = t[last[:-1]] < t[last[:-1] + 1]
    return np.repeat(smaller, np.diff(np.append(starts, n)))


class _Queues:
    """Positions by first character, in the order in which they were put in."""

    def __init__(self, letters: int) -> None:
        self.held: list[list[np.ndarray]] = [[] for _ in range(letters)]

    def put(self, at: np.ndarray, letter: np.ndarray) -> None:
        if not len(at):
            return
        order = np.argsort(letter, kind="stable")
        at, letter = at[order], letter[order]
        cut = np.flatnonzero(np.append(True, letter[1:] != letter[:-1]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
            self.held[letter[a]].append(at[a:b])

    def take(self, letter: int) -> np.ndarray:
        parts, self.held[letter] = self.held[letter], []
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int64)


def _induce(t: np.ndarray, is_s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All positions in suffix order, from the seeds in theirs; ``t`` ends with its one smallest character."""
    letters = int(t.max()) + 1
    seed_of = _Queues(letters)
    seed_of.put(seeds, t[seeds])
    queue = _Queues(letters)
    last = np.array([len(t) - 1], dtype=seeds.dtype)
    larger: list[list[np.ndarray]] = [[] for _ in range(letters)]  # the L suffixes of a letter

    def before(at: np.ndarray, s: bool) -> None:
        at = at[at > 0] - 1
        at = at[is_s[at] == s]
        queue.put(at, t[at])

    before(last, False)  # the end itself is the smallest suffix
    for c in range(letters):
        while len(at := queue.take(c)):
            larger[c].append(at)
            before(at, False)
        own = seed_of.take(c)
        before(own[own != len(t) - 1], False)
    done: list[np.ndarray] = []
    for c in reversed(range(letters)):
        while len(at := queue.take(c)):
            done.append(at)
            before(at, True)
        for at in reversed(larger[c]):
            done.append(at[::-1])
            before(at[::-1], True)
    done.append(last)
    return np.concatenate(done)[::-1]  # it was by falling order


def _names(t: np.ndarray, is_s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Rank of the substring from each seed to the next, equal for equal ones."""
    is_seed = np.zeros(len(t), dtype=bool)
    is_seed[seeds] = True
    order = _induce(t, is_s, seeds)
    order = order[is_seed[order]]
    place = np.empty(len(t), dtype=np.int64)
    place[seeds] = np.arange(len(seeds))
    ends = np.append(seeds[1:] + 1, len(t))
    length = (ends - seeds)[place[order]]
    same = np.zeros(len(order), dtype=bool)
    maybe = np.flatnonzero(length[1:] == length[:-1]) + 1
    depth = 0
    while len(maybe):  # compare neighbours, a character a step
        done = length[maybe] <= depth
        same[maybe[done]] = True
        maybe = maybe[~done]
        a, b = order[maybe - 1] + depth, order[maybe] + depth
        maybe = maybe[(t[a] == t[b]) & (is_s[a] == is_s[b])]
        depth += 1
    names = np.empty(len(seeds), dtype=np.int64)
    names[place[order]] = np.cumsum(~same) - 1
    return names


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Positions of ``t``, non-negative integers of a small alphabet, in suffix order."""
    if len(t) < 2:
        return np.arange(len(t))
    # an end that is smaller than all; small integers are sorted by their digits
    t = np.append(t + 1, 0).astype(np.int16 if t.max() < 2**15 - 2 else np.int64)
    is_s = types(t)
    seeds = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32 if len(t) < 2**31 else np.int64)
    rank = _names(t, is_s, seeds)
    # ranks count the smaller ones, so that an equal group leaves room for its members
    rank = (np.cumsum(np.bincount(rank)) - np.bincount(rank))[rank]
    step, n = 1, len(seeds)
    while step < n:
        live = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(live):
            break
        follow = np.where(live + step < n, rank[np.minimum(live + step, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        group = rank[live]
        new = np.append(True, key[1:] != key[:-1])
        begin = np.append(True, group[1:] != group[:-1])
        # place of each key in its group
        at = np.arange(len(live))
        offset = at[new][np.cumsum(new) - 1] - at[begin][np.cumsum(begin) - 1]
        rank[live] = group + offset
        step *= 2
    return _induce(t, is_s, seeds[np.argsort(rank, kind="stable")])[1:]


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``most``; ``t`` is below 65535."""
    out = np.zeros(len(order), dtype=np.int64)
    # what lies behind the end equals nothing
    padded = np.append(t, np.full(most + 8, 65535)).astype(np.uint16)
    fours = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 4)).view(np.uint64).ravel()
    live = np.arange(1, len(order))
    for depth in range(0, most, 4):
        a, b = order[live - 1] + depth, order[live] + depth
        same = fours[a] == fours[b]
        rest = live[~same]
        a, b = a[~same], b[~same]
        n = np.zeros(len(rest), dtype=np.int64)
        alike = np.ones(len(rest), dtype=bool)
        for i in range(4):
            alike &= padded[a + i] == padded[b + i]
            n += alike
        out[rest] = np.minimum(depth + n, most)
        live = live[same]
    out[live] = most
    return out
