"""A hierarchical index over bit fingerprints in Gray-code order.

Fingerprints of one key, sorted by their rank in the reflected Gray code, lie
beside others that differ in few bits.  Every ``FAN`` neighbours form a node that
keeps the bits all of them share, as a mask and a pattern; nodes form nodes in
turn, up to a root over a whole batch of keys.  For two nodes the shared bits in
which their patterns differ, added up word by word, are a lower bound of the
distance of any two members, so that whole groups are pruned at once.  Nodes
without a common key are never compared, nor are members that are known to be
connected already: a dense group costs little more than its own size.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

FAN = 8
_CHUNK = 1 << 13


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray code."""
    out = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


def join_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of the component of each of ``n`` items after linking a with b."""
    labels = np.arange(n) if labels is None else labels.copy()
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


class _Index:
    """Nodes by level, from single values upwards: shared bits and the range of keys."""

    def __init__(self, v: np.ndarray, keys: np.ndarray):
        ones, zeros = v, v
        self.pattern, self.mask, self.first, self.last, self.width = [v], [np.full_like(v, ~np.uint64(0))], [keys], [keys], [1]
        while len(ones) > FAN:
            starts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(zeros, starts)
            mask = ~(ones ^ zeros)
            self.pattern.append(ones & mask)
            self.mask.append(mask)
            self.first.append(self.first[-1][starts])
            self.last.append(self.last[-1][np.minimum(starts + FAN, len(self.last[-1])) - 1])
            self.width.append(self.width[-1] * FAN)

    def near(self, level: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Which pairs of nodes may hold members within ``most`` differences."""
        left, diff = np.arange(len(a)), np.zeros(len(a), np.int32)
        pattern, mask = self.pattern[level], self.mask[level]
        for word in range(pattern.shape[1]):
            x, y = a[left], b[left]
            bits = pattern[x, word] ^ pattern[y, word]
            diff[left] += np.bitwise_count(bits & mask[x, word] & mask[y, word] if level else bits)
            left = left[diff[left] <= most]
        return left

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each node the label that all its members have, or -1."""
        out = []
        for width in self.width:
            starts = np.arange(0, len(labels), width)
            low, high = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
            out.append(np.where(low == high, low, -1))
        return out


def join_forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after linking a with b, and which of the links a forest needs for it:
    one for each label that gives way to a smaller one."""
    chosen, left = [], np.arange(len(a))
    while True:
        x, y = labels[a[left]], labels[b[left]]
        left, high, low = left[x != y], np.maximum(x, y)[x != y], np.minimum(x, y)[x != y]
        if not len(left):
            return labels, np.concatenate([np.zeros(0, int), *chosen])
        _, first = np.unique(high, return_index=True)
        chosen.append(left[first])
        to = np.arange(len(labels))
        to[high[first]] = low[first]
        while (to[to] != to).any():
            to = to[to]
        labels = to[labels]


def nearest_of_each(nodes: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` rows of every node."""
    by = np.argsort(nodes, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], nodes[by][1:] != nodes[by][:-1]])) if len(by) else by
    rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    return by[rank < most]


def forest(values: np.ndarray, levels: tuple[int, ...], keys: np.ndarray | None = None, counts: Counter | None = None, spare: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For uint64 ``values`` (one or several words a row), linked where their ``keys`` are
    equal and no more bits differ than the last of ``levels``: the index of one member
    of each one's component, and links (a, b) that connect the components, without
    cycles.

    Links of fewer bits come first, by ``levels`` in ascending order, as in a minimum
    spanning tree.  With ``spare``, each value that one of the wider ``levels`` links
    gives so many of its nearest links besides, for a caller that may find some of
    them wanting.
    ``counts`` gets the pairs compared by height, and the links.
    """
    n = len(values)
    v = values.reshape(n, -1)
    keys = np.zeros(n, np.int64) if keys is None else keys
    none = np.zeros(0, int)
    if n < 2:
        return np.arange(n), none, none
    order = np.lexsort((gray_rank(v[:, 0]), keys))
    v, keys = v[order], keys[order]
    labels, counts = np.arange(n), Counter() if counts is None else counts
    index, found = _Index(v, keys), []

    def link(a: np.ndarray, b: np.ndarray, diff: np.ndarray, spare: int) -> None:
        nonlocal labels
        by = np.argsort(diff, kind="stable")
        a, b = a[by], b[by]
        apart = np.flatnonzero(labels[a] != labels[b])
        labels, some = join_forest(labels, a, b)
        if spare:
            x, y = a[apart], b[apart]
            some = np.unique(np.concatenate([some, *(apart[nearest_of_each(side, spare)] for side in (x, y))]))
        counts["links"] += len(a)
        found.append((a[some], b[some]))

    # neighbours in this order and in those of rotated bits connect dense groups
    beside = []
    for turn in (0, 13, 26, 39, 52):
        t, back = np.uint64(turn), np.uint64((64 - turn) % 64)
        by = np.lexsort((gray_rank((v[:, 0] << t) | (v[:, 0] >> back)), keys)) if turn else np.arange(n)
        a, b = by[:-1], by[1:]
        a, b = a[keys[a] == keys[b]], b[keys[a] == keys[b]]
        beside.append((a, b, np.bitwise_count(v[a] ^ v[b]).sum(1, dtype=np.int32)))
    i, j = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
    for step, most in enumerate(levels):
        # where several levels follow, no neighbour comes before a nearer value
        early = 2 * step < len(levels)
        for a, b, diff in beside if early else ():
            link(a[diff <= most], b[diff <= most], diff[diff <= most], 0)
        same, new = index.uniform(labels), []
        stack = [(len(index.width) - 1, *(x.astype(np.int32) for x in np.triu_indices(len(index.first[-1]))))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > _CHUNK:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            keep = (index.last[level][a] >= index.first[level][b]) & ((same[level][a] != same[level][b]) | (same[level][a] < 0))
            a, b = a[keep], b[keep]
            counts[level] += len(a)
            keep = index.near(level, a, b, most)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                new.append((a, b, np.bitwise_count(v[a] ^ v[b]).sum(1, dtype=np.int32)))
                if sum(len(x) for x, *_ in new) > max(n >> 8, 4096):
                    link(*map(np.concatenate, zip(*new, strict=True)), 0 if early else spare)
                    same, new = index.uniform(labels), []
                continue
            below = len(index.first[level - 1])
            a, b = (a[:, None] * FAN + i).ravel(), (b[:, None] * FAN + j).ravel()
            good = (a < below) & (b < below) & (a <= b)
            stack.append((level - 1, a[good], b[good]))
        if new:
            link(*map(np.concatenate, zip(*new, strict=True)), 0 if early else spare)
    out = np.empty(n, int)
    out[order] = order[labels]
    a, b = (order[np.concatenate(x)] for x in zip(*found, strict=True))
    return out, a, b


def components(values: np.ndarray, most: int, keys: np.ndarray | None = None) -> np.ndarray:
    """The index of one member of each value's component, linked at ``most`` or fewer bits."""
    return forest(values, (most,), keys)[0]
