"""Fingerprints, and the self-join of a binary trie over them.

Fingerprints are sorted, so that a trie node is a range of rows and its two
children meet at one cut. The join walks pairs of nodes of equal depth, adds a
bit wherever the two branches differ, and drops a pair once that passes the
error budget of its depth. Pairs of few rows are compared row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Node pairs that are expanded together, and row pairs of a node pair that are compared without going deeper.
_FRONTIER, _LEAF = 200_000, 16


def digests(text: bytes | None, shingle: int) -> np.ndarray:
    """The unsigned hashes of a text's shingles in order; a shorter text is one shingle, one without words has none."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, ends = [0, *ends[:-1]], ends[shingle - 1 :]
    return np.array([digest(joined[s : e - 1], 42) for s, e in zip(starts, ends)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes; zero without any."""
    ones, n = np.zeros(64, np.int64), len(h)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after rows i and j were tied pairwise; each set has its least row."""
    while True:
        a, b = label[i], label[j]
        if not (apart := a != b).any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up


class TrieJoin:
    """Rows of fingerprints ``u`` (unsigned), joined from given pairs of trie nodes.

    ``label`` tells rows known to belong together: a node pair whose rows are all
    of one label is dropped, as no link in it can add anything. ``expanded``
    counts the node pairs that were taken apart.
    """

    def __init__(self, u: np.ndarray, bits: int, label: np.ndarray | None = None):
        self.u, self.bits, self.expanded = u, bits, 0
        self.label = np.arange(len(u)) if label is None else label
        self._ones: dict[int, np.ndarray] = {}
        self._settle()

    def _settle(self) -> None:
        self._changes = np.r_[0, np.cumsum(self.label[1:] != self.label[:-1])]

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        self.label = unite(self.label, i, j)
        self._settle()

    def nearest(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of row pairs, the nearest ones that tie different labels together; they are tied."""
        order = np.argsort(np.bitwise_count(self.u[i] ^ self.u[j]), kind="stable")
        i, j, found = i[order], j[order], []
        while len(i):
            a, b = self.label[i], self.label[j]
            i, j, a, b = (x[a != b] for x in (i, j, a, b))
            # the nearest pair of every label
            best = np.unique(np.concatenate([np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]]))
            found.append((i[best], j[best]))
            self.tie(i[best], j[best])
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (i, j)

    def walk(self, depth: int, pairs: np.ndarray, budget: Callable[[int], int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The row pairs (i, j) within the budget, below node pairs of one depth.

        ``pairs`` has a column a pair: first and last row of both nodes (last
        excluded) and their differing bits so far. Equal nodes are joined with
        themselves; other pairs are disjoint. ``budget`` gives the bits that may
        differ among so many leading ones.
        """
        u = self.u
        stack = [(depth, pairs)]
        while stack:
            depth, p = stack.pop()
            if p.shape[1] > _FRONTIER:
                stack.append((depth, p[:, _FRONTIER:]))
                p = p[:, :_FRONTIER]
            a0, a1, b0, b1, _ = p
            changes, label = self._changes, self.label
            settled = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (label[a0] == label[b0])
            p = p[:, ~settled & ~((a0 == b0) & (a1 - a0 < 2))]
            a0, a1, b0, b1, _ = p
            small = ((a1 - a0) * (b1 - b0) <= _LEAF) | (depth == 64)
            if small.any():
                yield from self._leaves(p[:, small])
            p = p[:, ~small]
            if not p.shape[1]:
                continue
            self.expanded += p.shape[1]
            if depth not in self._ones:
                self._ones[depth] = np.r_[0, np.cumsum((u >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)]
            c = self._ones[depth]
            a0, a1, b0, b1, diff = p
            am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
            same = a0 == b0
            near = np.concatenate([np.stack([a0, am, b0, bm, diff]), np.stack([am, a1, bm, b1, diff])], axis=1)
            far = np.concatenate([np.stack([a0, am, bm, b1, diff + 1]), np.stack([am, a1, b0, bm, diff + 1])[:, ~same]], axis=1)
            for x in (far, near):  # nearer pairs first: they settle labels
                x = x[:, (x[0] < x[1]) & (x[2] < x[3]) & (x[4] <= budget(depth + 1))]
                if x.shape[1]:
                    stack.append((depth + 1, x))

    def _leaves(self, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        u, n_a, n_b = self.u, p[1] - p[0], p[3] - p[2]
        for at, end in _runs(n_a * n_b, 2_000_000):
            total = (n_a * n_b)[at:end]
            which = np.repeat(np.arange(at, end), total)
            k = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
            i, j = p[0][which] + k // n_b[which], p[2][which] + k % n_b[which]
            ok = ((p[0] != p[2])[which] | (i < j)) & (np.bitwise_count(u[i] ^ u[j]) <= self.bits)
            if ok.any():
                yield i[ok], j[ok]


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut into runs whose sizes add up to about ``most``."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end
