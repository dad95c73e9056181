"""Tries with failure links over code points as flat arrays, walked for many strings at once or for one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Strings times characters that are walked at once.
CELLS = 1 << 19
#: From so many strings of similar length on, walking them side by side is faster than one after the other.
ABREAST = 8
_MULT = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """int64 keys (0 or more) to int32 values in an open-addressing table, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        h, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self._keys[h[left]] < 0]
            self._keys[h[free]] = keys[free]  # of keys that want one place the last gets it
            got = self._keys[h[left]] == keys[left]
            self._to[h[left[got]]] = values[left[got]]
            left = left[~got]
            h[left] = (h[left] + 1) & self._mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULT) >> self._shift).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        h = self._home(key)
        at = self._keys[h]
        out = np.where(at == key, self._to[h], np.int32(-1))
        open_ = np.flatnonzero((at != key) & (at >= 0))
        while len(open_):
            h[open_] = (h[open_] + 1) & self._mask
            at = self._keys[h[open_]]
            hit = at == key[open_]
            out[open_[hit]] = self._to[h[open_[hit]]]
            open_ = open_[~hit & (at >= 0)]
        return out

    def as_dict(self) -> dict[int, int]:
        some = self._keys >= 0
        return dict(zip(self._keys[some].tolist(), self._to[some].tolist(), strict=True))


class Trie:
    """Node 0 is the root. parent, char and depth by node; end: index of the string that ends there, or -1."""

    def __init__(self, strings: Iterable[str]):
        edges: dict[int, int] = {}
        parent, char, depth, end = [0], [0], [0], [-1]
        for k, x in enumerate(strings):
            node = 0
            for c in map(ord, x):
                to = edges.get(node << 21 | c)
                if to is None:
                    to = edges[node << 21 | c] = len(parent)
                    parent.append(node), char.append(c), depth.append(depth[node] + 1), end.append(-1)
                node = to
            if node and end[node] < 0:
                end[node] = k
        self.parent, self.char, self.depth, self.end = (np.array(x, np.int32) for x in (parent, char, depth, end))
        self._map = IntMap(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))

    def goto(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node by its character, or -1."""
        return self._map.get((node.astype(np.int64) << 21) | char)

    def edges(self) -> dict[int, int]:
        """The children as a dictionary by node << 21 | character."""
        return self._map.as_dict()

    def levels(self) -> Iterator[np.ndarray]:
        """The nodes of each depth from 1 on."""
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield order[a:b]

    def suffix_links(self) -> tuple[np.ndarray, np.ndarray]:
        """fail: the node of the longest proper suffix that is in the trie; out: the nearest node by failure links at which a string ends, itself not counted (0: none)."""
        fail, out = np.zeros(len(self.parent), np.int32), np.zeros(len(self.parent), np.int32)
        for own in self.levels():
            if self.depth[own[0]] > 1:
                z, c = fail[self.parent[own]], self.char[own]
                to = self.goto(z, c)
                stuck = np.flatnonzero((to < 0) & (z > 0))
                while len(stuck):
                    z[stuck] = fail[z[stuck]]
                    to[stuck] = self.goto(z[stuck], c[stuck])
                    stuck = stuck[(to[stuck] < 0) & (z[stuck] > 0)]
                fail[own] = np.maximum(to, 0)
            f = fail[own]
            out[own] = np.where(self.end[f] >= 0, f, out[f])
        return fail, out


def batches(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of the strings that are not empty, in groups of similar length that CELLS holds (or one alone)."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    sizes, a = lengths[order], 0
    while a < len(order):
        widest = 2 * int(sizes[a]) + 16
        b = int(np.searchsorted(sizes, widest, side="right"))
        fits = (np.arange(1, b - a + 1) * sizes[a:b] <= CELLS).sum()
        b = a + max(1, int(fits))
        yield order[a:b]
        a = b


def matrix(strings: list[str], width: int) -> np.ndarray:
    """Code points, one string in a row, 0 behind its end; by column for walking."""
    return np.ascontiguousarray(np.array(strings, dtype=f"U{width}").view(np.int32).reshape(len(strings), width).T)
