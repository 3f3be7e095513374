"""Self-join of a binary trie of 64-bit keys under a budget of differing bits.

Node pairs go down together, carry the bits in which they differ, and are dropped beyond
the budget. Only links that join two groups are kept, and a pair of nodes whose
keys are all in one group already is dropped too, so m keys give at most m - 1 links.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FRONTIER = 20_000
PAIRS = 100_000


class Trie:
    """Several subtries over sorted keys: each is a run of keys, each node a shorter run."""

    def __init__(self, keys: np.ndarray, depth: int, errors: int, agree: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, exact: Callable[[int, int], bool] | None = None):
        """depth: bits that all keys of a run share. agree(i, j): a further test of pairs within the errors.

        exact(i, j): the last test, of one pair at a time, and only while the two are in different groups.
        """
        self.keys, self.depth, self.errors, self._agree, self._exact = keys, depth, errors, agree, exact
        self.label = np.arange(len(keys))
        self._zeros: dict[int, np.ndarray] = {}
        self.links: list[tuple[int, int]] = []
        self._mark()

    def _mark(self) -> None:
        self._change = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else self.label

    def _root(self, i: int) -> int:
        while self.label[i] != i:
            self.label[i] = i = self.label[self.label[i]]
        return i

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Keep those of the pairs that join two groups."""
        near = np.bitwise_count(self.keys[i] ^ self.keys[j]) <= self.errors
        near &= self.label[i] != self.label[j]
        if self._agree and near.any():
            at = np.flatnonzero(near)
            near[at] = np.concatenate([self._agree(i[at[k : k + PAIRS]], j[at[k : k + PAIRS]]) for k in range(0, len(at), PAIRS)])
        if not near.any():
            return
        for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
            a_root, b_root = self._root(a), self._root(b)
            if a_root != b_root and (self._exact is None or self._exact(a, b)):
                self.label[max(a_root, b_root)] = min(a_root, b_root)
                self.links.append((a, b))
        while (up := self.label[self.label]) is not self.label and (up != self.label).any():
            self.label = up
        self._mark()

    def _split(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in self._zeros:
            bit = (self.keys >> np.uint64(63 - depth)) & np.uint64(1)
            self._zeros[depth] = np.concatenate([[0], np.cumsum(bit == 0, dtype=np.int32)])
        zeros = self._zeros[depth]
        return lo + zeros[hi] - zeros[lo]

    def join(self, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
        """A forest of links between the keys of each run [lo, hi) with itself."""
        turn = np.zeros(len(self.keys) + 1, dtype=np.int64)
        turn[lo] += 1
        turn[hi - 1] -= 1
        near = np.flatnonzero(np.cumsum(turn) > 0)  # keys whose next key is in the same run
        self.link(near, near + 1)
        stack = [(self.depth, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
        while stack:
            depth, pairs = stack.pop()
            a, a_end, b, b_end, err = pairs
            done = (self._change[a_end - 1] == self._change[a]) & (self._change[b_end - 1] == self._change[b]) & (self.label[a] == self.label[b])
            pairs = pairs[:, ~done]
            if pairs.shape[1] > FRONTIER:
                stack += [(depth, part) for part in np.array_split(pairs, -(-pairs.shape[1] // FRONTIER), axis=1)]
                continue
            a, a_end, b, b_end, err = pairs
            small = (a_end - a) * (b_end - b) <= 32
            self._leaves(pairs[:, small])
            a, a_end, b, b_end, err = pairs = pairs[:, ~small]
            if not pairs.shape[1]:
                continue
            a_mid, b_mid, own = self._split(depth, a, a_end), self._split(depth, b, b_end), a == b
            children = np.concatenate(
                [
                    np.stack([a, a_mid, b_mid, b_end, err + 1]),
                    np.stack([a_mid, a_end, b, b_mid, err + 1])[:, ~own],
                    np.stack([a, a_mid, b, b_mid, err]),
                    np.stack([a_mid, a_end, b_mid, b_end, err]),
                ],
                axis=1,
            )
            alive = (children[4] <= self.errors) & (children[0] < children[1]) & (children[2] < children[3])
            if depth < 63 and alive.any():
                stack.append((depth + 1, children[:, alive]))
            elif alive.any():
                self._leaves(children[:, alive])
        return self.links

    def _leaves(self, pairs: np.ndarray) -> None:
        a, a_end, b, b_end, _ = pairs
        wide = b_end - b
        n = (a_end - a) * wide
        if not n.sum():
            return
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(wide, n)
        i, j = np.repeat(a, n) + k // width, np.repeat(b, n) + k % width
        self.link(i[i < j], j[i < j])
