"""A HAT-trie: hash containers under a shallow trie over the digits of fixed-width keys.

A key is a phrase: word ids of ``width`` bits each, the first word highest. A node
has a child for each value of the next DIGIT bits, a container counts keys in an
open-addressing table small enough for a processor's cache. A container that may
hold more than BURST keys bursts into a node with containers of its own; frequent
first words so get deeper nodes. Keys come in sorted blocks without repeats, of
which a node hands each child its stretch.

Sizes bound memory only: whatever they are, counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DIGIT = 6
BURST = 1 << 15
_FREE = np.uint64(2**64 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Container:
    """Counts of keys below 2^63 by open addressing; at most half full."""

    def __init__(self, least: int = 64):
        self.n = 0
        self._room(least)

    def _room(self, keys: int) -> None:
        self.bits = max(6, (2 * keys - 1).bit_length())
        self.keys = np.full(1 << self.bits, _FREE, np.uint64)
        self.counts = np.zeros(1 << self.bits, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` without repeats."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old, of_old = self.items()
            self.n = 0
            self._room(len(old) + len(keys))
            self._place(old, of_old)
        self._place(keys, counts)

    def _place(self, keys: np.ndarray, counts: np.ndarray) -> None:
        at = ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == _FREE
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            here = self.keys[at] == keys
            self.counts[at[here]] += counts[here]
            self.n += int(np.count_nonzero(here & free))
            left = ~here
            keys, counts, at = keys[left], counts[left], (at[left] + 1) & (len(self.keys) - 1)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in ascending order and their counts."""
        full = np.flatnonzero(self.keys != _FREE)
        full = full[np.argsort(self.keys[full])]
        return self.keys[full], self.counts[full]


class Node:
    def __init__(self, shift: int):
        self.shift = shift
        self.children: list[Node | Container | None] = [None] * (1 << DIGIT)


class HatTrie:
    def __init__(self, bits: int, burst: int = BURST):
        """``bits``: of a key, 63 at most."""
        self.burst, self.n = burst, 0
        self.root = Node(max(0, bits - DIGIT))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Count ``keys`` (ascending, without repeats) so many times more."""
        self._add(self.root, keys, counts)

    def _add(self, node: Node, keys: np.ndarray, counts: np.ndarray) -> None:
        digits = (keys >> np.uint64(node.shift)) & np.uint64((1 << DIGIT) - 1)
        edges = np.searchsorted(digits, np.arange((1 << DIGIT) + 1))
        for d in np.flatnonzero(np.diff(edges)).tolist():
            part, of_part = keys[edges[d] : edges[d + 1]], counts[edges[d] : edges[d + 1]]
            child = node.children[d]
            if child is None:
                child = node.children[d] = Container(len(part))
            if isinstance(child, Container) and node.shift and child.n + len(part) > self.burst:
                child = node.children[d] = self._burst(child, node.shift)
            if isinstance(child, Node):
                self._add(child, part, of_part)
            else:
                before = child.n
                child.add(part, of_part)
                self.n += child.n - before

    def _burst(self, container: Container, shift: int) -> Node:
        node = Node(max(0, shift - DIGIT))
        keys, counts = container.items()
        self.n -= len(keys)
        self._add(node, keys, counts)
        return node

    def spill(self, leave: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take whole subtrees of the root out, largest first, until ``leave`` keys are left: each as ascending keys and their counts."""
        sizes = [(_size(c), d) for d, c in enumerate(self.root.children) if c is not None]
        for n, d in sorted(sizes, reverse=True):
            if self.n <= leave:
                return
            child, self.root.children[d] = self.root.children[d], None
            self.n -= n
            parts = list(_runs(child))
            yield np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])


def _size(child: Node | Container) -> int:
    return child.n if isinstance(child, Container) else sum(_size(c) for c in child.children if c is not None)


def _runs(child: Node | Container) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if isinstance(child, Container):
        yield child.items()
    else:
        for c in child.children:
            if c is not None:
                yield from _runs(c)
