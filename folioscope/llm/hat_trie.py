"""Counts of short word sequences in a HAT-trie of bounded size.

A word is a number, a sequence one 63-bit key: the first word in the highest
bits, zeros where a sequence is shorter. So the sequences with one prefix are
one range of keys. The trie has a level for each word; a node's children are
ranges of the next word's numbers, each a hash container of keys. A container
that grows too large bursts: into containers of narrower ranges, or, if all its
keys go on with the same word, into a node one level down.

Keys are added sorted, so a container is looked at once per call. When the
trie is full, whole subtrees leave it as runs sorted by key, largest first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

#: Keys of a container before it bursts, and ranges it bursts into.
BURST, FAN = 1 << 16, 16


class Node:
    """The sequences that share ``depth`` words; child ``i`` holds the keys from ``lows[i]`` on."""

    __slots__ = ("depth", "lows", "children")

    def __init__(self, depth: int, low: int, child: Counter):
        self.depth, self.lows, self.children = depth, [low], [child]

    def keys(self) -> int:
        return sum(map(size, self.children))


def size(child: Node | Counter) -> int:
    return len(child) if isinstance(child, Counter) else child.keys()


def containers(child: Node | Counter) -> Iterator[Counter]:
    if isinstance(child, Counter):
        yield child
    else:
        for c in child.children:
            yield from containers(c)


def run_of(child: Node | Counter) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a subtree, sorted, and their counts."""
    keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for c in containers(child):  # in the order of their ranges
        k, n = np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))
        order = np.argsort(k)
        keys.append(k[order])
        counts.append(n[order])
    return np.concatenate(keys), np.concatenate(counts)


class HatTrie:
    def __init__(self, words: int, burst: int = BURST):
        self.words, self.bits, self.burst = words, 63 // words, burst
        self.root = Node(0, 0, Counter())

    def shift(self, depth: int) -> int:
        """Bits below the word after ``depth`` words."""
        return self.bits * (self.words - depth - 1)

    def keys_of(self, ids: np.ndarray, known: int = 0) -> np.ndarray:
        """The sorted keys of all sequences of one to ``words`` words in ``ids``
        that do not end among the first ``known``; 0 ends a piece of text."""
        key, whole = ids << self.shift(0), ids > 0
        out = [key[known:][whole[known:]]]
        for m in range(1, self.words):
            key = key[:-1] | ids[m:] << self.shift(m)
            whole = whole[:-1] & (ids[m:] > 0)
            new = max(0, known - m)
            out.append(key[new:][whole[new:]])
        return np.sort(np.concatenate(out))

    def add(self, keys: np.ndarray) -> None:
        """Counts sorted keys, repeats included."""
        self._add(self.root, keys)

    def _add(self, node: Node, keys: np.ndarray) -> None:
        ends = [*np.searchsorted(keys, node.lows[1:]).tolist(), len(keys)]
        for i in range(len(ends) - 1, -1, -1):
            here = keys[ends[i - 1] if i else 0:ends[i]]
            if not len(here):
                continue
            child = node.children[i]
            if isinstance(child, Node):
                self._add(child, here)
            else:
                child.update(here.tolist())
                if len(child) > self.burst:
                    self._burst(node, i)

    def _burst(self, node: Node, i: int) -> None:
        old = node.children[i]
        keys = np.sort(np.fromiter(old, np.int64, len(old)))
        shift = self.shift(node.depth)
        word = keys >> shift
        if word[0] == word[-1]:
            if node.depth + 1 < self.words:
                node.children[i] = below = Node(node.depth + 1, node.lows[i], old)
                self._burst(below, 0)
            return
        firsts = np.unique(word[np.arange(1, FAN) * len(word) // FAN])
        firsts = firsts[firsts > word[0]]
        if not len(firsts):
            firsts = word[:1] + 1  # one word has nearly all keys: a container of its own
        lows = (firsts << shift).tolist()
        parts = np.split(keys, np.searchsorted(keys, lows))
        node.lows[i:i + 1] = [node.lows[i], *lows]
        node.children[i:i + 1] = [Counter({k: old[k] for k in part.tolist()}) for part in parts]
        for j in range(len(parts) - 1, -1, -1):
            if len(parts[j]) > self.burst:
                self._burst(node, i + j)

    def __len__(self) -> int:
        return self.root.keys()

    def spill(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of whole subtrees, largest first, until at most ``keep`` keys are left."""
        left = len(self)
        for i in sorted(range(len(self.root.children)), key=lambda i: -size(self.root.children[i])):
            child = self.root.children[i]
            n = size(child)
            if left <= keep or not n:
                break
            yield run_of(child)
            self.root.children[i] = Counter()
            left -= n
        if not left:
            self.root = Node(0, 0, Counter())
