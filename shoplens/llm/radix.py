"""Adaptive radix tree over byte strings of fixed-width symbols.

A node holds the bytes that all its keys share from where its parent ended
(path compression) and its children by their first byte, in one of four
layouts that grow with their number: up to 4 and up to 16 children as sorted
bytes beside a list, up to 48 as a table of 256 slots into a list, beyond
that as a list of 256. A key may end inside another (a sequence that is the
beginning of a longer one); ``end`` holds what was stored under it.
"""

from __future__ import annotations

from collections.abc import Iterator

SMALL, MIDDLE, LARGE = 4, 16, 48


class Node:
    __slots__ = ("path", "room", "keys", "kids", "end")

    def __init__(self, path: bytes, end=None):
        self.path, self.end = path, end
        self.room, self.keys, self.kids = SMALL, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.room <= MIDDLE:
            i = self.keys.find(byte)
            return self.kids[i] if i >= 0 else None
        if self.room == LARGE:
            return self.kids[self.keys[byte] - 1] if self.keys[byte] else None
        return self.kids[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add a child under a byte that has none, or replace the one it has."""
        if self.room <= MIDDLE:
            i = self.keys.find(byte)
            if i >= 0:
                self.kids[i] = node
            elif len(self.kids) < self.room:
                i = sum(k < byte for k in self.keys)
                self.keys.insert(i, byte)
                self.kids.insert(i, node)
            else:
                self._grow()
                self.put(byte, node)
        elif self.room == LARGE:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = node
            elif len(self.kids) < LARGE:
                self.kids.append(node)
                self.keys[byte] = len(self.kids)
            else:
                self._grow()
                self.put(byte, node)
        else:
            self.kids[byte] = node

    def _grow(self) -> None:
        if self.room == SMALL:
            self.room = MIDDLE
        elif self.room == MIDDLE:
            slots = bytearray(256)
            for i, k in enumerate(self.keys):
                slots[k] = i + 1
            self.room, self.keys = LARGE, slots
        else:
            wide = [None] * 256
            for byte, slot in enumerate(self.keys):
                if slot:
                    wide[byte] = self.kids[slot - 1]
            self.room, self.keys, self.kids = 256, None, wide

    def children(self) -> Iterator[Node]:
        """In the order of their bytes."""
        if self.room <= MIDDLE:
            return iter(self.kids)
        if self.room == LARGE:
            return (self.kids[slot - 1] for slot in self.keys if slot)
        return (k for k in self.kids if k is not None)


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning of two byte strings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n                                   # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        """Store ``value`` under a key that is not in the tree yet."""
        node, at, above = self.root, 0, None
        while True:
            n = common(node.path, key[at:at + len(node.path)])
            if n < len(node.path):                  # the key leaves inside the path: split it
                upper = Node(node.path[:n])
                node.path = node.path[n:]
                upper.put(node.path[0], node)
                above.put(upper.path[0], upper)
                node = upper
            at += n
            if at == len(key):
                node.end = value
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at:], value))
                return
            node, above = below, node

    def trail(self, key: bytes) -> set[int]:
        """Identities of the nodes on the way of a key that is in the tree."""
        node, at, out = self.root, 0, {id(self.root)}
        while at < len(key):
            node = node.child(key[at])
            out.add(id(node))
            at += len(node.path)
        return out

    def walk(self) -> Iterator[tuple[Node, int]]:
        """Every node with the byte depth where its path ends, children first,
        without recursion (a long key is a deep tree)."""
        stack: list[tuple[Node, int, Iterator]] = [(self.root, 0, self.root.children())]
        while stack:
            node, depth, kids = stack[-1]
            below = next(kids, None)
            if below is None:
                stack.pop()
                yield node, depth
            else:
                stack.append((below, depth + len(below.path), below.children()))
