"""Adaptive radix tree over byte strings: nodes of 4, 16, 48 or 256 places that grow as they fill, paths compressed.

Keys are sequences of fixed-width big-endian ids. Keys may be prefixes of others and end at any node.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

SIZES = (4, 16, 48, 256)


class Node:
    """``path``: bytes after the branching byte that all keys below share; ``value``: of the key that ends here.

    Up to 16 children stand beside their sorted bytes; up to 48 behind an index of all bytes; above, one place a byte.
    """

    __slots__ = ("path", "value", "room", "bytes", "kids", "count")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.room, self.count = path, value, 4, 0
        self.bytes: bytearray = bytearray()
        self.kids: list = []

    def find(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = bisect_left(self.bytes, byte)
            return self.kids[at] if at < self.count and self.bytes[at] == byte else None
        if self.room == 48:
            return self.kids[self.bytes[byte]] if self.bytes[byte] != 255 else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Adds a child or replaces the one at the byte."""
        known = self.find(byte) is not None
        if not known and self.count == self.room:
            self._grow()
        self.count += not known
        if self.room <= 16:
            at = bisect_left(self.bytes, byte)
            if known:
                self.kids[at] = kid
            else:
                self.bytes.insert(at, byte)
                self.kids.insert(at, kid)
        elif self.room == 48:
            if known:
                self.kids[self.bytes[byte]] = kid
            else:
                self.bytes[byte] = len(self.kids)
                self.kids.append(kid)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        children = list(self.children())
        self.room = SIZES[SIZES.index(self.room) + 1]
        if self.room == 48:
            self.bytes = bytearray(b"\xff" * 256)
            self.kids = [kid for _, kid in children]
            for at, (byte, _) in enumerate(children):
                self.bytes[byte] = at
        elif self.room == 256:
            self.bytes, self.kids = bytearray(), [None] * 256
            for byte, kid in children:
                self.kids[byte] = kid

    def children(self) -> Iterator[tuple[int, Node]]:
        """By rising byte."""
        if self.room <= 16:
            yield from zip(self.bytes, self.kids)
        elif self.room == 48:
            for byte in range(256):
                if self.bytes[byte] != 255:
                    yield byte, self.kids[self.bytes[byte]]
        else:
            for byte, kid in enumerate(self.kids):
                if kid is not None:
                    yield byte, kid


def _shared(a: bytes, key: bytes, at: int) -> int:
    n = min(len(a), len(key) - at)
    if a[:n] == key[at:at + n]:
        return n
    return next(i for i in range(n) if a[i] != key[at + i])


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        """Adds a key with a value that is not None, or replaces its value."""
        node, parent, at = self.root, None, 0
        while True:
            same = _shared(node.path, key, at)
            if same < len(node.path):  # the path parts here: a node of its own takes its head
                head = Node(node.path[:same])
                byte, node.path = node.path[same], node.path[same + 1:]
                head.put(byte, node)
                if parent is None:
                    self.root = head
                else:
                    parent.put(branch, head)
                node = head
            at += same
            if at == len(key):
                node.value = value
                return
            branch = key[at]
            kid = node.find(branch)
            if kid is None:
                node.put(branch, Node(key[at + 1:], value))
                return
            node, parent, at = kid, node, at + 1

    def get(self, key: bytes):
        node, at = self.root, 0
        while True:
            if key[at:at + len(node.path)] != node.path:
                return None
            at += len(node.path)
            if at == len(key):
                return node.value
            node, at = node.find(key[at]), at + 1
            if node is None:
                return None

    def upward(self) -> Iterator[tuple[Node, int, int]]:
        """(node, depth in bytes above it, depth below its path), every child before its parent."""
        todo = [(self.root, 0, False)]
        while todo:
            node, above, done = todo.pop()
            below = above + (node is not self.root) + len(node.path)
            if done:
                yield node, above, below
            else:
                todo.append((node, above, True))
                todo += [(kid, below, False) for _, kid in node.children()]
