"""An adaptive radix tree over byte strings of one alignment, as tasks use it to share prefixes.

Inner nodes hold 4, 16, 48 or 256 children in layouts that grow as children come, and the
bytes that all their keys share on the way to them (path compression).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Node:
    """``path``: bytes from the parent's branch byte on; ``count`` keys pass, ``least`` is their smallest number, ``ends`` stop here.

    Up to 16 children: sorted branch bytes beside the children.  Up to 48: a table from byte to place.  Beyond: a place for each byte.
    """

    __slots__ = ("path", "count", "least", "ends", "size", "keys", "kids")
    LAYOUTS = (4, 16, 48, 256)

    def __init__(self, path: bytes, count: int, least: int, ends: int):
        self.path, self.count, self.least, self.ends = path, count, least, ends
        self.size, self.keys, self.kids = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.size <= 16:
            at = bisect_left(self.keys, byte)
            return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None
        if self.size == 48:
            return self.kids[self.keys[byte] - 1] if self.keys[byte] else None
        return self.kids[byte]

    def put(self, byte: int, node: Node) -> None:
        """Adds a child, or replaces the one at that byte."""
        if self.size <= 16:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.kids[at] = node
            elif len(self.keys) < self.size:
                self.keys.insert(at, byte)
                self.kids.insert(at, node)
            else:
                self._grow()
                self.put(byte, node)
        elif self.size == 48:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = node
            elif len(self.kids) < 48:
                self.kids.append(node)
                self.keys[byte] = len(self.kids)
            else:
                self._grow()
                self.put(byte, node)
        else:
            self.kids[byte] = node

    def _grow(self) -> None:
        known = list(self.children())
        self.size = self.LAYOUTS[self.LAYOUTS.index(self.size) + 1]
        if self.size == 16:
            return
        self.keys, self.kids = bytearray(256), [] if self.size == 48 else [None] * 256
        for byte, node in known:
            self.put(byte, node)

    def children(self) -> Iterator[tuple[int, Node]]:
        """Children in the order of their bytes."""
        if self.size <= 16:
            yield from zip(self.keys, self.kids, strict=True)
        elif self.size == 48:
            yield from ((byte, self.kids[place - 1]) for byte, place in enumerate(self.keys) if place)
        else:
            yield from ((byte, node) for byte, node in enumerate(self.kids) if node is not None)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 1:
        mid = (lo + n) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            n = mid
    return lo


class RadixTree:
    """Keys with a number each; equal keys may be inserted any number of times."""

    def __init__(self) -> None:
        self.root: Node | None = None
        self.bytes = 0

    def insert(self, key: bytes, number: int) -> None:
        self.bytes += len(key) + 64
        parent, byte, node, at = None, 0, self.root, 0
        while node is not None:
            path = node.path
            same = len(path) if key.startswith(path, at) else _shared(path, key[at : at + len(path)])
            if same < len(path):  # the key leaves within the path: a node comes between
                above = Node(path[:same], node.count, node.least, 0)
                node.path = path[same + 1 :]
                above.put(path[same], node)
                self._link(parent, byte, above)
                node = above
            at += same
            node.count += 1
            node.least = min(node.least, number)
            if at == len(key):
                node.ends += 1
                return
            parent, byte = node, key[at]
            node, at = node.child(byte), at + 1
        self._link(parent, byte, Node(key[at:], 1, number, 1))

    def _link(self, parent: Node | None, byte: int, node: Node) -> None:
        if parent is None:
            self.root = node
        else:
            parent.put(byte, node)

    def prefixes(self, width: int) -> Iterator[tuple[bytes, int, int]]:
        """(prefix, keys that start with it, their smallest number) for all prefixes whose length is a multiple of ``width``, parents first."""
        stack = [(self.root, b"")] if self.root is not None else []
        while stack:
            node, before = stack.pop()
            whole = before + node.path
            first = -(-len(before) // width) * width
            for end in range(first, len(whole) + 1, width):
                yield whole[:end], node.count, node.least
            stack.extend((kid, whole + bytes([byte])) for byte, kid in reversed(list(node.children())))
