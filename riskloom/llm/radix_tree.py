"""Adaptive radix tree over byte strings, as used by the conversation trie."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Node:
    """A node with a compressed prefix and children by their next byte.

    The layout grows with the number of children: up to 4 and up to 16 a sorted list of
    bytes beside the children, up to 48 a table of 256 places into the children,
    beyond that a child slot for every byte.
    """

    __slots__ = ("prefix", "value", "layout", "bytes", "children", "n")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value = prefix, value
        self.layout, self.bytes, self.children, self.n = 0, bytearray(), [], 0

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = bisect_left(self.bytes, byte)
            return self.children[at] if at < self.n and self.bytes[at] == byte else None
        if self.layout == 48:
            place = self.bytes[byte]
            return self.children[place - 1] if place else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add a child, or replace the one of that byte."""
        if self.child(byte) is not None:
            if self.layout <= 16:
                self.children[bisect_left(self.bytes, byte)] = node
            elif self.layout == 48:
                self.children[self.bytes[byte] - 1] = node
            else:
                self.children[byte] = node
            return
        if self.n == self.layout:
            self._grow()
        if self.layout <= 16:
            at = bisect_left(self.bytes, byte)
            self.bytes.insert(at, byte)
            self.children.insert(at, node)
        elif self.layout == 48:
            self.children.append(node)
            self.bytes[byte] = len(self.children)
        else:
            self.children[byte] = node
        self.n += 1

    def _grow(self) -> None:
        entries = list(self.entries())
        self.layout = {0: 4, 4: 16, 16: 48, 48: 256}[self.layout]
        if self.layout == 48:
            self.bytes, self.children = bytearray(256), [c for _, c in entries]
            for place, (byte, _) in enumerate(entries, 1):
                self.bytes[byte] = place
        elif self.layout == 256:
            self.bytes, self.children = bytearray(), [None] * 256
            for byte, c in entries:
                self.children[byte] = c

    def entries(self) -> Iterator[tuple[int, Node]]:
        """Children in the order of their bytes."""
        if self.layout <= 16:
            yield from zip(self.bytes, self.children, strict=True)
        elif self.layout == 48:
            yield from ((b, self.children[p - 1]) for b, p in enumerate(self.bytes) if p)
        else:
            yield from ((b, c) for b, c in enumerate(self.children) if c is not None)


class RadixTree:
    """Maps keys to values; keys may be beginnings of other keys."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        """``value`` is not None; a key that is there gets the new value."""
        node, at, above, edge = self.root, 0, None, 0
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                same = 0
                while same < len(prefix) and at + same < len(key) and prefix[same] == key[at + same]:
                    same += 1
                # The paths part inside the compressed prefix: a new node takes its head.
                head = Node(prefix[:same])
                head.put(prefix[same], node)
                node.prefix = prefix[same + 1 :]
                if above is None:
                    self.root = head
                else:
                    above.put(edge, head)
                node = head
                at += same
            else:
                at += len(prefix)
            if at == len(key):
                node.value = value
                return
            byte = key[at]
            below = node.child(byte)
            if below is None:
                node.put(byte, Node(key[at + 1 :], value))
                return
            above, edge, node = node, byte, below
            at += 1

    def walk(self) -> Iterator[tuple[Node, int, int, bytes]]:
        """Nodes before their children, in key order: node, where its bytes start and end, its bytes.

        A node's bytes are the edge that leads to it and its prefix.
        """
        todo = [(self.root, 0, b"")]
        while todo:
            node, start, edge = todo.pop()
            own = edge + node.prefix
            yield node, start, start + len(own), own
            below = [(c, start + len(own), bytes([b])) for b, c in node.entries()]
            todo.extend(reversed(below))
