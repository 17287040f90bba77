"""Compressed (radix) trie of whole texts, with the least id of each at its terminal.

An edge holds the characters that all texts below it share, so a text is stored once
however many rows repeat it, and texts with a common beginning share that.
"""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    __slots__ = ("edge", "children", "least", "rows")

    def __init__(self, edge: str):
        self.edge = edge
        self.children: dict[str, Node] = {}
        self.least: int | None = None
        # what is known of the text that ends here; None where none does
        self.rows: list | None = None


def shared_length(a: str, b: str, start: int) -> int:
    """How many characters ``a`` has in common with ``b`` from ``start`` on."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[start + low : start + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class TextTrie:
    def __init__(self) -> None:
        self.root = Node("")
        # characters and rows held, which is what the memory of the trie grows with
        self.weight = 0

    def terminal(self, text: str) -> Node:
        """The node at which ``text`` ends, made where there is none."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = Node(text[at:])
                node.children[text[at]] = child
                self.weight += len(child.edge)
            elif not text.startswith(child.edge, at):
                n = shared_length(child.edge, text, at)
                upper = Node(child.edge[:n])
                child.edge = child.edge[n:]
                upper.children[child.edge[0]] = child
                node.children[text[at]] = upper
                child = upper
            node, at = child, at + len(child.edge)
        return node

    def insert(self, text: str, doc_id: int, row: tuple) -> None:
        """Adds a row of ``text``; its terminal keeps the least id of all of them."""
        node = self.terminal(text)
        if node.rows is None:
            node.rows = []
        if node.least is None or doc_id < node.least:
            node.least = doc_id
        node.rows.append((doc_id, *row))
        self.weight += 64

    def terminals(self) -> Iterator[tuple[str, Node]]:
        """Every text with its terminal, depth first."""
        stack = [(self.root, "")]
        while stack:
            node, above = stack.pop()
            text = above + node.edge
            if node.rows is not None:
                yield text, node
            for child in node.children.values():
                stack.append((child, text))
