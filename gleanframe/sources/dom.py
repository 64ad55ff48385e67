"""A small tree of a page, tolerant of tags that are never closed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    up: Node | None = None
    items: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """All nodes below, in page order, without recursion: pages may nest deeply."""
        todo = [x for x in reversed(self.items) if isinstance(x, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.items) if isinstance(x, Node)]

    def ancestors(self) -> Iterator[Node]:
        node = self.up
        while node is not None:
            yield node
            node = node.up

    def strings(self) -> Iterator[str]:
        todo: list[Node | str] = list(reversed(self.items))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in HIDDEN:
                todo += reversed(x.items)

    def text(self, gap: str = " ") -> str:
        """Trimmed strings that aren't blank, joined."""
        return gap.join(s for s in (x.strip() for x in self.strings()) if s)

    def raw(self) -> str:
        return "".join(x for x in self.items if isinstance(x, str))

    def links(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag == "a" and "href" in n.attrs)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.items.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root
