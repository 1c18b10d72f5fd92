"""A small tree of a page and the few ways of looking into it that the readers need."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "template"))
NONE = frozenset()


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "classes", "page", "first_below", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, page: list[Node]):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.classes = frozenset(attrs["class"].split()) if "class" in attrs else NONE
        # the page's elements in the order in which they begin; those below one lie together
        page.append(self)
        self.page, self.first_below, self.end = page, len(page), 0

    def walk(self) -> Iterator[Node]:
        """All elements below, in page order."""
        return iter(self.page[self.first_below : self.end])

    def text(self, spaced: bool = False, skip: frozenset = frozenset()) -> str:
        """The text below; spaced puts a space between its pieces."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in skip:
                stack.extend(reversed(n.children))
        return " ".join((" " if spaced else "").join(out).split())

    def has(self, *classes: str) -> bool:
        return self.classes.issuperset(classes)

    def find(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def first_text(self, test: Callable[[Node], bool]) -> str:
        n = self.first(test)
        return n.text() if n else ""


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page: list[Node] = []
        self.root = self.at = Node("root", {}, None, self.page)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, self.page)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


@lru_cache(maxsize=2)
def parse(html: str | None) -> Node:
    """The tree of a page; the last two are kept, as several readers look into one page. None of them changes it."""
    b = Builder()
    b.feed(html or "")
    b.close()
    for n in reversed(b.page):
        n.end = max(n.end, n.first_below)
        if n.parent:
            n.parent.end = max(n.parent.end, n.end)
    return b.root


def cls(*names: str) -> Callable[[Node], bool]:
    """An element with one of the classes."""
    return lambda n: not n.classes.isdisjoint(names)


def tag(*names: str) -> Callable[[Node], bool]:
    return lambda n: n.tag in names


def meta(root: Node, *names: str) -> str:
    """The first content of a meta element of one of the names, in their order."""
    for name in names:
        if (n := root.first(lambda x: x.tag == "meta" and name in (x.attrs.get("property"), x.attrs.get("name")))) and n.attrs.get("content"):
            return n.attrs["content"].strip()
    return ""


LD = re.compile(r"<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.I | re.S)


def json_ld(html: str | None) -> Iterator[object]:
    """The page's JSON-LD blocks that can be read."""
    if "ld+json" not in (html or "").lower():
        return
    for m in LD.finditer(html):
        try:
            yield json.loads(m[1].strip())
        except ValueError:
            continue


def nodes(data: object, depth: int) -> Iterator[dict]:
    """All objects of parsed JSON, outer before inner, no deeper than depth."""
    if depth < 0:
        return
    if isinstance(data, dict):
        yield data
        for v in data.values():
            yield from nodes(v, depth - 1)
    elif isinstance(data, list):
        for v in data:
            yield from nodes(v, depth - 1)


def number(value: object) -> float | None:
    """The number a value begins with, signs of money and grouping left out."""
    m = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)", re.sub(r"[$,]", "", str(value)) if value is not None else "")
    return float(m[0]) if m else None
