"""Small helper: read selected parts of one saved page with the stdlib parser.

Selectors are a tag with an optional ``.class``, ``[attr]`` or ``[attr='value']``,
and may have two steps (``div[role='group'] button``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without an end tag; elements whose text is never
# shown; elements that start a new line.
VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
HIDDEN = frozenset(("script", "style", "template", "noscript"))
BLOCKS = frozenset(
    "address article aside blockquote dd div dl dt footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table tr ul".split()
)
STEP = re.compile(r"^([\w-]*)(?:\.([\w-]+))?(?:\[([\w-]+)(?:=['\"]?([^'\"\]]*)['\"]?)?\])?$")


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parent: "Element | None"
    order: int
    children: list = field(default_factory=list)

    def below(self):
        """Elements inside this one, in page order."""
        waiting = [c for c in reversed(self.children) if isinstance(c, Element)]
        while waiting:
            element = waiting.pop()
            yield element
            waiting.extend(c for c in reversed(element.children) if isinstance(c, Element))

    def matches(self, step: str) -> bool:
        tag, cls, attr, value = STEP.match(step).groups()
        return (
            (not tag or tag == self.tag)
            and (not cls or cls in self.attrs.get("class", "").split())
            and (not attr or attr in self.attrs)
            and (value is None or self.attrs.get(attr) == value)
        )

    def find_all(self, selector: str) -> list["Element"]:
        found: dict[int, Element] = {self.order: self}
        for step in selector.split():
            found = {
                e.order: e for base in found.values() for e in base.below() if e.matches(step)
            }
        return [found[k] for k in sorted(found)]

    def find(self, selector: str) -> "Element | None":
        return next(iter(self.find_all(selector)), None)

    def text(self) -> str:
        """Shown text: one line per block or ``br``, blanks collapsed inside a line."""
        parts: list[str] = []
        waiting: list = [self]
        while waiting:
            node = waiting.pop()
            if isinstance(node, str):
                parts.append(node.replace("\n", " "))
            elif node is BREAK or node.tag == "br":
                parts.append("\n")
            elif node.tag not in HIDDEN:
                edge = [BREAK] if node.tag in BLOCKS else []
                waiting.extend([*edge, *reversed(node.children), *edge])
        lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
        return "\n".join(line for line in lines if line)


BREAK = Element("br", {}, None, 0)


class PageReader(HTMLParser):
    """Builds the element tree; an end tag closes back to its nearest start tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.count = 0
        self.root = Element("", {}, None, 0)
        self.open = self.root

    def handle_starttag(self, tag, attrs):
        self.count += 1
        element = Element(tag, {k: v or "" for k, v in attrs}, self.open, self.count)
        self.open.children.append(element)
        if tag not in VOID:
            self.open = element

    def handle_startendtag(self, tag, attrs):
        before = self.open
        self.handle_starttag(tag, attrs)
        self.open = before

    def handle_endtag(self, tag):
        element = self.open
        while element.parent is not None and element.tag != tag:
            element = element.parent
        if element.parent is not None:
            self.open = element.parent

    def handle_data(self, data):
        self.open.children.append(data)


def read_page(page: str | None) -> Element:
    reader = PageReader()
    reader.feed(page or "")
    reader.close()
    return reader.root
