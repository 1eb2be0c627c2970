"""Elements of web pages, found by CSS selectors."""

from __future__ import annotations

import functools
import html.parser
import re
from dataclasses import dataclass, field

#: Elements that have no end tag, and such as hold no text to read (fixed values).
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
HIDDEN = frozenset(("script", "style", "template", "noscript"))

_PART = re.compile(r"""([.#]?)([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*["']?([^"'\]]*?)["']?\s*)?\]|(\*)""")
_HOLDS = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(f"{want}-"),
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "*=": lambda have, want: bool(want) and want in have,
}


@dataclass
class Element:
    """An element, its parent's number, and which of the page's strings lie in it: a stretch, as they are in reading order."""

    tag: str
    attrs: dict[str, str]
    parent: int
    begin: int
    end: int = -1


class Page(html.parser.HTMLParser):
    """A page's elements in document order and its strings in reading order. An end tag closes what is open within."""

    def __init__(self, text: str | None):
        super().__init__()
        self.elements: list[Element] = []
        self.strings: list[str] = []
        self._open: list[int] = []
        self.feed(text or "")
        self.close()
        for i in self._open:
            self.elements[i].end = len(self.strings)

    def handle_starttag(self, tag, attrs):
        at = len(self.strings)
        self.elements.append(Element(tag, {k: v or "" for k, v in attrs}, self._open[-1] if self._open else -1, at, at))
        if tag not in VOID:
            self._open.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        if any(self.elements[i].tag == tag for i in self._open):
            while True:
                e = self.elements[self._open.pop()]
                e.end = len(self.strings)
                if e.tag == tag:
                    return

    def handle_data(self, data):
        if data.strip():
            self.strings.append(data.strip())

    def select(self, selector: str) -> list[Element]:
        """What a selector finds, in document order: names, ``*``, ``.class``, ``#id`` and ``[attribute]`` tests, in any combination,
        within one another (a space), as children (``>``), or in lists (a comma)."""
        chains = parsed(selector)
        return [e for i, e in enumerate(self.elements) if any(self._fits(i, chain) for chain in chains)]

    def _fits(self, i: int, chain: tuple[Step, ...]) -> bool:
        """Looks from the last step up; of all elements that may be an outer step's, every one is kept in view."""
        if not chain[-1].fits(self.elements[i]):
            return False
        at = {i}
        for step, inner in zip(chain[-2::-1], chain[:0:-1], strict=True):
            above = {self.elements[j].parent for j in at} - {-1}
            if not inner.child:
                waiting = list(above)
                while waiting:
                    j = self.elements[waiting.pop()].parent
                    if j >= 0 and j not in above:
                        above.add(j)
                        waiting.append(j)
            at = {j for j in above if step.fits(self.elements[j])}
            if not at:
                return False
        return True

    def text(self, within: Element | None = None, without: list[Element] = ()) -> str:
        """The strings of an element or the page, a line each, without what is hidden and what lies in ``without``."""
        begin, end = (within.begin, within.end) if within else (0, len(self.strings))
        out, at = [], begin
        for a, b in sorted((e.begin, e.end) for e in [*without, *(e for e in self.elements if e.tag in HIDDEN)]):
            if a < end and b > at:
                out += self.strings[at : max(a, at)]
                at = b
        return "\n".join([*out, *self.strings[at:end]])


@dataclass(frozen=True)
class Step:
    """One of a selector's steps; ``child`` if its parent, and not any element around it, is the step before."""

    tag: str | None = None
    classes: frozenset[str] = frozenset()
    id: str | None = None
    tests: tuple[tuple[str, str, str], ...] = field(default=())
    child: bool = False

    def fits(self, e: Element) -> bool:
        if self.tag not in (None, e.tag) or (self.id is not None and e.attrs.get("id") != self.id):
            return False
        if not self.classes <= set(e.attrs.get("class", "").split()):
            return False
        return all(name in e.attrs and (not how or _HOLDS[how](e.attrs[name], want)) for name, how, want in self.tests)


def _step(text: str, child: bool) -> Step:
    tag, ident, classes, tests, at = None, None, set(), [], 0
    for m in _PART.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        mark, name, attribute, how, value, _ = m.groups()
        if attribute:
            tests.append((attribute.lower(), how or "", value or ""))
        elif name and mark == ".":
            classes.add(name)
        elif name and mark == "#":
            ident = name
        elif name:
            tag = name.lower()
    if at != len(text):
        raise ValueError(f"not a selector: {text}")
    return Step(tag, frozenset(classes), ident, tuple(tests), child)


def listed(selector: str) -> list[str]:
    """The selectors of a list."""
    return [s.strip() for s in re.split(r",(?![^\[]*\])", selector) if s.strip()]


@functools.lru_cache(256)
def parsed(selector: str) -> tuple[tuple[Step, ...], ...]:
    """The chains of steps of a selector list; what is no selector is a ``ValueError``."""
    chains = []
    for one in listed(selector):
        steps: list[Step] = []
        child = False
        for token in re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+|\[", one):
            if token == ">":
                if child or not steps:
                    raise ValueError(f"not a selector: {one}")
                child = True
            else:
                steps.append(_step(token, child))
                child = False
        if child or not steps:
            raise ValueError(f"not a selector: {one}")
        chains.append(tuple(steps))
    return tuple(chains)
