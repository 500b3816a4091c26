"""A small document tree for the page extractors: the standard library's tokenizer and the
selectors that shop pages need (tag, #id, .class, [attr], [attr=v], [attr*=v], descendant and
child, comma lists). Python-side helper of ``operators.pages``; one page is one row."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser
from itertools import islice

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset(("script", "style"))
#: An open element of the first kind is closed by a start tag of the second. Fixed values.
_CLOSED_BY = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class Element:
    """An element of a page. ``nodes`` are all elements of the page in document order, ``places`` the places there of each tag, #id and .class;
    those below an element stand from behind ``place`` up to ``end``."""

    __slots__ = ("tag", "attrs", "children", "parent", "nodes", "places", "place", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> list[Element]:
        """The elements below, in document order."""
        return self.nodes[self.place + 1 : self.end]

    def _found(self, key: str | None, chain: list) -> Iterator[int]:
        """The places of the matches of one alternative of a selector, whose last part has the tag, #id or .class ``key``."""
        nodes, end = self.nodes, self.end
        places = range(self.place + 1, end) if key is None else self.places.get(key, ())
        for i in range(0 if key is None else bisect_right(places, self.place), len(places)):
            if (place := places[i]) >= end:
                return
            if _matches(nodes[place], chain):
                yield place

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(parts)

    def inner(self) -> str:
        """The markup below."""
        return "".join(c.outer() if isinstance(c, Element) else escape(c, quote=False) for c in self.children)

    def outer(self) -> str:
        # Apostrophes stay as they are: patterns that read scripts in attributes look for them.
        attrs = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" if self.tag in _VOID else f"<{self.tag}{attrs}>{self.inner()}</{self.tag}>"

    def all(self, selector: str) -> list[Element]:
        """The elements below that a selector matches, in document order."""
        found = [place for key, chain in _compiled(selector) for place in self._found(key, chain)]
        return [self.nodes[place] for place in sorted(set(found))]

    def first(self, *selectors: str) -> Element | None:
        """The first match of the first selector that has one."""
        for s in selectors:
            found = [place for key, chain in _compiled(s) for place in islice(self._found(key, chain), 1)]
            if found:
                return self.nodes[min(found)]
        return None

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root", {}, None)
        self.nodes = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSED_BY.get(self.at.tag, ()):
            self.at = self.at.parent
        if tag == "tr" and self.at.tag == "tr":
            self.at = self.at.parent
        node = Element(tag, {}, self.at)
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.at.children.append(node)
        self.nodes.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


#: One piece of plain markup: an end tag, a start tag whose attributes are in double quotes and free of references, or text. On these the standard
#: tokenizer and this pattern agree, and the pattern is several times faster. Names of elements whose content is no markup are left out.
_PLAIN = re.compile(r"""</([a-z][a-z0-9]*)>|<(?!(?:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext|svg|math)\b)([a-z][a-z0-9]*)((?:[ \n]+[a-z][a-z0-9:_-]*="[^"&<>]*")*)[ \n]*>|([^<&]+)""")
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9:_-]*)="([^"]*)\"""")


def _built(html: str) -> _Builder:
    builder, at = _Builder(), 0
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            break
        at, kind = m.end(), m.lastindex
        if kind == 4:
            builder.handle_data(m[4])
        elif kind == 1:
            builder.handle_endtag(m[1])
        else:
            builder.handle_starttag(m[2], _ATTRIBUTE.findall(m[3]))
    if at == len(html):
        return builder
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder


def parse(html: str | None) -> Element:
    builder = _built(html or "")
    nodes, places = builder.nodes, {}
    for place, node in enumerate(nodes):
        node.nodes, node.places, node.place, node.end = nodes, places, place, place + 1
        keys = {node.tag}
        if ident := node.attrs.get("id"):
            keys.add(f"#{ident}")
        if classes := node.attrs.get("class"):
            keys.update(f".{c}" for c in classes.split())
        for key in keys:
            if key in places:
                places[key].append(place)
            else:
                places[key] = [place]
    for node in reversed(nodes[1:]):
        if node.parent.end < node.end:
            node.parent.end = node.end
    return builder.root


_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:(\*?=)["']?([^"'\]]*)["']?)?\]""")


@lru_cache(maxsize=512)
def _compiled(selector: str) -> list[tuple[str | None, list[tuple[str, list[tuple]]]]]:
    """Each alternative as its key, under which ``Element.places`` has the elements that its last part may match, and (joint to the left, tests) from
    the right to the left."""
    out = []
    for part in selector.split(","):
        chain, joint = [], " "
        for token in part.replace(">", " > ").split():
            if token == ">":
                joint = ">"
                continue
            chain.append((joint, [m.groups() for m in _SIMPLE.finditer(token)]))
            joint = " "
        keys = [f"#{ident}" if ident else f".{cls}" if cls else tag.lower() for tag, ident, cls, *_ in chain[-1][1] if ident or cls or (tag and tag != "*")]
        out.append((min(keys, default=None), chain[::-1]))  # an id before a class before a tag
    return out


def _passes(node: Element, tests: list[tuple]) -> bool:
    for tag, ident, cls, attr, how, value in tests:
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if attr:
            have = node.attrs.get(attr)
            if have is None or (how == "=" and have != value) or (how == "*=" and value not in have):
                return False
    return True


def _matches(node: Element, chain: list[tuple[str, list[tuple]]], at: int = 0) -> bool:
    joint, tests = chain[at]
    if not _passes(node, tests):
        return False
    if at + 1 == len(chain):
        return True
    above = node.parent
    while above is not None:
        if _matches(above, chain, at + 1):
            return True
        if joint == ">":
            return False
        above = above.parent
    return False
