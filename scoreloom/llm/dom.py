"""A small, forgiving HTML reader: block elements and text runs as arrays of tree nodes."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Element classes of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Raw text up to the element's own end tag, or to the end of the page.
RAW = {"script", "style", "iframe", "noembed", "noframes", "title", "textarea"}
#: Elements whose text is not emitted; without an own end tag, the end of an element around them ends them.
HIDDEN = {"template", "noscript", "select", "button", "svg", "object", "audio", "video", "canvas", "datalist"}
#: Of these, those that hold no blocks and not one another: a block or the next one ends them if their end tag is missing.
INLINE = {"select", "button", "datalist"}
BLOCKS = {"html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "label", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "caption", "tbody", "tfoot", "thead", "tr", "td", "th", "ul"}
#: A start tag ends an open element of these kinds, up to the element that bounds the search.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
}
SCOPE = {"table", "td", "th", "caption", "html"}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z/!?][^>]*\Z",
    re.S,
)
#: The slash of an empty element, not one of an unquoted value.
EMPTY = re.compile(r"(?:^|[\s\"'])/\s*\Z")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Node:
    """A block element, or a run of text (tag ``#text``) within one."""

    tag: str
    parent: int
    depth: int
    attributes: str = ""
    text: str = ""
    linked: int = 0
    mark: bool = False


@dataclass
class _Reader:
    nodes: list[Node] = field(default_factory=lambda: [Node("#root", -1, 0)])
    stack: list[int] = field(default_factory=lambda: [0])
    run: list[str] = field(default_factory=list)
    link: bool = False
    linked: int = 0
    #: Open elements below the lowest one on the stack, by tag.
    deep: Counter = field(default_factory=Counter)

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                top = self.stack[-1]
                self.nodes.append(Node("#text", top, self.nodes[top].depth + 1, text=text, linked=min(self.linked, len(text))))
            self.run, self.linked = [], 0

    def characters(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.run.append(text)
        if self.link:
            self.linked += len(text.strip())

    def close(self, names: set[str], bounds: set[str]) -> bool:
        """End the innermost open element of ``names``, and all inside it, unless a bound comes first."""
        if self.deep:
            for tag in names:
                if self.deep[tag] > 0:
                    self.deep[tag] -= 1
                    return True
            if any(self.deep[tag] > 0 for tag in bounds):
                return False
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.nodes[self.stack[i]].tag
            if tag in names:
                del self.stack[i:]
                self.deep.clear()
                return True
            if tag in bounds:
                return False
        return False

    def open(self, tag: str, attributes: str) -> None:
        self.flush()
        self.link = False
        if tag in ENDS:
            while self.close(*ENDS[tag]):
                pass
        else:
            self.close({"p"}, SCOPE)
        if tag[0] == "h" and tag[1:].isdigit() and not +self.deep and self.nodes[self.stack[-1]].tag[1:].isdigit():
            self.stack.pop()
        top = self.stack[-1]
        self.nodes.append(Node(tag, top, self.nodes[top].depth + 1, attributes))
        if tag == "hr":
            return
        if len(self.stack) < 200 and not +self.deep:
            self.stack.append(len(self.nodes) - 1)
        else:
            self.deep[tag] += 1

    def has(self, tag: str) -> bool:
        """Whether an element of this tag is open."""
        return self.deep[tag] > 0 or any(self.nodes[i].tag == tag for i in self.stack)


@dataclass
class _Hidden:
    """An open element whose text is not emitted: how often it is nested, and the blocks open within it."""

    tag: str
    unclosed: bool
    nested: int = 1
    within: Counter = field(default_factory=Counter)

    def goes_on(self, tag: str, closing: bool, empty: bool, reader: _Reader) -> bool:
        """Take a tag in; false if the tag ends the element and is still to be read."""
        if tag == self.tag:
            if closing:
                self.nested -= 1
            elif tag not in INLINE and not empty:
                self.nested += 1
            return closing or tag not in INLINE
        if tag not in BLOCKS:
            return True
        if not closing:
            if self.tag in INLINE and self.unclosed:
                return False
            self.within[tag] += tag != "hr"
            return True
        if self.within[tag] > 0:
            self.within[tag] -= 1
            return True
        return tag not in ("html", "body") and not reader.has(tag)


def read_html(page: str) -> list[Node]:
    """The nodes of a page in page order, parents before children; an empty page has the root alone."""
    reader, at, n = _Reader(), 0, len(page)
    hidden: _Hidden | None = None
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            if not hidden:
                reader.characters(page[at:])
            break
        if m.start() > at and not hidden:
            reader.characters(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        empty = bool(EMPTY.search(attributes))
        if tag in RAW or tag == "noscript":
            end = None if closing or (hidden or tag == "noscript") and empty else re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(page, at)
            if end:
                at = end.end()
                continue
            if tag in RAW:
                if not closing and not hidden:
                    at = n
                continue
        if hidden:
            if hidden.goes_on(tag, bool(closing), empty, reader):
                hidden = hidden if hidden.nested else None
                continue
            hidden = None
        if tag in HIDDEN:
            if not closing and not empty:
                # One that can't hold its like has no end tag if its like begins first
                own = re.compile(rf"<(/?){tag}(?=[\s/>]|\Z)", re.I).search(page, at) if tag in INLINE else None
                hidden = _Hidden(tag, unclosed=not (own and own[1]))
        elif tag == "a":
            reader.link = not closing
        elif tag == "br":
            reader.run.append("\n")
        elif tag in BLOCKS:
            if not closing:
                reader.open(tag, attributes)
            else:
                reader.flush()
                reader.link = False
                if tag not in ("html", "body"):
                    reader.close({tag}, SCOPE - {tag} if tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th") else {"html"} | ({"table"} if tag != "table" else set()))
    reader.flush()
    return _filled(reader.nodes)


def _filled(nodes: list[Node]) -> list[Node]:
    """Without the elements that hold no text; they would only add weight to their parents."""
    full = [bool(x.text) for x in nodes]
    full[0] = True
    for i in range(len(nodes) - 1, 0, -1):
        if full[i]:
            full[nodes[i].parent] = True
    place, out = {}, []
    for i, node in enumerate(nodes):
        if full[i]:
            place[i] = len(out)
            node.parent = place.get(node.parent, -1)
            out.append(node)
    return out


def attributes_of(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}
