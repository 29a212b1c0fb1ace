"""The per-page helper of the web scan: a forgiving tree over the standard parser, and small CSS selectors.

Supported selectors: tag, ``.class``, ``#id``, ``[attr]``, ``[attr=value]``, their combinations, descendant, ``>`` and
comma lists. Text is collapsed to single blanks, with a break at block elements and at ``br``.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

# Fixed values of HTML: elements without content, elements that set text apart, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd del details div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html ins li main menu nav noscript ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - set("body html br caption del ins noscript td th tr tbody thead tfoot".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
          "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
BARRIER = frozenset("table td th caption button object template html".split())
UNSEEN = frozenset(("script", "style"))

_BLANKS = re.compile("[ \t\n\f\r\u00a0]+")
_INVISIBLE = re.compile("[\u200b\u00ad]")
_SIMPLE = re.compile(r"\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]|([\w-]+|\*)")


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        pending = [self]
        while pending:
            node = pending.pop()
            yield node
            pending.extend(c for c in reversed(node.children) if not isinstance(c, str))

    def text(self):
        parts = []
        pending = [self]
        while pending:
            node = pending.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.tag in BLOCK:
                parts.append(" ")
                pending.append(" ")
                pending.extend(reversed(node.children))
            elif node.tag not in UNSEEN:
                pending.extend(reversed(node.children))
        return _BLANKS.sub(" ", _INVISIBLE.sub("", "".join(parts))).strip(" ")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Element("#root", {}, None)

    def _close(self, tags, stop):
        node = self.top
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.top = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, BARRIER)
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPE.get(tag, BARRIER))
        element = Element(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.children.append(element)
        if tag not in VOID:
            self.top = element

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close({tag}, () if tag not in ("p", "li", "b", "i", "a", "span") else BARRIER)

    def parse_marked_section(self, i, report=1):
        # Marked sections of web pages are text if they are CDATA and comments otherwise, never an error.
        if not self.rawdata.startswith("<![CDATA[", i):
            return self.parse_bogus_comment(i)
        end = self.rawdata.find("]]>", i)
        self.handle_data(self.rawdata[i + 9 : end if end >= 0 else None])
        return end + 3 if end >= 0 else len(self.rawdata)

    def handle_data(self, data):
        self.top.children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


@lru_cache(maxsize=1024)
def _compiled(selector: str):
    """Alternatives, each a list of (combinator, tests) from left to right."""
    alternatives = []
    for alternative in selector.split(","):
        steps, combinator = [], " "
        for word in re.sub(r"\s*>\s*", " > ", alternative.strip()).split():
            if word == ">":
                combinator = ">"
                continue
            if not word or _SIMPLE.sub("", word):
                raise ValueError(f"unsupported selector {selector!r}")
            steps.append((combinator, _SIMPLE.findall(word)))
            combinator = " "
        if steps:
            alternatives.append(steps)
    return alternatives


def _is(node, tests):
    for cls, ident, attr, value, tag in tests:
        if cls:
            ok = cls.lower() in node.attrs.get("class", "").lower().split()
        elif ident:
            ok = node.attrs.get("id") == ident
        elif attr:
            found = node.attrs.get(attr.lower())
            ok = found is not None and (not value or found.strip().lower() == value.strip().lower())
        else:
            ok = tag == "*" or node.tag == tag.lower()
        if not ok:
            return False
    return True


def _fits(node, steps, root):
    combinator, tests = steps[-1]
    if not _is(node, tests):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    if combinator == ">":
        return node is not root and node.parent is not None and _fits(node.parent, rest, root)
    while node is not root and node.parent is not None:
        node = node.parent
        if _fits(node, rest, root):
            return True
    return False


def select(root: Element, selector: str) -> list[Element]:
    """Matches below ``root`` (itself included) in document order."""
    alternatives = _compiled(selector)
    return [n for n in root.walk() if n.tag[0] != "#" and any(_fits(n, steps, root) for steps in alternatives)]


def text_of(elements) -> str:
    return " ".join(e.text() for e in elements)
