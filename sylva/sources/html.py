"""Lenient HTML parsing: events of the standard parser, repaired on a stack of open elements."""

from __future__ import annotations

import html.entities
from html.parser import HTMLParser

from ..model import Node, link, root
from .serialize import VOID

_BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav noframes ol p pre section table ul".split()
)
#: Start tags that end an open element of the given name.
_CLOSES: dict[str, frozenset[str]] = {
    "p": _BLOCK,
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "option": frozenset(("option", "optgroup")),
    "tr": frozenset(("tr", "tbody", "tfoot", "thead")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "thead": frozenset(("tbody", "tfoot")),
    "tbody": frozenset(("tbody", "tfoot")),
    "head": frozenset(("body",)),
}
#: Elements beyond which no implied end reaches.
_FENCE = frozenset("html body div table ul ol dl select article section aside nav header footer main form fieldset blockquote td th".split())
_INNER = frozenset("p li dt dd option tr td th thead tbody tfoot colgroup head body".split())


class _Builder(HTMLParser):
    def __init__(self, warnings: bool):
        super().__init__(convert_charrefs=False)
        self.top = root()
        self.open = [self.top]
        self.warn = warnings
        self.problems: list[tuple[int, str]] = []

    def say(self, message: str) -> None:
        if self.warn:
            self.problems.append((1, message))

    def add(self, n: Node) -> None:
        self.open[-1].children.append(n)

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1:  # an implied end, of the innermost first, then of what it lies in
            for k in range(len(self.open) - 1, 0, -1):
                name = self.open[k].name
                if tag in _CLOSES.get(name, ()):
                    del self.open[k:]
                    break
                if name in _FENCE and name not in ("td", "th") or k == 1:
                    k = 0
                    break
            else:
                k = 0
            if not k:
                break
        n = Node("element", tag, None, {})
        for name, value in attrs:
            n.attrs.setdefault(name, value or "")
        self.add(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        n = Node("element", tag, None, {})
        for name, value in attrs:
            n.attrs.setdefault(name, value or "")
        self.add(n)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                for n in self.open[k + 1 :]:
                    if n.name not in _INNER:
                        self.say(f"closing tag </{n.name}> inserted before </{tag}>")
                del self.open[k:]
                return
        if tag in VOID:
            return
        self.say(f"no opening tag for </{tag}>")
        self.add(Node("element", tag))

    def handle_data(self, data):
        self.add(Node("text", None, data))

    def handle_charref(self, name):
        try:
            self.add(Node("charref", None, str(int(name[1:], 16) if name[:1] in "xX" else int(name))))
        except ValueError:
            self.add(Node("text", None, f"&#{name};"))

    def handle_entityref(self, name):
        code = html.entities.name2codepoint.get(name)
        if code is None and name == "apos":
            code = 39
        if code is None:
            self.say(f"unknown entity {name}")
        self.add(Node("entityref", name) if code is None else Node("charref", None, str(code)))

    def handle_comment(self, data):
        self.add(Node("comment", None, data))

    def handle_decl(self, decl):
        self.add(Node("dtd", decl.split(" ")[1] if " " in decl else decl, f"<!{decl}>"))

    def handle_pi(self, data):
        data = data.rstrip("?")
        name, _, rest = data.partition(" ")
        self.add(Node("pi", name, rest))

    def unknown_decl(self, data):
        self.add(Node("cdata", None, data[6:] if data.startswith("CDATA[") else data))


def parse_html(source: str | None, fragment: bool = False, warnings: bool = False) -> tuple[Node, list[tuple[int, str]]]:
    """A tree and (level, message) warnings; every text gives a tree. A fragment's tree has its contents at the root."""
    b = _Builder(warnings)
    b.feed(source or "")
    b.close()
    for n in b.open[1:]:
        if n.name not in _INNER and n.name != "html":
            b.say(f"closing tag </{n.name}> inserted at the end")
    if not fragment:
        b.top.children = [c for c in b.top.children if c.kind != "text" or (c.value or "").strip()]
    return link(b.top), b.problems
