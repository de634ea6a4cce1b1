"""Canonicalisation, white space, comments and namespaces of trees; each function works on one tree."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Callable

from ..model import Node

XML_NS, XMLNS_NS = "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2000/xmlns/"
_NCNAME = re.compile(r"[A-Za-z_À-˿Ͱ-῿、-퟿][\w.\-·]*$")


def edit_all(n: Node, f: Callable[[Node], list[Node]]) -> Node:
    """Replaces every node below n by f's results, children before parents."""
    kids: list[Node] = []
    for c in n.children:
        kids.extend(f(edit_all(c, f)))
    n.children = kids
    return n


def collapse_text(n: Node) -> Node:
    """Merges neighbouring text children into one."""
    kids: list[Node] = []
    for c in n.children:
        if c.kind == "text" and kids and kids[-1].kind == "text":
            kids[-1] = Node("text", None, (kids[-1].value or "") + (c.value or ""))
        else:
            kids.append(c)
    n.children = kids
    return n


def collapse_all_text(n: Node) -> Node:
    for c in n.walk():
        collapse_text(c)
    return n


def cdata_to_text(n: Node) -> list[Node]:
    return [Node("text", None, n.value)] if n.kind == "cdata" else [n]


def charref_to_text(n: Node) -> list[Node]:
    return [Node("text", None, chr(int(n.value or 0)))] if n.kind == "charref" else [n]


def entity_to_text(n: Node) -> list[Node]:
    """References to the entities of XHTML become characters."""
    if n.kind == "entityref" and n.name in html.entities.name2codepoint:
        return [Node("text", None, chr(html.entities.name2codepoint[n.name]))]
    return [n]


def remove_comment(n: Node) -> list[Node]:
    return [] if n.kind == "comment" else [n]


def remove_ws_text(n: Node) -> list[Node]:
    return [] if n.kind == "text" and not (n.value or "").strip() else [n]


def remove_all_comments(n: Node) -> Node:
    return edit_all(n, remove_comment)


def remove_all_ws(n: Node) -> Node:
    return edit_all(n, remove_ws_text)


def canonicalize(n: Node, keep_comments: bool = False, entities: bool = True) -> Node:
    """References and CDATA become text, neighbouring text is merged, the XML declaration and (by default) comments go."""

    def one(c: Node) -> list[Node]:
        if c.kind == "pi" and c.name == "xml" or c.kind == "comment" and not keep_comments:
            return []
        if c.kind == "cdata":
            return cdata_to_text(c)
        if c.kind == "charref":
            return charref_to_text(c)
        return entity_to_text(c) if entities else [c]

    return collapse_all_text(edit_all(n, one))


def remove_doc_ws(n: Node, preserve: bool = False) -> Node:
    """Drops white space between elements where no xml:space="preserve" holds and the parent has no other text."""
    space = n.attrs.get("xml:space")
    preserve = space == "preserve" if space else preserve
    mixed = any(c.kind in ("text", "cdata") and (c.value or "").strip() for c in n.children)
    if not preserve and not mixed:
        n.children = [c for c in n.children if c.kind != "text"] if any(c.kind == "element" for c in n.children) or n.kind == "root" else n.children
    for c in n.children:
        remove_doc_ws(c, preserve)
    return n


def space_modes(n: Node, mode: str = "default") -> list[tuple[Node, str]]:
    """Each element with the xml:space that holds for it: that of the nearest ancestor or itself."""
    mode = n.attrs.get("xml:space", mode)
    return [(n, mode)] * (n.kind == "element") + [x for c in n.children for x in space_modes(c, mode)]


def subst_entities(n: Node) -> Node:
    return collapse_all_text(edit_all(n, entity_to_text))


def is_ns_decl(name: str) -> bool:
    return name == "xmlns" or name.startswith("xmlns:")


def ns_decl(name: str, value: str) -> tuple[str, str]:
    """Prefix and URI of a declaration."""
    return name[6:], value


def with_ns_env(n: Node, f: Callable[[Node, dict[str, str]], None], env: dict[str, str] | None = None) -> Node:
    """Calls f on each element with the namespaces in scope."""
    env = {"xml": XML_NS} if env is None else env
    if n.kind == "element":
        own = dict(ns_decl(k, v) for k, v in n.attrs.items() if is_ns_decl(k))
        env = env | own if own else env
        f(n, env)
    for c in n.children:
        with_ns_env(c, f, env)
    return n


def propagate_namespaces(n: Node, env: dict[str, str] | None = None) -> Node:
    """Resolves each element's prefix; names without one get the default namespace, attributes never do."""

    def one(e: Node, env: dict[str, str]) -> None:
        e.ns = env.get(e.prefix, "")

    return with_ns_env(n, one, env)


def attach_ns_env(n: Node) -> Node:
    """Writes all namespaces in scope on each element."""

    def one(e: Node, env: dict[str, str]) -> None:
        for p, uri in env.items():
            if p != "xml":
                e.attrs.setdefault(f"xmlns:{p}" if p else "xmlns", uri)

    return with_ns_env(n, one)


def unique_namespaces(n: Node) -> Node:
    """One prefix for a URI, all declared at the first element, where prefixes do not clash."""
    by_uri: dict[str, str] = {}

    def one(e: Node, env: dict[str, str]) -> None:
        for p, uri in env.items():
            if p and p != "xml" and uri not in by_uri:
                name, k = p, 1
                while name in by_uri.values():
                    name, k = f"{p}{k}", k + 1
                by_uri[uri] = name

    def rename(e: Node, env: dict[str, str]) -> None:
        old = dict(env)
        name = lambda q: f"{by_uri[old[q.split(':', 1)[0]]]}:{q.split(':', 1)[1]}" if ":" in q and old.get(q.split(":", 1)[0]) in by_uri else q
        e.attrs = {name(k): v for k, v in e.attrs.items() if not k.startswith("xmlns:")}
        e.name = name(e.name or "")

    with_ns_env(n, one)
    with_ns_env(n, rename)
    top = n if n.kind == "element" else next((c for c in n.children if c.kind == "element"), None)
    if top is not None:
        top.attrs = {f"xmlns:{p}": uri for uri, p in by_uri.items()} | top.attrs
    return n


def namespace_errors(n: Node) -> list[str]:
    """Undeclared prefixes, ill-formed names, empty or forbidden declarations and attributes of one universal name."""
    out: list[str] = []

    def one(e: Node, env: dict[str, str]) -> None:
        for what, q in [("element", e.name or ""), *(("attribute", k) for k in e.attrs)]:
            parts = q.split(":")
            if len(parts) > 2 or not all(_NCNAME.match(p) for p in parts):
                out.append(f"{what} name {q} is not a qualified name")
            elif len(parts) == 2 and parts[0] not in env and parts[0] != "xmlns":
                out.append(f"namespace of prefix {parts[0]} in {what} {q} is undeclared")
        for k, v in e.attrs.items():
            if k.startswith("xmlns:") and not v:
                out.append(f"declaration {k} is empty")
            if k.startswith("xmlns:xml"):
                out.append(f"declaration {k} is not allowed")
        names = [(env.get(k.split(":")[0], ""), k.split(":", 1)[1]) if ":" in k else ("", k) for k in e.attrs if not is_ns_decl(k)]
        out.extend(f"attribute {{{u}}}{x} occurs twice in {e.name}" for u, x in set(names) if names.count((u, x)) > 1)

    with_ns_env(n, one)
    return out
