"""Trees to text: XML, HTML, XHTML and plain output, escaping and indentation."""

from __future__ import annotations

import html.entities
import re

from ..model import Node

VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame isindex basefont".split())
_NAMES = {code: name for code, name in html.entities.codepoint2name.items()}


def escape_text(s: str) -> str:
    """Escapes what may not stand in XML content: < and &."""
    return s.replace("&", "&amp;").replace("<", "&lt;")


def escape_attr(s: str) -> str:
    """Escapes < > & and both quotes, and line breaks and tabs, for an attribute value."""
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        s = s.replace(c, e)
    return s


def escape_html(s: str) -> str:
    """As escape_text, with every character from 128 on as a named or numeric reference."""
    return re.sub(r"[^\x00-\x7f]", lambda m: f"&{_NAMES[ord(m[0])]};" if ord(m[0]) in _NAMES else f"&#{ord(m[0])};", escape_text(s))


def _attrs(n: Node, html: bool) -> str:
    return "".join(f' {k}="{re.sub(r"[^\x00-\x7f]", lambda m: f"&#{ord(m[0])};", escape_attr(v)) if html else escape_attr(v)}"' for k, v in n.attrs.items())


def to_xml(n: Node, method: str = "xml", no_empty: frozenset[str] | bool = False, indent: bool = False, level: int = 0) -> str:
    """Serialises a tree. method: xml, html, xhtml or plain; no_empty: names (or True for all) that are never written <x/>."""
    html = method == "html"
    esc = {"html": escape_html, "plain": lambda s: s}.get(method, escape_text)
    if n.kind == "root":
        parts = [to_xml(c, method, no_empty, indent, level) for c in n.children]
        return ("\n" if indent else "").join(p for p in parts if p.strip() or not indent)
    if n.kind == "text":
        return esc(n.value or "")
    if n.kind == "cdata":
        return f"<![CDATA[{n.value}]]>" if method != "plain" else n.value or ""
    if n.kind == "comment":
        return f"<!--{n.value}-->"
    if n.kind == "pi":
        return f"<?{n.name}{' ' + n.value if n.value else ''}?>"
    if n.kind == "charref":
        return f"&#{n.value};"
    if n.kind == "entityref":
        return f"&{n.name};"
    if n.kind == "dtd":
        return n.value or ""
    if n.kind == "attr":
        return f'{n.name}="{escape_attr(n.value or "")}"'
    if n.kind == "error":
        return f"<!-- {n.name or 'error'}: {n.value} -->"
    tag = f"<{n.name}{_attrs(n, html)}"
    if not n.children:
        keep = no_empty is True or (isinstance(no_empty, frozenset) and n.name in no_empty)
        if method in ("html", "xhtml"):
            if (n.name or "").lower() in VOID:
                return tag + (">" if html else " />")
            return f"{tag}></{n.name}>"
        return f"{tag}></{n.name}>" if keep else f"{tag}/>"
    mixed = any(c.kind in ("text", "cdata", "charref", "entityref") and (c.value or c.name or "").strip() for c in n.children) or n.attrs.get("xml:space") == "preserve"
    if indent and not mixed:
        own = [c for c in n.children if not (c.kind == "text" and not (c.value or "").strip())]
        pad = "\n" + "  " * (level + 1)
        return tag + ">" + "".join(pad + to_xml(c, method, no_empty, True, level + 1) for c in own) + "\n" + "  " * level + f"</{n.name}>"
    if html and (n.name or "").lower() in ("script", "style"):
        return f"{tag}>{n.text()}</{n.name}>"
    return f"{tag}>" + "".join(to_xml(c, method, no_empty, False, level + 1) for c in n.children) + f"</{n.name}>"


def tree_picture(n: Node, level: int = 0) -> str:
    """One line a node, for debugging."""
    label = n.kind if n.kind != "element" else f"element {n.name}"
    own = "  " * level + label + (f" {n.value!r}" if n.value is not None else "") + "".join(f" {k}={v!r}" for k, v in n.attrs.items())
    return "\n".join([own, *(tree_picture(c, level + 1) for c in n.children)])


def number_lines(s: str) -> str:
    return "\n".join(f"{k:4}  {line}" for k, line in enumerate(s.split("\n"), 1))
