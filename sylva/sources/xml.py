"""Strict XML parsing with the standard library's expat, into trees with comments, CDATA, instructions and the internal DTD subset."""

from __future__ import annotations

from xml.parsers import expat

from ..model import Node, link, root


def _model(m) -> str:
    """The text of a content model as expat gives it."""
    kind, quant, name, inner = m
    mark = {0: "", 1: "?", 2: "*", 3: "+"}[quant]
    if kind == 1:
        return "EMPTY"
    if kind == 2:
        return "ANY"
    if kind == 3:
        return "(" + "|".join(["#PCDATA", *(_model(x) for x in inner)]) + ")" + ("*" if inner else mark)
    if kind == 4:
        return f"{name}{mark}"
    return "(" + ("|" if kind == 5 else ",").join(_model(x) for x in inner) + ")" + mark


def xml_rows(doc_id: int | None, source: str) -> list[list] | None:
    """NODE rows of a document as the rows of its canonical tree, made from expat's events without a tree in between.

    None where a tree is needed: with a document type, or if the text is not well formed.
    """
    if "<!DOCTYPE" in source:
        return None
    out = [[doc_id, 0, 0, 0, 0, None, 0, "root", "", "/", "", "/", None, None]]
    up, count, held = [0], [0], []
    names: dict[str, tuple[str, str]] = {}

    def leaf(kind, name, value):
        pre = len(out)
        prefix, local = (None, None) if name is None else (name.split(":", 1)[0] if ":" in name else "", name.split(":", 1)[-1])
        out.append([doc_id, pre, pre, 0, len(up), up[-1], count[-1], kind, prefix, local, None if name is None else "", name, value, None])
        count[-1] += 1

    def settle():
        leaf("text", None, held[0] if len(held) == 1 else "".join(held))
        held.clear()

    def start(name, attrs):
        if held:
            settle()
        own = names.get(name)
        if own is None:
            own = names[name] = (name.split(":", 1)[0] if ":" in name else "", name.split(":", 1)[-1])
        pre = len(out)
        out.append([doc_id, pre, pre, 0, len(up), up[-1], count[-1], "element", own[0], own[1], "", name, None, attrs or None])
        count[-1] += 1
        up.append(pre)
        count.append(0)

    def end(_):
        if held:
            settle()
        count.pop()
        pre = up.pop()
        out[pre][3] = len(out) - pre - 1

    def instruction(target, data):
        if held:
            settle()
        leaf("pi", target, data)

    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.ProcessingInstructionHandler = start, end, held.append, instruction
    try:
        p.Parse(source, True)
    except expat.ExpatError:
        return None
    out[0][3] = len(out) - 1
    return out


def xml_tree(source: str) -> Node | None:
    """The canonical tree of a document, linked, made from expat's events; None where xml_rows gives None."""
    if "<!DOCTYPE" in source:
        return None
    top = root()
    up, held, at = [top], [], [0]

    def add(n):
        n.up = up[-1]
        at[0] += 1
        n.at = at[0]
        n.up.children.append(n)

    def settle():
        add(Node("text", None, held[0] if len(held) == 1 else "".join(held)))
        held.clear()

    def start(name, attrs):
        if held:
            settle()
        n = Node("element", name, None, attrs)
        add(n)
        up.append(n)

    def end(_):
        if held:
            settle()
        up.pop()

    def instruction(target, data):
        if held:
            settle()
        add(Node("pi", target, data))

    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.ProcessingInstructionHandler = start, end, held.append, instruction
    try:
        p.Parse(source, True)
    except expat.ExpatError:
        return None
    return top


def parse_xml(source: str | None, fragment: bool = False, keep_cdata: bool = True) -> tuple[Node, list[tuple[int, str]]]:
    """A tree and (level, message) problems. Text that is not well formed gives an empty root and one fatal problem (level 3)."""
    top = root()
    stack = [top]
    problems: list[tuple[int, str]] = []
    cdata = [False]
    p = expat.ParserCreate()
    p.ordered_attributes = True
    p.buffer_text = True

    def start(name, attrs):
        n = Node("element", name, None, dict(zip(attrs[::2], attrs[1::2], strict=True)))
        stack[-1].children.append(n)
        stack.append(n)

    def end(_):
        stack.pop()

    def data(s):
        stack[-1].children.append(Node("cdata" if cdata[0] and keep_cdata else "text", None, s))

    def doctype(name, system, public, _):
        stack[-1].children.append(Node("dtd", name, f"<!DOCTYPE {name}>", {k: v for k, v in (("system", system), ("public", public)) if v}))
        stack.append(stack[-1].children[-1])

    def declare(kind, attrs):
        if stack[-1].kind == "dtd":
            stack[-1].children.append(Node("dtd", kind, None, {k: v for k, v in attrs.items() if v is not None}))

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, data
    p.CommentHandler = lambda s: stack[-1].children.append(Node("comment", None, s)) if stack[-1].kind != "dtd" else None
    p.ProcessingInstructionHandler = lambda t, d: stack[-1].children.append(Node("pi", t, d)) if stack[-1].kind != "dtd" else None
    p.StartCdataSectionHandler = lambda: cdata.__setitem__(0, True)
    p.EndCdataSectionHandler = lambda: cdata.__setitem__(0, False)
    p.StartDoctypeDeclHandler = doctype
    p.EndDoctypeDeclHandler = lambda: stack.pop()
    p.ElementDeclHandler = lambda name, m: declare("ELEMENT", {"name": name, "model": _model(m)})
    p.AttlistDeclHandler = lambda el, name, kind, default, required: declare(
        "ATTLIST", {"element": el, "name": name, "type": kind, "default": default, "use": "required" if required and default is None else "fixed" if required else "implied" if default is None else "default"}
    )
    p.EntityDeclHandler = lambda name, par, value, base, system, public, notation: declare("PENTITY" if par else "ENTITY", {"name": name, "value": value, "system": system, "public": public, "ndata": notation})
    p.NotationDeclHandler = lambda name, base, system, public: declare("NOTATION", {"name": name, "system": system, "public": public})
    p.SkippedEntityHandler = lambda name, par: None if par else stack[-1].children.append(Node("entityref", name))
    text = source or ""
    try:
        p.Parse(f"<_>{text}</_>" if fragment else text, True)
    except expat.ExpatError as e:
        problems.append((3, f"line {e.lineno}, column {e.offset}: {expat.ErrorString(e.code)}"))
        return link(root()), problems
    if fragment:
        top.children = top.children[0].children
    return link(top), problems
