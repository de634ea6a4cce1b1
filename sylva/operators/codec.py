"""Codecs between values and XML: one description encodes, decodes and gives a schema (DTD and Spark type).

A codec has put(value, node), which adds attributes and children to an element under construction; get(node), which takes
from the front of what is left of an element's attributes and children; and a schema. Decoding an element demands that nothing
is left. Columns go through encode_col and decode_col.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import datatypes as D
from ..model import Node, root
from ..sources.serialize import to_xml
from ..sources.xml import parse_xml
from .edit import canonicalize


class DecodeError(ValueError):
    """XML that a codec does not accept. fatal: no alternative is tried."""

    def __init__(self, message: str, fatal: bool = False):
        super().__init__(message)
        self.fatal = fatal


@dataclass
class Codec:
    put: Callable[[Any, Node], None]
    get: Callable[[Node], Any]
    schema: tuple  # (kind, ...)


# what a codec's schema may be: ("any",) ("empty",) ("text", type, facets) ("seq", [..]) ("alt", [..]) ("opt", s) ("rep", low, s) ("elem", name, s) ("attr", name, s)


def _take(n: Node) -> Node | None:
    return n.children.pop(0) if n.children else None


def _save(n: Node) -> tuple[dict, list]:
    return dict(n.attrs), list(n.children)


def _restore(n: Node, state: tuple[dict, list]) -> None:
    n.attrs, n.children = dict(state[0]), list(state[1])


def unit() -> Codec:
    return lift(None)


def zero(message: str = "nothing decodes") -> Codec:
    def fail(*_):
        raise DecodeError(message)

    return Codec(fail, fail, ("empty",))


def lift(value) -> Codec:
    """A constant, without any XML."""
    return Codec(lambda v, n: None, lambda n: value, ("empty",))


def text(kind: str = "string", empty: bool = False, **facets) -> Codec:
    """Text content of a type; with empty, '' too."""

    def put(v, n):
        if v:
            n.children.append(Node("text", None, v))

    def get(n):
        c = n.children[0] if n.children else None
        if c is None or c.kind not in ("text", "cdata"):
            if empty:
                return ""
            raise DecodeError("text is missing")
        s = _take(n).value or ""
        if e := D.allows(kind, s, {k: x if isinstance(x, list) else str(x) for k, x in facets.items()}):
            raise DecodeError(e)
        return s

    return Codec(put, get, ("text", kind, facets))


def text0(kind: str = "string", **facets) -> Codec:
    return text(kind, True, **facets)


def wrap(c: Codec, decode: Callable, encode: Callable) -> Codec:
    """Maps values after decoding and before encoding; an error or None of decode is a decode error."""

    def get(n):
        v = c.get(n)
        try:
            out = decode(v)
        except (ValueError, KeyError, TypeError) as e:
            raise DecodeError(f"{v!r}: {e}") from e
        return out

    return Codec(lambda v, n: c.put(encode(v), n), get, c.schema)


def wrap_maybe(c: Codec, decode: Callable, encode: Callable) -> Codec:
    def some(v):
        out = decode(v)
        if out is None:
            raise ValueError("no value")
        return out

    return wrap(c, some, encode)


def prim(kind: Callable = float, name: str = "double") -> Codec:
    return wrap(text(), kind, str) if name is None else Codec(*(lambda c: (c.put, c.get))(wrap(text(), kind, str)), ("text", name, {}))


def integer() -> Codec:
    def read(s):
        if not re.fullmatch(r"[+-]?\d+", s):
            raise ValueError("not a whole number")
        return int(s)

    c = wrap(text(), read, str)
    return Codec(c.put, c.get, ("text", "integer", {}))


def tree() -> Codec:
    """Any one node."""

    def get(n):
        c = _take(n)
        if c is None:
            raise DecodeError("a node is missing")
        return c

    return Codec(lambda v, n: n.children.append(v.copy()), get, ("any",))


def trees() -> Codec:
    def get(n):
        out, n.children = n.children, []
        return out

    return Codec(lambda v, n: n.children.extend(x.copy() for x in v), get, ("any",))


def xml_text() -> Codec:
    """Embedded markup as a string."""
    return wrap(trees(), lambda v: to_xml(root(*v)), lambda s: parse_xml(s, fragment=True)[0].children)


def seq(*parts: Codec) -> Codec:
    """A tuple of any number of parts."""

    def put(v, n):
        for c, x in zip(parts, v, strict=True):
            c.put(x, n)

    return Codec(put, lambda n: tuple(c.get(n) for c in parts), ("seq", [c.schema for c in parts]))


pair = triple = tuple_ = seq


def record(**parts: Codec) -> Codec:
    """A dict of named parts, in order; missing ones are None."""

    def put(v, n):
        for k, c in parts.items():
            c.put(v.get(k) if isinstance(v, dict) else v[k], n)

    return Codec(put, lambda n: {k: c.get(n) for k, c in parts.items()}, ("seq", [c.schema for c in parts.values()]))


def seq_fixed(fixed: Codec, c: Codec) -> Codec:
    """A part without a value, then one with."""
    return wrap(seq(fixed, c), lambda v: v[1], lambda v: (None, v))


def choice(first: Codec, second: Codec, then: Callable | None = None) -> Codec:
    return alt(lambda v: 0, first, second)


def option(c: Codec) -> Codec:
    """None if it does not decode and nothing was consumed."""

    def put(v, n):
        if v is not None:
            c.put(v, n)

    def get(n):
        state = _save(n)
        try:
            return c.get(n)
        except DecodeError as e:
            if e.fatal:
                raise
            _restore(n, state)
            return None

    return Codec(put, get, ("opt", c.schema))


def default(value, c: Codec) -> Codec:
    """The value where there is none; not written where equal."""
    o = option(c)

    def get(n):
        v = o.get(n)
        return value if v is None else v

    return Codec(lambda v, n: None if v == value else c.put(v, n), get, o.schema)


def list_(c: Codec, least: int = 0) -> Codec:
    def put(v, n):
        for x in v:
            c.put(x, n)

    def get(n):
        out = []
        while n.children:
            state = _save(n)
            try:
                out.append(c.get(n))
            except DecodeError as e:
                if e.fatal:
                    raise
                _restore(n, state)
                break
            if len(n.children) == len(state[1]):
                break
        if len(out) < least:
            raise DecodeError("a list is too short")
        return out

    return Codec(put, get, ("rep", least, c.schema))


def list1(c: Codec) -> Codec:
    return list_(c, 1)


def map_(elem_name: str, attr_name: str, key: Codec, value: Codec) -> Codec:
    """A map as a list of elements with their key in an attribute."""
    return wrap(list_(elem(elem_name, seq(attr(attr_name, key), value))), dict, lambda m: list(m.items()))


def alt(tag: Callable[[Any], int], *parts: Codec) -> Codec:
    """A sum: tag says which part encodes a value; the first that succeeds decodes."""

    def get(n):
        state, first = _save(n), None
        for c in parts:
            try:
                return c.get(n)
            except DecodeError as e:
                if e.fatal:
                    raise
                first = first or e
                _restore(n, state)
        raise first or DecodeError("no alternative")

    return Codec(lambda v, n: parts[tag(v)].put(v, n), get, ("alt", [c.schema for c in parts]))


def _inside(e: Node, c: Codec, strict: bool = True):
    inner = Node("element", e.name, None, {k: v for k, v in e.attrs.items() if not k.startswith("xmlns")}, [x for x in e.children])
    v = c.get(inner)
    left = [x for x in inner.children if x.kind != "text" or (x.value or "").strip()]
    if strict and (left or inner.attrs):
        raise DecodeError(f"element {e.name}: left over: {', '.join([*(x.name or x.kind for x in left), *('@' + k for k in inner.attrs)])}")
    return v


def elem(name: str, c: Codec, ns: str = "") -> Codec:
    def put(v, n):
        e = Node("element", name, None, {f"xmlns:{name.split(':')[0]}" if ":" in name else "xmlns": ns} if ns else {})
        c.put(v, e)
        n.children.append(e)

    def get(n):
        while n.children and n.children[0].kind == "text" and not (n.children[0].value or "").strip():
            n.children.pop(0)
        e = n.children[0] if n.children else None
        if e is None or e.kind != "element" or e.name != name:
            raise DecodeError(f"element {name} is missing")
        v = _inside(e, c)
        _take(n)
        return v

    return Codec(put, get, ("elem", name, c.schema))


def elem_with_attr(name: str, attr_name: str, value: str, c: Codec) -> Codec:
    return elem(name, seq_fixed(attr_fixed(attr_name, value), c))


def attr(name: str, c: Codec | None = None) -> Codec:
    c = c or text0()

    def put(v, n):
        inner = Node("element", "")
        c.put(v, inner)
        n.attrs[name] = "".join(x.text() for x in inner.children)

    def get(n):
        if name not in n.attrs:
            raise DecodeError(f"attribute {name} is missing")
        s = n.attrs[name]
        v = c.get(Node("element", "", None, {}, [Node("text", None, s)] if s else []))
        del n.attrs[name]
        return v

    return Codec(put, get, ("attr", name, c.schema))


def text_attr(name: str) -> Codec:
    return attr(name)


def attr_implied(name: str, c: Codec | None = None) -> Codec:
    return option(attr(name, c))


def attr_fixed(name: str, value: str) -> Codec:
    def get(n):
        if n.attrs.pop(name, None) != value:
            raise DecodeError(f"attribute {name} is not {value!r}")

    return Codec(lambda v, n: n.attrs.__setitem__(name, value), get, ("attr", name, ("text", "string", {"enumeration": [value]})))


def add_fixed_attr(name: str, value: str, c: Codec) -> Codec:
    return seq_fixed(attr_fixed(name, value), c)


def filter_cont(keep: Callable[[Node], bool], c: Codec) -> Codec:
    def get(n):
        n.children = [x for x in n.children if keep(x)]
        return c.get(n)

    return Codec(c.put, get, c.schema)


def filter_attr(keep: Callable[[str], bool], c: Codec) -> Codec:
    def get(n):
        n.attrs = {k: v for k, v in n.attrs.items() if keep(k)}
        return c.get(n)

    return Codec(c.put, get, c.schema)


def ignore_cont(c: Codec) -> Codec:
    return filter_cont(lambda _: False, c)


def ignore_attr(c: Codec) -> Codec:
    return filter_attr(lambda _: False, c)


def check_empty(c: Codec) -> Codec:
    def get(n):
        v = c.get(n)
        if n.children or n.attrs:
            raise DecodeError("something is left over")
        return v

    return Codec(c.put, get, c.schema)


def lazy(make: Callable[[], Codec], name: str = "") -> Codec:
    """A codec made on use, for recursive values; name: the element it makes."""
    return Codec(lambda v, n: make().put(v, n), lambda n: make().get(n), ("ref", name))


# documents


def pickle(c: Codec, value) -> Node:
    r = root()
    c.put(value, r)
    return r


def unpickle(c: Codec, t: Node):
    """The value of a tree; raises DecodeError."""
    inner = Node("root", "/", None, {}, [x for x in canonicalize(t.copy()).children if x.kind == "element" or (x.value or "").strip() and x.kind == "text"])
    v = c.get(inner)
    if inner.children:
        raise DecodeError("something is left over")
    return v


def show(c: Codec, value) -> str:
    return to_xml(pickle(c, value))


def read(c: Codec, source: str):
    t, bad = parse_xml(source)
    if bad:
        raise DecodeError(bad[0][1])
    return unpickle(c, t)


def _model(s: tuple) -> str:
    k = s[0]
    if k == "elem" or k == "ref":
        return s[1]
    if k == "text":
        return "#PCDATA"
    if k == "any":
        return "ANY"
    if k == "seq":
        parts = [p for x in s[1] if (p := _model(x))]
        return "(" + ",".join(parts) + ")" if len(parts) > 1 else parts[0] if parts else ""
    if k == "alt":
        parts = [p for x in s[1] if (p := _model(x))]
        return "(" + "|".join(dict.fromkeys(parts)) + ")" if parts else ""
    if k in ("opt", "rep"):
        inner = _model(s[-1])
        mark = "?" if k == "opt" else "+" if s[1] else "*"
        return f"{inner if inner.startswith('(') else '(' + inner + ')'}{mark}" if inner and inner != "#PCDATA" else inner
    return ""


def dtd(c: Codec) -> str:
    """The element and attribute declarations of a codec."""
    out: dict[str, str] = {}

    def attrs(s: tuple, optional: bool = False) -> list[str]:
        if s[0] == "attr":
            kind = s[2]
            enum = kind[2].get("enumeration") if kind[0] == "text" else None
            t = "(" + "|".join(enum) + ")" if enum else "NMTOKEN" if kind[0] == "text" and kind[1] in ("NMTOKEN", "integer", "double") else "CDATA"
            return [f"{s[1]} {t} {'#IMPLIED' if optional else '#REQUIRED'}"]
        if s[0] in ("seq", "alt"):
            return [a for x in s[1] for a in attrs(x, optional or s[0] == "alt")]
        return attrs(s[-1], True) if s[0] in ("opt", "rep") else []

    def visit(s: tuple) -> None:
        if s[0] == "elem":
            if s[1] in out:
                return
            m = _model(s[2])
            m = m or "EMPTY"
            out[s[1]] = f"<!ELEMENT {s[1]} {m if m in ('ANY', 'EMPTY') or m.startswith('(') else '(' + m + ')'}>" + "".join(f"\n<!ATTLIST {s[1]} {a}>" for a in attrs(s[2]))
            visit(s[2])
        elif s[0] in ("seq", "alt"):
            for x in s[1]:
                visit(x)
        elif s[0] in ("opt", "rep"):
            visit(s[-1])

    visit(c.schema)
    return "\n".join(out.values())


def check_codec(c: Codec, value) -> bool:
    """Whether a value survives the way through XML, and the XML keeps to the codec's DTD."""
    from . import dtd as rules

    s = show(c, value)
    t, bad = parse_xml(s)
    if bad or unpickle(c, t) != value:
        return False
    name = next(x.name for x in t.children if x.kind == "element")
    t2, bad = parse_xml(f"<!DOCTYPE {name} [\n{dtd(c)}\n]>{s}")
    return not bad and not rules.validate(t2)


def encode_col(value: Column, c: Codec) -> Column:
    """XML text of a struct column, through record()."""

    @F.pandas_udf("string")
    def f(x: pd.DataFrame) -> pd.Series:
        return pd.Series([show(c, r) for r in x.to_dict("records")], dtype=object)

    return f(value)


def decode_col(s: Column, c: Codec, schema: str) -> Column:
    """A struct of the XML text's value and error; the value is null where it does not decode."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).fieldNames()

    @F.pandas_udf(f"{schema}, error string")
    def f(x: pd.Series) -> pd.DataFrame:
        out = []
        for v in x:
            try:
                got = read(c, v)
                out.append([got[k] for k in names] + [None])
            except (DecodeError, TypeError) as e:
                out.append([None] * len(names) + [str(e)])
        return pd.DataFrame(out, columns=[*names, "error"], dtype=object)

    return f(s)


def lift_maybe(value) -> Codec:
    """A constant without any XML; None decodes to nothing."""
    return zero("no value") if value is None else lift(value)


def add_ns_decl(prefix: str, uri: str, c: Codec) -> Codec:
    """A namespace declaration on the element, no part of the value; an empty prefix is the default namespace. Declarations are passed over in reading."""
    name = f"xmlns:{prefix}" if prefix else "xmlns"

    def put(v, n):
        n.attrs[name] = uri
        c.put(v, n)

    return Codec(put, c.get, ("seq", [("attr", name, ("text", "string", {"enumeration": [uri]})), c.schema]))


def ignore_input(c: Codec) -> Codec:
    """Drops all attributes and content before c reads."""
    return ignore_cont(ignore_attr(c))
