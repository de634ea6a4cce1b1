"""W3C XML Schema: schemas to components, and validation of one document at a time, with a log of (level, path, message)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import permutations

from pyspark.sql import DataFrame

from ..functions import datatypes as D
from ..functions import regex as R
from ..model import Node
from ..sources.documents import map_trees
from ..sources.xml import parse_xml
from .edit import propagate_namespaces

NS = "http://www.w3.org/2001/XMLSchema"


class SchemaError(ValueError):
    """A schema that is not correct."""


@dataclass
class Simple:
    """A simple type: restriction of a base by facets, a list of items, or a union."""

    base: Simple | str
    facets: dict = field(default_factory=dict)
    variety: str = "atomic"
    members: list = field(default_factory=list)

    def error(self, s: str) -> str | None:
        if self.variety == "list":
            items = s.split()
            for k, v in self.facets.items():
                n = int(v[0]) if k in ("length", "minLength", "maxLength") else 0
                if k == "length" and len(items) != n or k == "minLength" and len(items) < n or k == "maxLength" and len(items) > n:
                    return f"{s!r} does not keep to {k} {n}"
            return next((e for x in items if (e := check(self.base, x))), None)
        if self.variety == "union":
            bad = [check(m, s) for m in self.members]
            e = None if any(b is None for b in bad) else f"{s!r} is of no member type"
            return e or (f"{s!r} is not one of {', '.join(self.facets['enumeration'])}" if "enumeration" in self.facets and s not in self.facets["enumeration"] else None)
        if isinstance(self.base, Simple):
            if self.base.variety != "atomic":
                return self.base.error(s) or D.allows("string", " ".join(s.split()), {k: v for k, v in self.facets.items() if k in ("pattern", "enumeration")}) or (Simple(self.base.base, self.facets, "list").error(s) if self.base.variety == "list" else None)
            return self.base.error(s) or D.allows(self.primitive(), s, self.facets)
        return D.allows(self.base, s, self.facets)

    def primitive(self) -> str:
        b = self.base
        while isinstance(b, Simple):
            b = b.base
        return b


def check(kind: Simple | str, s: str) -> str | None:
    return kind.error(s) if isinstance(kind, Simple) else D.allows(kind, s)


@dataclass
class Complex:
    attrs: dict = field(default_factory=dict)  # name -> (type, use, default, fixed)
    any_attr: bool = False
    content: tuple = ("empty",)  # empty, simple type, model particle, any
    mixed: bool = False


@dataclass
class Element:
    name: str
    kind: object = None  # resolved lazily
    fixed: str | None = None
    nillable: bool = False


class Schema:
    """The components of a schema, with those it includes, imports or redefines."""

    def __init__(self, source: str, load: Callable[[str], str] | None = None):
        self.load, self.seen = load, set()
        self.nodes: dict[tuple[str, str], Node] = {}
        self.made: dict[tuple[str, str], object] = {}
        self.target = ""
        self.read(source, True)

    def read(self, source: str, top: bool = False, override: Node | None = None) -> None:
        tree, bad = parse_xml(source)
        if bad:
            raise SchemaError(bad[0][1])
        propagate_namespaces(tree)
        s = next(c for c in tree.children if c.kind == "element")
        if s.ns != NS or s.local != "schema":
            raise SchemaError("this is no XML Schema")
        if top:
            self.target = s.attrs.get("targetNamespace", "")
        for n in s.children:
            if n.kind != "element":
                continue
            if n.local in ("include", "import", "redefine"):
                href = n.attrs.get("schemaLocation")
                if href and href not in self.seen:
                    self.seen.add(href)
                    if self.load is None:
                        raise SchemaError(f"no way to load {href}")
                    self.read(self.load(href))
                if n.local == "redefine":
                    for c in n.children:
                        if c.kind == "element" and "name" in c.attrs:
                            key = (c.local, c.attrs["name"])
                            if key in self.nodes:  # the definition it extends keeps another name
                                self.nodes[(c.local, c.attrs["name"] + "\0old")] = self.nodes[key]
                                for x in c.walk():
                                    for k in ("base", "ref"):
                                        if x.kind == "element" and x is not c and x.attrs.get(k, "").split(":")[-1] == c.attrs["name"]:
                                            x.attrs[k] = x.attrs[k] + "\0old"
                            self.nodes[key] = c
            elif "name" in n.attrs:
                self.nodes.setdefault((n.local, n.attrs["name"]), n)

    def _find(self, kinds: tuple[str, ...], name: str) -> tuple[Node, str]:
        local = name.split(":")[-1]
        for k in kinds:
            if (k, local) in self.nodes:
                return self.nodes[k, local], k
        raise SchemaError(f"{'/'.join(kinds)} {name} is not defined")

    def type_named(self, name: str):
        local = name.split(":")[-1]
        if ("simpleType", local) not in self.nodes and ("complexType", local) not in self.nodes:
            if local in D.TYPES:
                return "anyType" if local == "anyType" else local
            raise SchemaError(f"type {name} is not defined")
        n, k = self._find(("simpleType", "complexType"), name)
        if (k, local) not in self.made:
            if k == "complexType":
                self.made[k, local] = c = Complex()
                c.__dict__.update(self.complex(n).__dict__)
            else:
                self.made[k, local] = self.simple(n)
        return self.made[k, local]

    def own(self, n: Node) -> list[Node]:
        return [c for c in n.children if c.kind == "element" and c.ns == NS and c.local != "annotation"]

    def simple(self, n: Node) -> Simple:
        k = self.own(n)[0]
        inner = [self.simple(c) for c in self.own(k) if c.local == "simpleType"]
        if k.local == "restriction":
            base = self.type_named(k.attrs["base"]) if "base" in k.attrs else inner[0]
            return Simple(base, self.facets(k))
        if k.local == "list":
            return Simple(self.type_named(k.attrs["itemType"]) if "itemType" in k.attrs else inner[0], {}, "list")
        if k.local == "union":
            return Simple("string", {}, "union", [self.type_named(x) for x in k.attrs.get("memberTypes", "").split()] + inner)
        raise SchemaError(f"simple type by {k.local}")

    def facets(self, n: Node) -> dict:
        out: dict = {}
        for c in self.own(n):
            if c.local in ("length", "minLength", "maxLength", "pattern", "enumeration", "whiteSpace", "maxInclusive", "maxExclusive", "minInclusive", "minExclusive", "totalDigits", "fractionDigits"):
                if c.local == "whiteSpace":
                    out["whiteSpace"] = c.attrs["value"]
                else:
                    out.setdefault(c.local, []).append(c.attrs["value"])
        return out

    def attributes(self, n: Node, into: Complex) -> None:
        for c in self.own(n):
            if c.local == "attribute":
                d = self._find(("attribute",), c.attrs["ref"])[0] if "ref" in c.attrs and not c.attrs["ref"].startswith("xml:") else c
                name = c.attrs.get("ref", d.attrs.get("name", ""))
                inner = [self.simple(x) for x in self.own(d) if x.local == "simpleType"]
                kind = inner[0] if inner else self.type_named(d.attrs["type"]) if "type" in d.attrs else "anySimpleType"
                if c.attrs.get("use") == "prohibited":
                    into.attrs.pop(name, None)
                else:
                    into.attrs[name] = (kind, c.attrs.get("use", "optional"), c.attrs.get("default", d.attrs.get("default")), c.attrs.get("fixed", d.attrs.get("fixed")))
            elif c.local == "attributeGroup":
                self.attributes(self._find(("attributeGroup",), c.attrs["ref"])[0], into)
            elif c.local == "anyAttribute":
                into.any_attr = True

    def complex(self, n: Node) -> Complex:
        out = Complex(mixed=n.attrs.get("mixed") == "true")
        own = self.own(n)
        body = next((c for c in own if c.local in ("simpleContent", "complexContent")), None)
        if body is None:
            part = next((c for c in own if c.local in ("sequence", "choice", "all", "group")), None)
            out.content = ("model", self.particle(part)) if part is not None else ("empty",)
            self.attributes(n, out)
            return out
        out.mixed |= body.attrs.get("mixed") == "true"
        d = self.own(body)[0]
        base = self.type_named(d.attrs["base"])
        if isinstance(base, Complex):
            out.attrs, out.any_attr = dict(base.attrs), base.any_attr
            out.mixed |= base.mixed
        if body.local == "simpleContent":
            inner = base.content[1] if isinstance(base, Complex) else base
            out.content = ("simple", Simple(inner, self.facets(d)) if d.local == "restriction" else inner)
        else:
            part = next((c for c in self.own(d) if c.local in ("sequence", "choice", "all", "group")), None)
            mine = ("model", self.particle(part)) if part is not None else ("empty",)
            old = base.content if isinstance(base, Complex) else ("any",) if d.local == "restriction" else ("empty",)
            if d.local == "extension" and old[0] == "model":
                mine = ("model", ("seq", [old[1], mine[1]])) if mine[0] == "model" else old
            out.content = mine
        self.attributes(d, out)
        return out

    def particle(self, n: Node):
        """(kind, parts) with occurrence: elem, seq, choice, all, any."""
        low = int(n.attrs.get("minOccurs", "1"))
        high = n.attrs.get("maxOccurs", "1")
        top = R.INF if high == "unbounded" else int(high)
        if n.local == "element":
            p = ("elem", self.element(n))
        elif n.local == "any":
            p = ("any", n.attrs.get("processContents", "strict"))
        elif n.local == "group":
            g = self._find(("group",), n.attrs["ref"])[0]
            p = self.particle(self.own(g)[0])
        else:
            p = ({"sequence": "seq", "choice": "choice", "all": "all"}[n.local], [self.particle(c) for c in self.own(n)])
        return p if (low, top) == (1, 1) else ("rep", low, top, p)

    def element(self, n: Node) -> Element:
        if "ref" in n.attrs:
            return self.global_element(n.attrs["ref"])
        return Element(n.attrs["name"], n, n.attrs.get("fixed"), n.attrs.get("nillable") == "true")

    def global_element(self, name: str) -> Element:
        n = self._find(("element",), name)[0]
        return Element(n.attrs["name"], n, n.attrs.get("fixed"), n.attrs.get("nillable") == "true")

    def kind(self, e: Element):
        """The element's type, made on first use (types may refer to themselves)."""
        n = e.kind
        if isinstance(n, Node):
            key = ("\0element", id(n))
            if key not in self.made:
                inner = next((c for c in self.own(n) if c.local in ("simpleType", "complexType")), None)
                if "type" in n.attrs:
                    self.made[key] = self.type_named(n.attrs["type"])
                elif inner is None:
                    self.made[key] = "anyType"
                else:
                    self.made[key] = self.simple(inner) if inner.local == "simpleType" else self.complex(inner)
            return self.made[key]
        return n


def model_regex(p):
    """The expression of a particle over element names, each ended by a blank."""
    k = p[0]
    if k == "elem":
        return R.word(p[1].name + " ")
    if k == "any":
        return R.seq(R.rng(1, R.INF, R.sym(R.C.complement(R.C.of(" ")))), R.word(" "))
    if k == "rep":
        return R.rng(p[1], p[2], model_regex(p[3]))
    parts = [model_regex(x) for x in p[1]]
    out = R.UNIT if k != "choice" else R.ZERO
    if k == "seq":
        for x in reversed(parts):
            out = R.seq(x, out)
    elif k == "choice":
        for x in parts:
            out = R.alt(out, x)
    else:
        if len(parts) <= 3:
            out = R.ZERO
            for order in permutations(parts):
                one = R.UNIT
                for x in reversed(order):
                    one = R.seq(x, one)
                out = R.alt(out, one)
        else:
            for x in parts:
                out = R.interleave(out, x)
    return out


def elements(p) -> dict[str, Element]:
    if p[0] == "elem":
        return {p[1].name: p[1]}
    if p[0] == "any":
        return {"*": p[1]}
    if p[0] == "rep":
        return elements(p[3])
    return {k: v for x in p[1] for k, v in elements(x).items()}


def _attrs(s: Schema, n: Node, c: Complex, path: str, log: list) -> None:
    for k, v in n.attrs.items():
        if k.startswith("xmlns") or k.startswith("xsi:"):
            continue
        if k in c.attrs:
            kind, _, _, fixed = c.attrs[k]
            if e := check(kind, v):
                log.append((2, f"{path}/@{k}", e))
            elif fixed is not None and not D.equal(kind.primitive() if isinstance(kind, Simple) else kind, v, fixed):
                log.append((2, f"{path}/@{k}", f"{v!r} is not the fixed value {fixed!r}"))
        elif c.any_attr:
            log.append((1, f"{path}/@{k}", "contents of an attribute wildcard are not checked"))
        else:
            log.append((2, f"{path}/@{k}", "attribute is not allowed"))
    log.extend((2, path, f"required attribute {k} is missing") for k, (_, use, _, _) in c.attrs.items() if use == "required" and k not in n.attrs)


def test_element(s: Schema, e: Element, n: Node, path: str, log: list) -> None:
    kind = s.kind(e)
    if e.nillable and n.attrs.get("xsi:nil") in ("true", "1"):
        return
    kids = [c for c in n.children if c.kind == "element"]
    text = "".join(c.value or "" for c in n.children if c.kind in ("text", "cdata"))
    if "xsi:type" in n.attrs:
        kind = s.type_named(n.attrs["xsi:type"])
    if not isinstance(kind, Complex):
        if kind == "anyType":
            return
        _attrs(s, n, Complex(), path, log)
        if kids:
            log.append((2, path, "elements in simple content"))
        elif x := check(kind, text):
            log.append((2, path, x))
        elif e.fixed is not None and text != e.fixed:
            log.append((2, path, f"{text!r} is not the fixed value {e.fixed!r}"))
        return
    _attrs(s, n, kind, path, log)
    what = kind.content[0]
    if what == "simple":
        if kids:
            log.append((2, path, "elements in simple content"))
        elif x := check(kind.content[1], text):
            log.append((2, path, x))
        return
    if what == "any":
        return
    if text.strip() and not kind.mixed:
        log.append((2, path, "text is not allowed here"))
    if what == "empty":
        if kids:
            log.append((2, path, "content must be empty"))
        return
    model = kind.content[1]
    key = ("\0regex", id(kind))
    if key not in s.made:
        s.made[key] = (model_regex(model), elements(model))
    r, known = s.made[key]
    names = [c.local for c in kids]
    if not R.match(r, "".join(x + " " for x in names)):
        log.append((2, path, f"content does not match the model: {' '.join(names)}"))
        return
    seen: dict[str, int] = {}
    for c in kids:
        seen[c.local] = seen.get(c.local, 0) + 1
        here = f"{path}/{c.local}[{seen[c.local]}]"
        if c.local in known:
            test_element(s, known[c.local], c, here, log)
        elif known.get("*") in ("strict", "lax"):
            if ("element", c.local) in s.nodes:
                test_element(s, s.global_element(c.local), c, here, log)
            elif known["*"] == "strict":
                log.append((2, here, "element is not defined"))


def validate(tree: Node, s: Schema) -> tuple[bool, list[tuple[int, str, str]]]:
    """Whether a document is valid, and the log."""
    propagate_namespaces(tree)
    log: list[tuple[int, str, str]] = []
    top = next((c for c in tree.children if c.kind == "element"), None)
    if top is None:
        return False, [(3, "/", "the document is empty")]
    if ("element", top.local) not in s.nodes:
        return False, [(2, f"/{top.local}[1]", "root element is not defined")]
    test_element(s, s.global_element(top.local), top, f"/{top.local}[1]", log)
    return not any(level >= 2 for level, _, _ in log), log


def validate_xsd(nodes: DataFrame, schema: str, load: Callable[[str], str] | None = None) -> DataFrame:
    """doc_id, ok and log (level, path, msg) of each document. The schema is read here and again once a task, for its parts are linked."""
    Schema(schema, load)
    made: list[Schema] = []

    def run(doc_id, tree):
        if not made:
            made.append(Schema(schema, load))
        ok, log = validate(tree, made[0])
        return [(doc_id, ok, [{"level": a, "path": b, "msg": c} for a, b, c in log])]

    return map_trees(nodes, run, "doc_id long, ok boolean, log array<struct<level:int,path:string,msg:string>>")
