"""XSLT 1.0: stylesheets compiled on the driver, applied to one document at a time."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..model import Node, link, root
from ..plans import xpath as X
from ..sources.documents import map_trees, rewrite
from ..sources.serialize import to_xml
from ..sources.xml import parse_xml
from .edit import collapse_all_text, propagate_namespaces

NS = "http://www.w3.org/1999/XSL/Transform"


class XsltError(ValueError):
    """A stylesheet or transformation that failed."""


@dataclass
class Rule:
    match: object
    mode: str
    priority: float
    order: int
    level: int  # import precedence: 0 highest
    body: Node


@dataclass
class Stylesheet:
    rules: list[Rule] = field(default_factory=list)
    named: dict[str, Node] = field(default_factory=dict)
    variables: list[Node] = field(default_factory=list)
    attribute_sets: dict[str, list[Node]] = field(default_factory=dict)
    strip: set[str] = field(default_factory=set)
    preserve: set[str] = field(default_factory=set)
    aliases: dict[str, str] = field(default_factory=dict)
    keys: list[tuple[str, object, object]] = field(default_factory=list)
    ns: dict[str, str] = field(default_factory=dict)


def _kids(n: Node) -> list[Node]:
    return [c for c in n.children if c.kind == "element"]


def _is(n: Node, name: str | None = None) -> bool:
    return n.kind == "element" and n.ns == NS and (name is None or n.local == name)


def _priority(e) -> float:
    """The default priority of a pattern without alternatives."""
    if e[0] == "path" and e[1] is None and len(e[2]) == 1 and not e[2][0][2]:
        test = e[2][0][1]
        return {"name": 0.0, "pi": 0.0, "prefix": -0.25}.get(test[0], -0.5)
    return 0.5


def compile_stylesheet(source: str, load: Callable[[str], str] | None = None) -> Stylesheet:
    """A stylesheet with its imports (less precedence) and includes; load gives the text of an href."""
    out = Stylesheet()
    counter = [0]

    def read(text: str, level: int, trail: tuple[str, ...]) -> int:
        tree, bad = parse_xml(text)
        if bad:
            raise XsltError(bad[0][1])
        propagate_namespaces(tree)
        _strip_ws(tree)
        top = _kids(tree)[0]
        out.ns |= {k[6:]: v for k, v in top.attrs.items() if k.startswith("xmlns:") and k[6:] not in out.ns}
        if not _is(top):  # a literal result element is the template of the root
            return add_rule(Node("element", "xsl:template", None, {"match": "/"}, [top], NS), level) or level
        deepest = level
        for n in _kids(top):
            if _is(n, "import") or _is(n, "include"):
                href = n.attrs["href"]
                if href in trail:
                    raise XsltError(f"{href} includes itself")
                if load is None:
                    raise XsltError(f"no way to load {href}")
                at = deepest + 1 if n.local == "import" else level
                deepest = max(deepest, read(load(href), at, (*trail, href)))
        for n in _kids(top):
            if _is(n, "template"):
                if "name" in n.attrs:
                    out.named.setdefault(n.attrs["name"], n)
                if "match" in n.attrs:
                    add_rule(n, level)
            elif _is(n, "variable") or _is(n, "param"):
                if all(v.attrs["name"] != n.attrs["name"] for v in out.variables):
                    out.variables.append(n)
            elif _is(n, "attribute-set"):
                out.attribute_sets.setdefault(n.attrs["name"], []).append(n)
            elif _is(n, "strip-space"):
                out.strip |= set(n.attrs["elements"].split())
            elif _is(n, "preserve-space"):
                out.preserve |= set(n.attrs["elements"].split())
            elif _is(n, "namespace-alias"):
                out.aliases[n.attrs["stylesheet-prefix"]] = n.attrs["result-prefix"]
            elif _is(n, "key"):
                out.keys.append((n.attrs["name"], X.parse(n.attrs["match"]), X.parse(n.attrs["use"])))
        return deepest

    def add_rule(n: Node, level: int) -> None:
        e = X.parse(n.attrs["match"])
        for p in e[1] if e[0] == "union" else [e]:
            counter[0] += 1
            out.rules.append(Rule(p, n.attrs.get("mode", ""), float(n.attrs.get("priority", _priority(p))), counter[0], level, n))

    read(source, 0, ())
    out.rules.sort(key=lambda r: (r.level, -r.priority, -r.order))
    return out


def _strip_ws(n: Node) -> None:
    """Drops white space from a stylesheet, but in xsl:text."""
    if not _is(n, "text") and n.attrs.get("xml:space") != "preserve":
        n.children = [c for c in n.children if c.kind not in ("comment", "pi") and not (c.kind == "text" and not (c.value or "").strip())]
    for c in n.children:
        _strip_ws(c)


def _leads(n: Node, steps: list, k: int, absolute: bool, c: X.Context) -> bool:
    """Whether the first k + 1 steps may end in a node, read from the last: a node is tested by itself, without its siblings."""
    axis, test, preds = steps[k]
    if n.up is None or n.kind == "error" or (n.kind == "attr") != (axis == "attribute") or not X.passes(n, axis, test, c.ns):
        return False
    if not all(X.to_bool(X.evaluate(p, c.at(n))) for p in preds):
        return False
    if k == 0:
        return not absolute or n.up.up is None
    if steps[k - 1] != X._ANY:
        return _leads(n.up, steps, k - 1, absolute, c)
    if k == 1:
        return True
    up: Node | None = n.up
    while up is not None:
        if _leads(up, steps, k - 2, absolute, c):
            return True
        up = up.up
    return False


def matches(n: Node, e, c: X.Context) -> bool:
    """Whether a node matches a pattern: it is selected from the node itself or one of its ancestors."""
    if e == ("path", "/", []):
        return n.kind == "root"
    if e[0] == "path" and e[1] in (None, "/") and all(s == X._ANY or s[0] in ("child", "attribute") and all(map(X.placeless, s[2])) for s in e[2]) and e[2][-1] != X._ANY:
        return _leads(n, e[2], len(e[2]) - 1, e[1] == "/", c)
    up: Node | None = n
    while up is not None:
        got = X.evaluate(e, c.at(up))
        if isinstance(got, X.NODE_SET) and any(X.order(x) == X.order(n) and x.kind == n.kind for x in got):
            return True
        up = up.up
    return False


class _Run:
    def __init__(self, sheet: Stylesheet, documents: dict[str, Node] | None = None):
        self.sheet, self.documents = sheet, documents or {}
        self.messages: list[str] = []
        self.cache: dict[str, object] = {}
        self.keys: dict[str, dict[str, list[Node]]] = {}

    def expr(self, s: str):
        if s not in self.cache:
            self.cache[s] = X.parse(s)
        return self.cache[s]

    def ev(self, s: str, c: X.Context):
        return X.evaluate(self.expr(s), X.Context(c.node, c.pos, c.size, c.vars, c.ns, c.strict, c.keys, c.documents, c.node))

    def avt(self, s: str, c: X.Context) -> str:
        """An attribute value template."""
        out, k = "", 0
        while k < len(s):
            if s[k : k + 2] in ("{{", "}}"):
                out, k = out + s[k], k + 2
            elif s[k] == "{":
                end, quote = k + 1, ""
                while end < len(s) and (quote or s[end] != "}"):
                    quote = "" if s[end] == quote else quote or (s[end] if s[end] in "'\"" else "")
                    end += 1
                out, k = out + X.to_string(self.ev(s[k + 1 : end], c)), end + 1
            else:
                out, k = out + s[k], k + 1
        return out

    def bind(self, n: Node, c: X.Context):
        """A variable's or parameter's value."""
        if "select" in n.attrs:
            return self.ev(n.attrs["select"], c)
        return [link(root(*self.body(n.children, c, 0)))] if n.children else ""

    def body(self, nodes: list[Node], c: X.Context, depth: int, rule: Rule | None = None, params: dict | None = None) -> list[Node]:
        if depth > 400:
            raise XsltError("templates call each other without end")
        out: list[Node] = []
        before, calls = None, 0
        while True:
            c = X.Context(c.node, c.pos, c.size, dict(c.vars), c.ns, c.strict, c.keys, c.documents)
            last = None
            for k, n in enumerate(nodes, 1):
                if _is(n, "param"):
                    name = n.attrs["name"]
                    c.vars[name] = params[name] if params and name in params else self.bind(n, c)
                elif _is(n, "variable"):
                    c.vars[n.attrs["name"]] = self.bind(n, c)
                elif k == len(nodes) and n.ns == NS and n.local in ("if", "choose", "call-template"):
                    last = n
                else:
                    out.extend(self.one(n, c, depth, rule))
            if last is None:
                return out
            # what stands last goes on here, so that a template that calls itself at its end is a loop
            params = None
            if last.local == "call-template":
                params = self.with_params(last, c)
                now = (last.attrs["name"], params)
                if before is not None and before[0] == now[0] and before[1].keys() == params.keys() and all(type(v) is type(params[k]) and (v is params[k] or not isinstance(v, X.NODE_SET) and v == params[k]) for k, v in before[1].items()):
                    raise XsltError("templates call each other without end")
                calls += 1
                if calls & (calls - 1) == 0:  # so that a round of any length is met
                    before = now
                nodes = self.template(last).children
                c = X.Context(c.node, c.pos, c.size, self.globals, c.ns, c.strict, c.keys, c.documents)
            else:
                nodes = self.branch(last, c)

    def template(self, n: Node) -> Node:
        if n.attrs["name"] not in self.sheet.named:
            raise XsltError(f"no template {n.attrs['name']}")
        return self.sheet.named[n.attrs["name"]]

    def branch(self, n: Node, c: X.Context) -> list[Node]:
        """The instructions of an if or a choose that hold."""
        for k in [n] if n.local == "if" else _kids(n):
            if _is(k, "otherwise") or X.to_bool(self.ev(k.attrs["test"], c)):
                return k.children
        return []

    def with_params(self, n: Node, c: X.Context) -> dict:
        return {p.attrs["name"]: self.bind(p, c) for p in _kids(n) if _is(p, "with-param")}

    def sorted(self, nodes: list[Node], n: Node, c: X.Context) -> list[Node]:
        keys = [k for k in _kids(n) if _is(k, "sort")]
        for k in reversed(keys):
            number = self.avt(k.attrs.get("data-type", "text"), c) == "number"
            values = {}
            for i, x in enumerate(nodes, 1):
                s = X.to_string(self.ev(k.attrs.get("select", "."), c.at(x, i, len(nodes))))
                v = X.to_number(s) if number else s.lower()
                values[id(x)] = -math.inf if number and math.isnan(v) else v
            nodes = sorted(nodes, key=lambda x: values[id(x)], reverse=self.avt(k.attrs.get("order", "ascending"), c) == "descending")
        return nodes

    def select(self, n: Node, c: X.Context, default: str | None = None) -> list[Node]:
        got = self.ev(n.attrs.get("select", default or ""), c)
        if not isinstance(got, X.NODE_SET):
            raise XsltError(f"{n.attrs.get('select')} selects no nodes")
        return got

    def attrs_of(self, names: str, c: X.Context, depth: int, trail: tuple[str, ...] = ()) -> dict[str, str]:
        out: dict[str, str] = {}
        for name in names.split():
            if name in trail:
                raise XsltError(f"attribute set {name} uses itself")
            for s in self.sheet.attribute_sets.get(name, []):
                out |= self.attrs_of(s.attrs.get("use-attribute-sets", ""), c, depth, (*trail, name))
                out |= {a.name: a.value or "" for a in self.body(s.children, c, depth + 1) if a.kind == "attr"}
        return out

    def build(self, e: Node, content: list[Node]) -> Node:
        for x in content:
            if x.kind == "attr":
                if not e.children:
                    e.attrs[x.name] = x.value or ""
            elif x.kind == "root":
                e.children.extend(y.copy() for y in x.children)
            else:
                e.children.append(x)
        return e

    def one(self, n: Node, c: X.Context, depth: int, rule: Rule | None) -> list[Node]:
        a = n.attrs
        if n.kind in ("text", "cdata"):
            return [Node("text", None, n.value)]
        if n.kind != "element":
            return []
        go = lambda kids=n.children: self.body(kids, c, depth + 1, rule)
        if n.ns != NS:
            name = n.name or ""
            prefix = n.prefix or "#default"
            if prefix in self.sheet.aliases:
                to = self.sheet.aliases[prefix]
                name = n.local if to == "#default" else f"{to}:{n.local}"
            e = Node("element", name)
            e.attrs |= self.attrs_of(next((v for k, v in a.items() if k.endswith(":use-attribute-sets")), ""), c, depth)
            for k, v in a.items():
                p = k.split(":")[0]
                if k == "xmlns" or k.startswith("xmlns:"):
                    if v != NS and k[6:] not in self.sheet.aliases:
                        e.attrs[k] = v
                elif not (":" in k and self.sheet.ns.get(p) == NS):
                    e.attrs[k] = self.avt(v, c)
            return [self.build(e, go())]
        what = n.local
        if what == "text":
            return [Node("text", None, n.text())]
        if what == "value-of":
            s = X.to_string(self.ev(a["select"], c))
            return [Node("text", None, s)] if s else []
        if what == "for-each":
            nodes = self.sorted(self.select(n, c), n, c)
            kids = [k for k in n.children if not _is(k, "sort")]
            return [y for i, x in enumerate(nodes, 1) for y in self.body(kids, c.at(x, i, len(nodes)), depth + 1)]
        if what in ("if", "choose"):
            return go(self.branch(n, c))
        if what == "element":
            e = Node("element", self.avt(a["name"], c))
            if "namespace" in a:
                p = e.name.split(":")[0] if ":" in e.name else ""
                e.attrs[f"xmlns:{p}" if p else "xmlns"] = self.avt(a["namespace"], c)
            e.attrs |= self.attrs_of(a.get("use-attribute-sets", ""), c, depth)
            return [self.build(e, go())]
        if what == "attribute":
            return [Node("attr", self.avt(a["name"], c), "".join(x.text() for x in go()))]
        if what == "comment":
            s = "".join(x.text() for x in go())
            while "--" in s:
                s = s.replace("--", "- -")
            return [Node("comment", None, s + (" " if s.endswith("-") else ""))]
        if what == "processing-instruction":
            return [Node("pi", self.avt(a["name"], c), "".join(x.text() for x in go()).replace("?>", "? >"))]
        if what == "copy":
            x = c.node
            if x.kind == "root":
                return go()
            if x.kind != "element":
                return [Node(x.kind, x.name, x.value)]
            e = Node("element", x.name, None, {k: v for k, v in x.attrs.items() if k.startswith("xmlns")} | self.attrs_of(a.get("use-attribute-sets", ""), c, depth))
            return [self.build(e, go())]
        if what == "copy-of":
            got = self.ev(a["select"], c)
            if not isinstance(got, X.NODE_SET):
                return [Node("text", None, X.to_string(got))]
            return [y for x in got for y in ([k.copy() for k in x.children] if x.kind == "root" else [x.copy()])]
        if what == "apply-templates":
            nodes = self.sorted(self.select(n, c, "child::node()"), n, c)
            return self.apply(nodes, a.get("mode", ""), c, depth, self.with_params(n, c))
        if what == "apply-imports":
            if rule is None:
                return []
            return self.apply_one(c, rule.mode, depth, {}, rule.level + 1)
        if what == "call-template":
            return self.body(self.template(n).children, X.Context(c.node, c.pos, c.size, self.globals, c.ns, c.strict, c.keys, c.documents), depth + 1, rule, self.with_params(n, c))
        if what == "number":
            same = [x for x in (c.node.up.children if c.node.up is not None else [c.node]) if x.kind == c.node.kind and x.name == c.node.name]
            k = X.to_number(self.ev(a["value"], c)) if "value" in a else 1.0 + next((i for i, x in enumerate(same) if x is c.node), 0)
            return [Node("text", None, X.to_string(k))]
        if what == "message":
            self.messages.append("".join(x.text() for x in go()))
            if a.get("terminate") == "yes":
                raise XsltError(self.messages[-1])
            return []
        if what in ("fallback", "sort", "with-param"):
            return []
        raise XsltError(f"unknown instruction {n.name}")

    def apply(self, nodes: list[Node], mode: str, c: X.Context, depth: int, params: dict) -> list[Node]:
        return [y for i, x in enumerate(nodes, 1) for y in self.apply_one(c.at(x, i, len(nodes)), mode, depth, params)]

    def apply_one(self, c: X.Context, mode: str, depth: int, params: dict, level: int = 0) -> list[Node]:
        c = X.Context(c.node, c.pos, c.size, self.globals, c.ns, c.strict, c.keys, c.documents)
        for r in self.sheet.rules:
            if r.mode == mode and r.level >= level and matches(c.node, r.match, c):
                return self.body(r.body.children, c, depth + 1, r, params)
        n = c.node
        if n.kind in ("root", "element"):
            return self.apply(n.children, mode, c, depth + 1, {})
        return [Node("text", None, n.text())] if n.kind in ("text", "cdata", "attr") else []

    def transform(self, tree: Node, params: dict | None = None) -> Node:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))  # the depth of body() is bounded before that
        propagate_namespaces(tree)
        if self.sheet.strip:
            for n in tree.walk():
                if n.kind == "element" and (n.name in self.sheet.strip or "*" in self.sheet.strip) and n.name not in self.sheet.preserve:
                    n.children = [x for x in n.children if not (x.kind == "text" and not (x.value or "").strip())]
        link(tree)
        c = X.Context(tree, ns=self.sheet.ns, keys=self.keys, documents=self.documents)
        for name, match, use in self.sheet.keys:
            table = self.keys.setdefault(name, {})
            for n in tree.walk():
                if matches(n, match, c):
                    v = X.evaluate(use, c.at(n))
                    for s in [x.text() for x in v] if isinstance(v, X.NODE_SET) else [X.to_string(v)]:
                        table.setdefault(s, []).append(n)
        self.globals: dict = {}
        c.vars = self.globals
        for v in self.sheet.variables:
            given = (params or {}).get(v.attrs["name"]) if v.local == "param" else None
            self.globals[v.attrs["name"]] = given if given is not None else self.bind(v, c)
        return link(collapse_all_text(self.build(root(), self.apply_one(c, "", 0, {}))))


def transform(tree: Node, sheet: Stylesheet, params: dict | None = None, documents: dict[str, Node] | None = None) -> Node:
    """The result tree of a stylesheet on a document."""
    return _Run(sheet, documents).transform(tree, params)


def apply_stylesheet(nodes: DataFrame, source: str, params: dict | None = None, load: Callable[[str], str] | None = None) -> DataFrame:
    """NODE rows of each document's result; a failed transformation gives a root with an error row."""
    sheet = compile_stylesheet(source, load)

    def run(tree: Node) -> list[Node]:
        try:
            return [transform(tree, sheet, params)]
        except (XsltError, X.XPathError) as e:
            return [root(Node("error", None, str(e), {"level": "3"}))]

    return rewrite(nodes, run)


def transform_to_text(nodes: DataFrame, source: str, params: dict | None = None, method: str = "xml", load: Callable[[str], str] | None = None) -> DataFrame:
    """doc_id and text of each document's result; a failure is raised."""
    sheet = compile_stylesheet(source, load)
    return map_trees(nodes, lambda i, t: [(i, to_xml(transform(t, sheet, params), method))], "doc_id long, text string")
