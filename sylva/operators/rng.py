"""Relax NG: schemas in XML syntax, simplified to patterns, and validation by derivatives of patterns, one document at a time."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame

from ..functions import datatypes as D
from ..model import Node
from ..sources.documents import map_trees
from ..sources.xml import parse_xml
from .edit import propagate_namespaces

NS = "http://relaxng.org/ns/structure/1.0"
XSD = "http://www.w3.org/2001/XMLSchema-datatypes"
MYSQL = "http://relaxng.org/mysql"
NO, EMPTY, TEXT = ("no",), ("empty",), ("text",)


class SchemaError(ValueError):
    """A schema that is not correct."""


def choice(a, b):
    return b if a == NO or a == b else a if b == NO else ("choice", a, b)


def group(a, b):
    return NO if NO in (a, b) else b if a == EMPTY else a if b == EMPTY else ("group", a, b)


def interleave(a, b):
    return NO if NO in (a, b) else b if a == EMPTY else a if b == EMPTY else ("interleave", a, b)


def one_or_more(a):
    return a if a in (NO, EMPTY) else ("more", a)


def after(a, b):
    return NO if NO in (a, b) else ("after", a, b)


class Grammar:
    """A compiled schema: the start pattern and the definitions that references name."""

    def __init__(self, start, defines: dict[str, tuple]):
        self.start, self.defines = start, defines

    def open(self, p):
        """References at the top resolved."""
        seen = set()
        while p[0] == "ref":
            if p[1] in seen or p[1] not in self.defines:
                raise SchemaError(f"definition {p[1]} is missing or refers to itself")
            seen.add(p[1])
            p = self.defines[p[1]]
        return p


def compile_schema(source: str, load: Callable[[str], str] | None = None) -> Grammar:
    """Reads a schema in XML syntax; load gives the text of included and external schemas by their href."""
    tree, problems = parse_xml(source)
    if problems:
        raise SchemaError(problems[0][1])
    propagate_namespaces(tree)
    top = next((c for c in tree.children if c.kind == "element"), None)
    if top is None or top.ns != NS:
        raise SchemaError("this is no Relax NG schema")
    defines: dict[str, tuple] = {}
    count = [0]

    def kids(n: Node) -> list[Node]:
        return [c for c in n.children if c.kind == "element" and c.ns == NS]

    def need(n: Node, name: str) -> str:
        if name not in n.attrs:
            raise SchemaError(f"{n.local} needs the attribute {name}")
        return n.attrs[name].strip()

    def name_class(n: Node, env: dict):
        if n.local == "name":
            q = n.text().strip()
            return ("name", env["ns"] if ":" not in q else env["prefixes"].get(q.split(":")[0], ""), q.split(":")[-1])
        if n.local in ("anyName", "nsName"):
            e = next((k for k in kids(n) if k.local == "except"), None)
            out = NO
            for k in kids(e) if e is not None else []:
                c = name_class(k, scope(k, env))
                out = c if out == NO else ("choice", out, c)
            return (n.local, env["ns"] if n.local == "nsName" else None, None if out == NO else out)
        if n.local == "choice":
            parts = [name_class(k, scope(k, env)) for k in kids(n)]
            out = parts[0]
            for p in parts[1:]:
                out = ("choice", out, p)
            return out
        raise SchemaError(f"{n.local} is no name class")

    def scope(n: Node, env: dict) -> dict:
        env = dict(env)
        env["prefixes"] = env["prefixes"] | {k[6:]: v for k, v in n.attrs.items() if k.startswith("xmlns:")}
        if "ns" in n.attrs:
            env["ns"] = n.attrs["ns"]
        if "datatypeLibrary" in n.attrs:
            env["lib"] = n.attrs["datatypeLibrary"]
        return env

    def many(nodes: list[Node], env: dict, f=group):
        out = None
        for k in nodes:
            p = pattern(k, env)
            out = p if out is None else f(out, p)
        if out is None:
            raise SchemaError("a pattern is empty")
        return out

    def fetch(n: Node) -> Node:
        if load is None:
            raise SchemaError(f"no way to load {need(n, 'href')}")
        t, bad = parse_xml(load(need(n, "href")))
        if bad:
            raise SchemaError(bad[0][1])
        propagate_namespaces(t)
        return next(c for c in t.children if c.kind == "element")

    def pattern(n: Node, env: dict):
        env = scope(n, env)
        what, own = n.local, kids(n)
        if what in ("element", "attribute"):
            if "name" in n.attrs:
                q = n.attrs["name"].strip()
                ns = (env["ns"] if what == "element" or "ns" in n.attrs else "") if ":" not in q else env["prefixes"].get(q.split(":")[0], "")
                nc, rest = ("name", ns, q.split(":")[-1]), own
            else:
                if not own:
                    raise SchemaError(f"{what} has no name")
                nc, rest = name_class(own[0], scope(own[0], env if what == "element" else env | {"ns": env["ns"] if "ns" in n.attrs else ""})), own[1:]
            if what == "attribute":
                return ("attribute", nc, many(rest, env) if rest else TEXT)
            count[0] += 1
            name = f"\0{count[0]}"
            defines[name] = ("element", nc, name)
            defines[name + "c"] = many(rest, env)
            return ("ref", name)
        if what in ("group", "interleave", "choice"):
            return many(own, env, {"group": group, "interleave": interleave, "choice": choice}[what])
        if what in ("oneOrMore", "zeroOrMore", "optional", "mixed", "list"):
            p = many(own, env)
            return {"oneOrMore": lambda: one_or_more(p), "zeroOrMore": lambda: choice(one_or_more(p), EMPTY), "optional": lambda: choice(p, EMPTY), "mixed": lambda: interleave(p, TEXT), "list": lambda: ("list", p)}[what]()
        if what in ("text", "empty", "notAllowed"):
            return {"text": TEXT, "empty": EMPTY, "notAllowed": NO}[what]
        if what == "data":
            e = next((k for k in own if k.local == "except"), None)
            params = tuple((need(k, "name"), k.text()) for k in own if k.local == "param")
            _lib(env["lib"], need(n, "type"))
            return ("data", env["lib"], need(n, "type"), params, many(kids(e), env, choice) if e is not None else None)
        if what == "value":
            lib, kind = (env["lib"], n.attrs["type"].strip()) if "type" in n.attrs else ("", "token")
            return ("value", lib, kind, n.text())
        if what in ("ref", "parentRef"):
            g = env["grammar"] if what == "ref" else env["parent"]
            if g is None:
                raise SchemaError(f"{what} outside of a grammar")
            return ("ref", f"{g}:{need(n, 'name')}")
        if what == "externalRef":
            return pattern(fetch(n), env)
        if what == "grammar":
            return grammar(n, env)
        raise SchemaError(f"unknown pattern {what}")

    def grammar(n: Node, env: dict):
        count[0] += 1
        gid = f"g{count[0]}"
        env = scope(n, env) | {"parent": env["grammar"], "grammar": gid}
        found: dict[str, list[tuple[str | None, tuple]]] = {}

        def collect(g: Node, env: dict, skip: frozenset = frozenset()) -> None:
            for k in kids(g):
                e = scope(k, env)
                if k.local in ("start", "define"):
                    name = "" if k.local == "start" else need(k, "name")
                    if name not in skip:
                        found.setdefault(name, []).append((k.attrs.get("combine"), many(kids(k), e)))
                elif k.local == "div":
                    collect(k, e, skip)
                elif k.local == "include":
                    over = frozenset("" if x.local == "start" else x.attrs.get("name", "") for x in k.walk() if x.kind == "element" and x.local in ("start", "define"))
                    inner = fetch(k)
                    collect(inner, scope(inner, e), over | skip)
                    collect(k, e, skip)
                else:
                    raise SchemaError(f"{k.local} in a grammar")

        collect(n, env)
        for name, parts in found.items():
            how = {c for c, _ in parts if c}
            if len(how) > 1 or sum(c is None for c, _ in parts) > 1:
                raise SchemaError(f"definitions of {name or 'start'} do not combine")
            out = parts[0][1]
            for _, p in parts[1:]:
                out = (choice if how == {"choice"} else interleave)(out, p)
            defines[f"{gid}:{name}"] = out
        if "" not in found:
            raise SchemaError("a grammar has no start")
        return ("ref", f"{gid}:")

    start = pattern(top, {"ns": "", "lib": "", "prefixes": {}, "grammar": None, "parent": None})
    g = Grammar(start, defines)
    _check(g)
    return g


def _lib(uri: str, kind: str) -> None:
    if uri == "" and kind not in ("string", "token") or uri == XSD and kind not in D.TYPES or uri not in ("", XSD) and "mysql" not in uri.lower():
        raise SchemaError(f"unknown type {kind} of library {uri!r}")


def _check(g: Grammar) -> None:
    """Restrictions: references resolve, attributes hold no elements or attributes, lists hold no elements or text."""
    done: set = set()

    def visit(p, inside: str) -> None:
        if (p, inside) in done:
            return
        done.add((p, inside))
        k = p[0]
        if k == "ref":
            p = g.open(p)
            k = p[0]
        if k == "element":
            if inside:
                raise SchemaError(f"an element in {inside}")
            return visit(g.defines[p[2] + "c"], "")
        if k == "attribute":
            if inside:
                raise SchemaError(f"an attribute in {inside}")
            return visit(p[2], "an attribute")
        if k == "text" and inside == "a list":
            raise SchemaError("text in a list")
        if k == "list":
            if inside == "a list":
                raise SchemaError("a list in a list")
            return visit(p[1], "a list")
        for x in p[1:]:
            if isinstance(x, tuple) and x and isinstance(x[0], str) and k not in ("data", "value"):
                visit(x, inside)

    visit(g.start, "")


def contains(nc, ns: str, local: str) -> bool:
    """Whether a name class has a name."""
    if nc[0] == "name":
        return nc[1:] == (ns, local)
    if nc[0] == "choice":
        return contains(nc[1], ns, local) or contains(nc[2], ns, local)
    return (nc[0] == "anyName" or nc[1] == ns) and not (nc[2] and contains(nc[2], ns, local))


class Validator:
    def __init__(self, g: Grammar):
        self.g = g
        self.null = lru_cache(maxsize=1 << 14)(self._nullable)
        self.open = lru_cache(maxsize=1 << 14)(self._start_open)
        self.close = lru_cache(maxsize=1 << 14)(self._start_close)

    def _nullable(self, p) -> bool:
        p = self.g.open(p)
        k = p[0]
        if k in ("group", "interleave"):
            return self.null(p[1]) and self.null(p[2])
        if k == "choice":
            return self.null(p[1]) or self.null(p[2])
        return self.null(p[1]) if k == "more" else k in ("empty", "text")

    def _apply(self, f, p):
        if p[0] == "after":
            return after(p[1], f(p[2]))
        if p[0] == "choice":
            return choice(self._apply(f, p[1]), self._apply(f, p[2]))
        return NO

    def _start_open(self, p, ns: str, local: str):
        p = self.g.open(p)
        k = p[0]
        rec = lambda q: self.open(q, ns, local)
        if k == "choice":
            return choice(rec(p[1]), rec(p[2]))
        if k == "element":
            return after(self.g.defines[p[2] + "c"], EMPTY) if contains(p[1], ns, local) else NO
        if k == "interleave":
            return choice(self._apply(lambda x: interleave(x, p[2]), rec(p[1])), self._apply(lambda x: interleave(p[1], x), rec(p[2])))
        if k == "more":
            return self._apply(lambda x: group(x, choice(p, EMPTY)), rec(p[1]))
        if k == "group":
            x = self._apply(lambda y: group(y, p[2]), rec(p[1]))
            return choice(x, rec(p[2])) if self.null(p[1]) else x
        if k == "after":
            return self._apply(lambda x: after(x, p[2]), rec(p[1]))
        return NO

    def att(self, p, ns: str, local: str, value: str):
        p = self.g.open(p)
        k = p[0]
        rec = lambda q: self.att(q, ns, local, value)
        if k == "after":
            return after(rec(p[1]), p[2])
        if k == "choice":
            return choice(rec(p[1]), rec(p[2]))
        if k == "group":
            return choice(group(rec(p[1]), p[2]), group(p[1], rec(p[2])))
        if k == "interleave":
            return choice(interleave(rec(p[1]), p[2]), interleave(p[1], rec(p[2])))
        if k == "more":
            return group(rec(p[1]), choice(p, EMPTY))
        if k == "attribute" and contains(p[1], ns, local):
            ok = self.null(p[2]) and not value.strip() or self.null(self.text(p[2], value))
            return EMPTY if ok else NO
        return NO

    def _start_close(self, p):
        p = self.g.open(p)
        k = p[0]
        if k == "after":
            return after(self.close(p[1]), p[2])
        if k in ("choice", "group", "interleave"):
            return {"choice": choice, "group": group, "interleave": interleave}[k](self.close(p[1]), self.close(p[2]))
        if k == "more":
            return one_or_more(self.close(p[1]))
        return NO if k == "attribute" else p

    def text(self, p, s: str):
        p = self.g.open(p)
        k = p[0]
        rec = lambda q: self.text(q, s)
        if k == "choice":
            return choice(rec(p[1]), rec(p[2]))
        if k == "interleave":
            return choice(interleave(rec(p[1]), p[2]), interleave(p[1], rec(p[2])))
        if k == "group":
            x = group(rec(p[1]), p[2])
            return choice(x, rec(p[2])) if self.null(p[1]) else x
        if k == "after":
            return after(rec(p[1]), p[2])
        if k == "more":
            return group(rec(p[1]), choice(p, EMPTY))
        if k == "text":
            return TEXT
        if k == "value":
            if p[1] == "":
                ok = s == p[3] if p[2] == "string" else s.split() == p[3].split()
            else:
                ok = not self._allows(p[1], p[2], s, ()) and D.equal(p[2], s, p[3])
            return EMPTY if ok else NO
        if k == "data":
            ok = not self._allows(p[1], p[2], s, p[3]) and not (p[4] is not None and self.null(self.text(p[4], s)))
            return EMPTY if ok else NO
        if k == "list":
            x = p[1]
            for t in s.split():
                x = self.text(x, t)
            return EMPTY if self.null(x) else NO
        return NO

    def _allows(self, lib: str, kind: str, s: str, params: tuple) -> str | None:
        if lib == "":
            return None
        if lib != XSD:
            return D.allows_mysql(kind, s, dict(params))
        facets: dict = {}
        for k, v in params:
            facets.setdefault(k, []).append(v)
        return D.allows(kind, s, facets)

    def end(self, p):
        if p[0] == "choice":
            return choice(self.end(p[1]), self.end(p[2]))
        return p[2] if p[0] == "after" and self.null(p[1]) else NO

    def element(self, p, n: Node, path: str, out: list[str]):
        """What is left of a pattern after an element; problems go to out."""
        at = f"{path}/{n.name}"
        x = self.open(p, n.ns, n.local)
        if x == NO:
            out.append(f"element {at} is not allowed here")
            return NO
        for k, v in n.attrs.items():
            if k == "xmlns" or k.startswith("xmlns:"):
                continue
            ns = "" if ":" not in k else "http://www.w3.org/XML/1998/namespace" if k.startswith("xml:") else self._ns(n, k)
            y = self.att(x, ns, k.split(":")[-1], v)
            if y == NO:
                out.append(f"attribute {k}={v!r} of {at} is not allowed")
                return NO
            x = y
        y = self.close(x)
        if y == NO:
            out.append(f"{at} lacks an attribute")
            return NO
        return self.end_or_report(self.children(y, n, at, out), at, out)

    def _ns(self, n: Node, name: str) -> str:
        prefix = name.split(":")[0]
        up: Node | None = n
        while up is not None:
            if f"xmlns:{prefix}" in up.attrs:
                return up.attrs[f"xmlns:{prefix}"]
            up = up.up
        return ""

    def end_or_report(self, p, at: str, out: list[str]):
        if p == NO:
            return NO
        x = self.end(p)
        if x == NO:
            out.append(f"the content of {at} is not complete")
        return x

    def children(self, p, n: Node, at: str, out: list[str]):
        kids: list[Node | str] = []
        for c in n.children:
            if c.kind == "element":
                kids.append(c)
            elif c.kind in ("text", "cdata"):
                if kids and isinstance(kids[-1], str):
                    kids[-1] += c.value or ""
                else:
                    kids.append(c.value or "")
        if not kids:
            kids = [""]
        if len(kids) == 1 and isinstance(kids[0], str):
            x = self.text(p, kids[0])
            x = choice(p, x) if not kids[0].strip() else x
            if x == NO:
                out.append(f"text {kids[0][:40]!r} in {at} is not allowed")
            return x
        for c in kids:
            if isinstance(c, str):
                if not c.strip():
                    continue
                x = self.text(p, c)
                if x == NO:
                    out.append(f"text {c[:40]!r} in {at} is not allowed")
            else:
                x = self.element(p, c, at, out)
            if x == NO:
                return NO
            p = x
        return p


def validate(tree: Node, g: Grammar) -> list[str]:
    """Problems of a tree (linked, namespaces resolved here); none if it is valid."""
    propagate_namespaces(tree)
    out: list[str] = []
    v = Validator(g)
    tops = [c for c in tree.children if c.kind == "element"]
    if not tops:
        return ["the document is empty"]
    x = v.element(g.start, tops[0], "", out)
    if not out and not v.null(x):
        out.append("the document is not complete")
    return out


def validate_rng(nodes: DataFrame, schema: str, load: Callable[[str], str] | None = None) -> DataFrame:
    """doc_id, ok and the problems of each document."""
    g = compile_schema(schema, load)

    def run(doc_id, tree):
        bad = validate(tree, g)
        return [(doc_id, not bad, bad)]

    return map_trees(nodes, run, "doc_id long, ok boolean, errors array<string>")
