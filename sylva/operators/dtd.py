"""DTD validation: declarations, content models, attributes, IDs; defaults. On one tree, and on node tables as anti-joins."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import regex as R
from ..model import Node

_NAME = re.compile(r"[A-Za-z_:À-￿][-\w.:·]*\Z")
_TOKEN = re.compile(r"[-\w.:·]+\Z")


@dataclass
class Rules:
    """The declarations of a DTD; the first of a name holds."""

    root: str = ""
    elements: dict[str, str] = field(default_factory=dict)
    attrs: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)
    entities: dict[str, dict[str, str]] = field(default_factory=dict)
    notations: set[str] = field(default_factory=set)
    problems: list[tuple[int, str]] = field(default_factory=list)


def declarations(tree: Node) -> Rules | None:
    """The internal subset's rules, with the problems of the declarations themselves; None without a DOCTYPE."""
    doc = next((n for n in tree.children if n.kind == "dtd"), None)
    if doc is None or not doc.children:
        return None
    r = Rules(root=doc.name or "")
    for d in doc.children:
        a = d.attrs
        if d.name == "ELEMENT":
            if a["name"] in r.elements:
                r.problems.append((2, f"element {a['name']} is declared twice"))
            r.elements.setdefault(a["name"], a["model"])
            if a["model"].startswith("(#PCDATA"):
                names = re.findall(r"[^\s|()*]+", a["model"])
                r.problems += [(2, f"{x} occurs twice in the mixed content of {a['name']}") for x, n in Counter(names).items() if n > 1]
        elif d.name == "ATTLIST":
            own = r.attrs.setdefault(a["element"], {})
            if a["name"] in own:
                r.problems.append((1, f"attribute {a['name']} of {a['element']} is declared twice"))
            own.setdefault(a["name"], a)
        elif d.name == "ENTITY":
            if a["name"] in r.entities:
                r.problems.append((1, f"entity {a['name']} is declared twice"))
            r.entities.setdefault(a["name"], a)
        elif d.name == "NOTATION":
            if a["name"] in r.notations:
                r.problems.append((2, f"notation {a['name']} is declared twice"))
            r.notations.add(a["name"])
    r.problems += [(2, f"notation {e['ndata']} of entity {k} is not declared") for k, e in r.entities.items() if e.get("ndata") and e["ndata"] not in r.notations]
    for el, m in r.elements.items():
        r.problems += [(1, f"element {x} in the content of {el} is not declared") for x in sorted(set(re.findall(r"[^\s|,()*+?#]+", m)) - {"EMPTY", "ANY", "PCDATA"}) if x not in r.elements]
    for el, own in r.attrs.items():
        if el not in r.elements:
            r.problems.append((1, f"element {el} of an attribute list is not declared"))
        for kind in ("ID", "NOTATION"):
            if sum(a["type"] == kind or kind == "NOTATION" and a["type"].startswith("NOTATION") for a in own.values()) > 1:
                r.problems.append((2, f"element {el} has two attributes of type {kind}"))
        for name, a in own.items():
            if a["type"] == "ID" and a["use"] in ("default", "fixed"):
                r.problems.append((2, f"ID attribute {name} of {el} has a default"))
            if enum := _enum(a["type"]):
                r.problems += [(2, f"value {x} of attribute {name} of {el} occurs twice") for x, n in Counter(enum).items() if n > 1]
            if a.get("default") is not None and (m := value_error(a, a["default"], r)):
                r.problems.append((2, f"default of attribute {name} of {el}: {m}"))
    return r


def _enum(kind: str) -> list[str] | None:
    return re.findall(r"[^\s|()]+", kind[kind.index("(") :]) if "(" in kind else None


def content_regex(model: str):
    """The regular expression of a content model over names, each ended by a blank."""
    at = 0

    def item():
        nonlocal at
        if model[at] == "(":
            at += 1
            out, mark = item(), ""
            while model[at] != ")":
                mark = model[at]
                at += 1
                nxt = item()
                out = R.alt(out, nxt) if mark == "|" else R.seq(out, nxt)
            at += 1
        else:
            m = re.compile(r"[^\s|,()*+?]+").match(model, at)
            name, at = m[0], m.end()
            out = R.UNIT if name == "#PCDATA" else R.word(name + " ")
        if at < len(model) and model[at] in "*+?":
            out = {"*": R.star, "+": lambda x: R.rng(1, R.INF, x), "?": R.opt}[model[at]](out)
            at += 1
        return out

    model = re.sub(r"\s+", "", model)
    return item()


def normalize_value(kind: str, s: str) -> str:
    """White space to blanks; collapsed, for types other than CDATA."""
    s = re.sub(r"[\t\r\n]", " ", s)
    return s if kind == "CDATA" else " ".join(s.split())


def value_error(a: dict[str, str], s: str, r: Rules) -> str | None:
    kind, items = a["type"], s.split()
    if enum := _enum(kind):
        return None if s.strip() in enum else f"{s!r} is not one of {'|'.join(enum)}"
    if kind in ("ID", "IDREF", "ENTITY") and not _NAME.match(s.strip()) or kind in ("IDREFS", "ENTITIES") and not (items and all(_NAME.match(x) for x in items)):
        return f"{s!r} is not of type {kind}"
    if kind == "NMTOKEN" and not _TOKEN.match(s.strip()) or kind == "NMTOKENS" and not (items and all(_TOKEN.match(x) for x in items)):
        return f"{s!r} is not of type {kind}"
    if kind in ("ENTITY", "ENTITIES"):
        bad = [x for x in items if not r.entities.get(x, {}).get("ndata")]
        return f"entity {bad[0]} is not declared as unparsed" if bad else None
    return None


def validate(tree: Node, r: Rules | None = None) -> list[str]:
    """All problems of a document against its DTD."""
    r = r or declarations(tree)
    if r is None:
        return ["no document type declaration"]
    out = [m for level, m in r.problems if level > 1]
    top = next((c for c in tree.children if c.kind == "element"), None)
    if top is not None and r.root and top.name != r.root:
        out.append(f"root element {top.name} is not {r.root}")
    models: dict[str, tuple] = {}
    ids: list[str] = []
    refs: list[tuple[str, str]] = []
    for n in tree.walk():
        if n.kind != "element":
            continue
        m = r.elements.get(n.name or "")
        if m is None:
            out.append(f"element {n.name} is not declared")
        else:
            names = [c.name or "" for c in n.children if c.kind == "element"]
            text = any(c.kind in ("text", "cdata", "charref") and ((c.value or "").strip() or c.kind != "text") for c in n.children)
            if m == "EMPTY":
                bad = bool(n.children)
            elif m == "ANY":
                bad = False
            elif m.startswith("(#PCDATA"):
                bad = not set(names) <= set(re.findall(r"[^\s|()*#]+", m))
            else:
                if m not in models:
                    models[m] = content_regex(m)
                bad = text or not R.match(models[m], "".join(x + " " for x in names))
            if bad:
                out.append(f"content of element {n.name} does not match {m}: {' '.join(names)}{' with text' if text else ''}")
        own = r.attrs.get(n.name or "", {})
        for name, a in own.items():
            if name not in n.attrs:
                if a["use"] == "required":
                    out.append(f"attribute {name} of element {n.name} is missing")
                continue
            v = normalize_value(a["type"], n.attrs[name])
            if a["use"] == "fixed" and v != normalize_value(a["type"], a.get("default") or ""):
                out.append(f"attribute {name} of element {n.name} is not {a.get('default')!r}")
            if e := value_error(a, v, r):
                out.append(f"attribute {name} of element {n.name}: {e}")
            if a["type"] == "ID":
                ids.append(v)
            elif a["type"] in ("IDREF", "IDREFS"):
                refs += [(x, n.name or "") for x in v.split()]
        out += [f"attribute {k} of element {n.name} is not declared" for k in n.attrs if k not in own and not k.startswith("xmlns")]
    out += [f"ID {x} occurs {k} times" for x, k in Counter(ids).items() if k > 1]
    out += [f"IDREF {x} in element {el} has no ID" for x, el in refs if x not in set(ids)]
    return out


def transform(tree: Node, r: Rules | None = None) -> Node:
    """Adds default values, normalises values and sorts attributes by name."""
    r = r or declarations(tree) or Rules()
    for n in tree.walk():
        if n.kind == "element":
            own = r.attrs.get(n.name or "", {})
            given = {k: normalize_value(own[k]["type"], v) if k in own else v for k, v in n.attrs.items()}
            default = {k: a["default"] for k, a in own.items() if a["use"] in ("default", "fixed") and a.get("default") is not None}
            n.attrs = dict(sorted((default | given).items()))
    return tree


# node tables: rules as DataFrames or lists, errors as rows


def missing_attributes(nodes: DataFrame, element: str, name: str) -> DataFrame:
    """Elements without a required attribute."""
    return nodes.where((F.col("kind") == "element") & (F.col("name") == element) & ~F.coalesce(F.map_contains_key("attrs", name), F.lit(False))).select("doc_id", "node_id", F.lit(f"attribute {name} of element {element} is missing").alias("msg"))


def duplicate_ids(nodes: DataFrame, name: str = "id") -> DataFrame:
    """IDs that occur more than once in a document, with their number."""
    v = F.try_element_at("attrs", F.lit(name))
    return nodes.where("kind = 'element'").select("doc_id", v.alias("id")).where("id is not null").groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling_refs(nodes: DataFrame, ref: str, name: str = "id") -> DataFrame:
    """References (blank-separated) without an ID in their document."""
    get = lambda k: F.try_element_at("attrs", F.lit(k))
    own = nodes.where("kind = 'element'")
    refs = own.select("doc_id", F.explode(F.split(F.trim(get(ref)), r"\s+")).alias("id")).where("id <> ''")
    return refs.join(own.select("doc_id", get(name).alias("id")).where("id is not null"), ["doc_id", "id"], "left_anti")


def add_defaults(nodes: DataFrame, element: str, defaults: dict[str, str]) -> DataFrame:
    """Default attribute values where elements have none."""
    both = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in defaults.items()]))
    have = F.coalesce("attrs", F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>")))
    new = F.map_concat(have, F.map_filter(both, lambda k, v: ~F.map_contains_key(have, k)))
    return nodes.withColumn("attrs", F.when((F.col("kind") == "element") & (F.col("name") == element), new).otherwise(F.col("attrs")))


def content_errors(nodes: DataFrame, models: dict[str, str]) -> DataFrame:
    """Elements whose child names do not match their content model, as one aggregate by parent and a pattern on it."""
    kids = nodes.where("kind = 'element' and parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "name"))), lambda x: F.concat(x["name"], F.lit(" "))), "").alias("names"))
    own = nodes.where((F.col("kind") == "element") & F.col("name").isin(*models)).join(kids, ["doc_id", "node_id"], "left").withColumn("names", F.coalesce("names", F.lit("")))
    ok = F.lit(True)
    for name, m in models.items():
        if m == "EMPTY":
            test = F.col("size") == 0
        elif m == "ANY":
            test = F.lit(True)
        else:
            test = F.col("names").rlike(f"\\A(?:{R.to_java(content_regex(m))})\\z")
        ok = F.when(F.col("name") == name, test).otherwise(ok)
    return own.where(~ok).select("doc_id", "node_id", "name", "names")
