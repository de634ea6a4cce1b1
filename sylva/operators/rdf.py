"""RDF/XML node tables to triples, and a small SPARQL: SELECT [vars|*] WHERE { patterns }."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def _attr(name: str):
    return F.try_element_at("attrs", F.lit(name))


def triples(nodes: DataFrame) -> DataFrame:
    """(doc_id, s, p, o, o_kind, o_lang, o_type) of rdf:Description elements: two joins of children with their parents.

    Namespaces must be resolved (check_namespaces when reading), for a predicate is its element's namespace and name.
    """
    subj = nodes.where((F.col("local") == "Description") & (F.col("ns_uri") == RDF)).select(
        "doc_id", F.col("node_id").alias("sid"), F.coalesce(_attr("rdf:about"), F.concat(F.lit("_:"), _attr("rdf:nodeID")), F.concat(F.lit("_:"), F.col("node_id").cast("string"))).alias("s")
    )
    pred = nodes.where("kind = 'element'").select(
        "doc_id", F.col("node_id").alias("pid"), F.col("parent_id").alias("sid"), F.concat("ns_uri", "local").alias("p"),
        _attr("rdf:resource").alias("res"), _attr("rdf:nodeID").alias("nid"), _attr("xml:lang").alias("o_lang"), _attr("rdf:datatype").alias("o_type"),
    )
    text = nodes.where("kind in ('text', 'cdata')").groupBy("doc_id", F.col("parent_id").alias("pid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), "").alias("t"))
    joined = subj.join(pred, ["doc_id", "sid"]).join(text, ["doc_id", "pid"], "left")
    kind = F.when(F.col("res").isNotNull(), "uri").when(F.col("nid").isNotNull(), "blank").otherwise("literal")
    obj = F.coalesce("res", F.concat(F.lit("_:"), F.col("nid")), F.coalesce("t", F.lit("")))
    return joined.select("doc_id", "s", "p", obj.alias("o"), kind.alias("o_kind"), "o_lang", "o_type")


@dataclass
class Query:
    vars: list[str]  # empty: all
    patterns: list[tuple[str, str, str]]  # ?x a variable, else a constant


class SparqlError(ValueError):
    """A query that cannot be read."""


def parse(source: str) -> Query:
    """PREFIX and BASE, SELECT with variables or *, and patterns with ; and , for a repeated subject or predicate; a is rdf:type."""
    prefixes: dict[str, str] = {}
    base = ""
    tokens = re.findall(r"<[^>\s]*>|\"(?:[^\"\\]|\\.)*\"(?:@[\w-]+|\^\^\S+)?|'(?:[^'\\]|\\.)*'|[?$]\w+|[\w-]*:[\w.-]*|[{};,.*]|[\w+.-]+", re.sub(r"(?m)^\s*#.*$", "", source))
    at = 0

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise SparqlError("the query ends too soon")
        at += 1
        return tokens[at - 1]

    def term(t: str) -> str:
        if t[0] in "?$":
            return "?" + t[1:]
        if t == "a":
            return RDF + "type"
        if t[0] == "<":
            return t[1:-1] if ":" in t else base + t[1:-1]
        if t[0] in "\"'":
            return re.match(r"[\"'](.*)[\"']", t)[1]
        if ":" in t:
            p, _, n = t.partition(":")
            if p not in prefixes:
                raise SparqlError(f"prefix {p} is not declared")
            return prefixes[p] + n
        return t

    while at < len(tokens) and tokens[at].upper() in ("PREFIX", "BASE"):
        if take().upper() == "PREFIX":
            name = take()
            prefixes[name.rstrip(":")] = take()[1:-1]
        else:
            base = take()[1:-1]
    if take().upper() != "SELECT":
        raise SparqlError("SELECT is missing")
    vars_: list[str] = []
    while at < len(tokens) and (tokens[at][0] in "?$" or tokens[at] == "*"):
        t = take()
        if t != "*":
            vars_.append(t[1:])
    if at < len(tokens) and tokens[at].upper() == "WHERE":
        at += 1
    patterns: list[tuple[str, str, str]] = []
    if at < len(tokens):
        if take() != "{":
            raise SparqlError("{ is missing")
        while tokens[at] != "}":
            s = term(take())
            while True:
                p = term(take())
                while True:
                    patterns.append((s, p, term(take())))
                    if tokens[at] != ",":
                        break
                    at += 1
                if tokens[at] != ";":
                    break
                at += 1
            if tokens[at] == ".":
                at += 1
    return Query(vars_, patterns)


def match(t: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """Bindings of one pattern: a column for each variable; a variable that repeats must have one value."""
    cond, cols = F.lit(True), {}
    for col, x in zip(("s", "p", "o"), pattern, strict=True):
        if x.startswith("?"):
            if x[1:] in cols:
                cond &= F.col(col) == F.col(cols[x[1:]])
            else:
                cols[x[1:]] = col
        else:
            cond &= F.col(col) == F.lit(x)
    return t.where(cond).select(*[F.col(c).alias(v) for v, c in cols.items()])


def bindings(t: DataFrame, q: Query | str) -> DataFrame:
    """(var, value): for each variable its bindings over all patterns, each pattern by itself (patterns are not joined)."""
    q = parse(q) if isinstance(q, str) else q
    out = None
    for p in q.patterns:
        found = match(t, p)
        for v in found.columns:
            if not q.vars or v in q.vars:
                part = found.select(F.lit(v).alias("var"), F.col(v).alias("value"))
                out = part if out is None else out.union(part)
    return t.sparkSession.createDataFrame([], "var string, value string") if out is None else out


def select(t: DataFrame, q: Query | str) -> DataFrame:
    """Solutions with the patterns joined on their common variables, as SPARQL means it."""
    q = parse(q) if isinstance(q, str) else q
    out = None
    for p in q.patterns:
        found = match(t, p)
        shared = [] if out is None else [c for c in found.columns if c in out.columns]
        if out is not None and not shared:
            raise SparqlError("patterns without a common variable")
        out = found if out is None else out.join(found, shared)
    if out is None:
        raise SparqlError("no pattern")
    return out.select(*q.vars) if q.vars else out
