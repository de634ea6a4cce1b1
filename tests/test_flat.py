"""Columns of a batch of documents against rows and trees, and location paths on them against paths on trees."""

import random

import numpy as np
import pytest

from sylva import model
from sylva.plans import xpath as X
from sylva.plans import xpath_flat, xpath_plan
from sylva.sources import documents, flat
from sylva.sources.serialize import to_xml


def grown(rng, n):
    top = model.elem("r")
    made = [top]
    for k in range(n):
        up = made[-1] if rng.random() < 0.4 else rng.choice(made)
        made.append(model.elem(rng.choice(["a", "b", "x:c"]), {"k": str(k), **({"m": str(k % 4)} if k % 3 else {})}, *[str(rng.randint(0, 20))] * (rng.random() < 0.5)))
        up.children.append(made[-1])
    return to_xml(top)


RNG = random.Random(3)
TEXTS = [grown(RNG, n) for n in (1, 5, 30, 80, 80)]
TEXTS += ["<a>&lt;<!-- c -->2</a>", "<a><b></a>", None, " <r>\n<a/> <?p q?></r>\n", "<a/><b/>", "<a>x > y</a>", "<a k='1' k='2'/>", '<a b="x\ny"/>', "x<a/>", "", "<a>]]></a>", "<é/>", "<a b='>'/>", "<a", "<1/>", "<a>" * 70 + "</a>" * 70]
OPTIONS = documents.ReadOptions()


@pytest.fixture(scope="module")
def read():
    return flat.read(list(range(len(TEXTS))), TEXTS, flat.Tags(), lambda i, t: documents._rows(i, t, OPTIONS))


def attrs_in_order(rows):
    return [tuple(sorted(x) if isinstance(x, list) else x for x in r) for r in rows]


def test_rows(read):
    got = {}
    for f in read:
        for r in f.rows(np.arange(f.n)).to_pylist():
            got.setdefault(r["doc_id"], []).append(tuple(r.values()))
    for i, t in enumerate(TEXTS):
        want = [(*r[:-1], list(r[-1].items()) if r[-1] else None) for r in documents._rows(i, t, OPTIONS)]
        assert attrs_in_order(got[i]) == attrs_in_order(want)


PATHS = [
    "//a//b", "//a/ancestor::b", "/r/*/b[2]", "//b[a]/following-sibling::*", "//a[.//b][1]/@k", "//a/../b", "//a[@m = 1]/@k", "//b[. > 9]/..", "//a[b = x:c]", "//*[not(@m)]", "/r/*[position() > 1 and position() < 4]/@k", "/r/a[last()]",
    "//a[@m='2' or b < 5]/@*", "//*[count(a) > 1]/@k", "//*[preceding-sibling::a][1]", "//a[@m = '1'][1]/@k", "//text()", "//b[contains(., '1')]", "//a | //b[2]", "//a/@k | //b/@k", "//a[ancestor::b]/preceding-sibling::*[1]", "//a[a != b]", "/",
    "//x:*", "//a[position() mod 2 = 1]", "//a/self::a/child::node()", "//*[b/@k < 30]/@k", "/*", "//a[5 > b]", "/r/descendant::a[3]",
]


@pytest.mark.parametrize("path", PATHS)
def test_paths(read, path):
    e = X.parse(path)
    got, want = [], []
    for f in read:
        got += [(r["doc_id"], r["pre"], r["sib"] if r["kind"] == "attr" else -1, r["name"], dict(r["attrs"] or []).get("k", r["value"])) for r in xpath_flat.Paths(f).select(e).to_pylist()]
    for i, t in enumerate(TEXTS):
        for n in X.evaluate(e, X.Context(documents._tree(t, None, OPTIONS, True))):
            own = n.up if n.kind == "attr" else n
            want.append((i, own.at, sorted(own.attrs).index(n.name) if n.kind == "attr" else -1, n.name, n.attrs.get("k", n.value)))
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("path", ["//a[b > 3]/../@k", "//a/@k | //b/@k", "//a[@m = '1'][1]", "//a[a < b]", "//a/following::b"])
def test_as_by_joins(spark, path):
    nodes = documents.shred(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    ways = [xpath_plan.compile(x, path) for x in (nodes, nodes.select("*"))]
    key = lambda df: sorted(str((r["doc_id"], r["node_id"], r["pre"], r["size"], r["level"], r["parent_id"], r["sib"], r["kind"], r["prefix"], r["local"], r["name"], r["value"], sorted((r["attrs"] or {}).items()))) for r in df.collect())
    assert key(ways[0]) == key(ways[1])
    assert ("Join" in ways[0]._jdf.queryExecution().optimizedPlan().toString()) == ("following::" in path)


def test_count_without_nodes(spark):
    nodes = documents.shred(spark.createDataFrame([(1, "<a><b/><b/></a>"), (2, "<a/>"), (3, "<a>")], "doc_id long, text string"))
    assert sorted(map(tuple, xpath_plan.count(nodes, "//b").collect())) == [(1, 2), (2, 0), (3, 0)]
