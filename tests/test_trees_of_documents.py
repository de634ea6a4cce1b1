"""Work on whole trees: documents are parsed where they lie, one at a time; results come in batches of many documents."""

from sylva import model
from sylva.operators import arrows as A
from sylva.plans import xpath as X
from sylva.sources.documents import map_trees, rewrite, shred
from sylva.sources.serialize import to_xml

TEXTS = ['<a k="1"><b>x</b><!-- c --><?p q?>t &amp; u<c d="2"/></a>', "<a><b></a>", "<!DOCTYPE a [<!ELEMENT a ANY>]><a/>", None, "<a>\r\n<![CDATA[<]]></a>"]


def test_as_by_rows(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (7, "<a/>")], "doc_id long, text string")
    nodes = shred(docs)
    rows = nodes.select("*")  # knows nothing of the documents
    show = lambda i, t: [(i, str([(n.at, n.kind, n.name, n.value, n.attrs, n.up and n.up.at) for n in t.walk()]), to_xml(t))]
    by = [sorted(map(str, map_trees(x, show, "doc_id long, tree string, text string").collect())) for x in (nodes, rows)]
    assert by[0] == by[1] and len(by[0]) == 6
    f = lambda t: [t, model.root()]
    assert sorted(map(str, rewrite(nodes, f).collect())) == sorted(map(str, rewrite(rows, f).collect())) == sorted(map(str, nodes.collect()))


def test_no_nodes_are_gathered_in_lists(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    plan = X.xpath(shred(docs), "count(//b)")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("MapInArrow") == 1


def test_top_down():
    f = A.process_top_down(A.when(A.none, A.is_a(lambda n: n.name == "b")) >> A.when(A.arr(lambda n: model.elem("z", {}, *n.children)), A.is_a(lambda n: n.name == "c")))
    assert to_xml(f(model.elem("a", {}, model.elem("b"), model.elem("c", {}, "t", model.elem("b"), model.elem("c"))))[0]) == "<a><z>t<z/></z></a>"


def test_rewriting_gathers_no_nodes(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    plan = rewrite(shred(docs), lambda t: [t])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 1


def test_top_down_makes_no_arrows_for_nodes(monkeypatch):
    made, init = [0], A.Arrow.__init__

    def counted(self, run):
        made[0] += 1
        init(self, run)

    f = A.process_top_down(A.this)
    monkeypatch.setattr(A.Arrow, "__init__", counted)
    f(model.elem("a", {}, *[model.elem("b", {}, "t") for _ in range(50)]))
    assert made[0] == 0
