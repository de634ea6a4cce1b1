"""Node tables: the direct XML rows against the rows of the canonical tree, and stored tables."""

import pytest

from sylva import model
from sylva.operators import xslt
from sylva.sources import documents, xml

DOCUMENTS = [
    "<a/>",
    '<a x="1" b:y="2"><b:c>t<!--c-->u<![CDATA[v<]]>w</b:c><?pi da ta?>x &amp; y&#65;<d> </d></a>',
    '<?xml version="1.0"?>\n<?p q?><!--z--><a>\n <b/>\n</a>\n<?r?>',
    "<a>" + "x" * 100_000 + "é&lt;" * 50 + "</a>",
    "<a>\r\nx\r</a>",
    "<a><![CDATA[]]></a>",
    "<a>1<?p?>2<!----></a>",
]


@pytest.mark.parametrize("source", DOCUMENTS)
def test_direct_rows(source):
    tree, problems = documents.parse(source, documents.ReadOptions())
    assert not problems
    assert xml.xml_rows(7, documents.normalize_newlines(source)) == [list(r) for r in model.rows(7, tree)]


@pytest.mark.parametrize("source", ["", "<a><b></a>", "<!DOCTYPE a><a/>"])
def test_left_to_the_tree(source):
    assert xml.xml_rows(7, source) is None


def test_shred_and_store(spark):
    docs = spark.createDataFrame([(1, "<a><b>x</b></a>"), (2, "<a><b></a>"), (None, None)], "doc_id long, text string")
    nodes = documents.shred(docs)
    kept = documents.store(nodes)
    key = lambda rows: sorted(map(str, rows))
    assert key(kept.collect()) == key(nodes.collect())
    assert {(r["doc_id"], r["level"]) for r in documents.status(kept).collect()} == {(1, 0), (2, 3), (None, 3)}
    assert documents.store(documents.shred(docs.limit(0))).collect() == []


def test_serialized_by_spark_as_by_trees(spark):
    from sylva.sources.documents import map_trees, serialize, shred
    from sylva.sources.serialize import to_xml

    texts = [
        "<a/>",
        '<a k="&lt;&amp;&quot;x&#10;y\'">t &lt; u &amp; v<b><c/><c>x</c></b><!-- c --><?p q?><?r?><![CDATA[<z>]]></a>',
        "<!DOCTYPE a [<!ELEMENT a ANY>]><a><b><c><d/></c></b><b/>tail</a>",
        "<x:a xmlns:x='urn:x'><x:b>é\n </x:b></x:a>",
        "no xml",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for canonicalize in (True, False):
        nodes = shred(docs, canonicalize=canonicalize)
        for no_empty in (False, True, frozenset("c")):
            want = map_trees(nodes, lambda i, t, n=no_empty: [(i, to_xml(t, "xml", n))], "doc_id long, text string")
            got = serialize(nodes, xml_pi=False, no_empty=no_empty)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Python" not in serialize(nodes)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_stylesheet_keys():
    """key() finds what xsl:key names, in templates and global variables, also by a node set; a name without nodes finds nothing."""
    head = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:key name="k" match="c" use="../@n"/><xsl:variable name="v" select="count(key(\'k\', \'y\'))"/>'
    body = '<xsl:template match="/"><xsl:value-of select="concat(count(key(\'k\', \'x\')), \'/\', $v, \'/\', count(key(\'k\', //w)), \'/\', count(key(\'k\', \'z\')), \'/\', count(key(\'none\', \'x\')))"/></xsl:template></xsl:stylesheet>'
    sheet = xslt.compile_stylesheet(head + body)
    for source, want in (('<a><g n="x"><c/><c/><d/></g><g n="y"><c/></g><w>x</w><w>y</w></a>', "2/1/3/0/0"), ("<a/>", "0/0/0/0/0")):
        tree, _ = documents.parse(source, documents.ReadOptions())
        assert xslt.transform(tree, sheet).text() == want
