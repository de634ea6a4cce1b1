"""Stylesheets on wide documents: patterns are read from the node, calls at a template's end are loops."""

import random

import pytest

from sylva import model
from sylva.operators import xslt
from sylva.plans import xpath as X
from sylva.sources.xml import parse_xml

HEAD = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform">'


def run(source, body):
    tree, _ = parse_xml(source)
    return xslt.transform(tree, xslt.compile_stylesheet(f"{HEAD}{body}</xsl:stylesheet>")).text()


SUM = """<xsl:template match="/"><xsl:call-template name="sum"><xsl:with-param name="n" select="//b"/></xsl:call-template></xsl:template>
  <xsl:template name="sum"><xsl:param name="n"/><xsl:param name="t" select="0"/><xsl:choose><xsl:when test="$n"><xsl:call-template name="sum"><xsl:with-param name="n" select="$n[position() &gt; 1]"/>
  <xsl:with-param name="t" select="$t + $n[1]"/></xsl:call-template></xsl:when><xsl:otherwise><xsl:value-of select="$t"/></xsl:otherwise></xsl:choose></xsl:template>"""


def test_a_template_that_calls_itself_at_its_end():
    for n in (0, 1, 2, 5000):
        assert run("<a>" + "".join(f"<b>{k}</b>" for k in range(n)) + "</a>", SUM) == str(n * (n - 1) // 2)


def test_tail_calls_keep_order_and_scope():
    body = """<xsl:template match="/"><xsl:variable name="v" select="1"/>[<xsl:if test="$v"><xsl:variable name="v" select="2"/>(<xsl:call-template name="t"><xsl:with-param name="p" select="$v"/></xsl:call-template></xsl:if></xsl:template>
      <xsl:template name="t"><xsl:param name="p"/><xsl:param name="q" select="7"/><xsl:value-of select="concat($p, $q)"/><xsl:if test="$p &lt; 4"><xsl:call-template name="t"><xsl:with-param name="p" select="$p + 1"/></xsl:call-template></xsl:if></xsl:template>"""
    assert run("<a/>", body) == "[(273747"


@pytest.mark.parametrize("call", ['<xsl:call-template name="b"/>', '<xsl:call-template name="b"/>x'])
def test_calls_without_end(call):
    body = f'<xsl:template match="/"><xsl:call-template name="a"/></xsl:template><xsl:template name="a">{call}</xsl:template><xsl:template name="b"><xsl:call-template name="a"/></xsl:template>'
    with pytest.raises(xslt.XsltError, match="without end"):
        run("<a/>", body)


@pytest.mark.parametrize(
    "body",
    [
        '<xsl:template match="/"><xsl:apply-templates select="//c"/></xsl:template><xsl:template match="c">c</xsl:template><xsl:template match="g/c[b &lt; 0]">n</xsl:template>',
        '<xsl:key name="k" match="c" use="../@n"/><xsl:template match="/"><xsl:value-of select="count(key(\'k\', \'x\'))"/></xsl:template>',
    ],
)
def test_wide_documents_cost_by_their_nodes(monkeypatch, body):
    """The nodes read for patterns grow with the document, not with its square."""
    read, axis = [0], X.axis_nodes

    def counted(n, name):
        found = axis(n, name)
        read[0] += len(found)
        return found

    monkeypatch.setattr(X, "axis_nodes", counted)
    run('<a><g n="x">' + "<c><b>-1</b></c>" * 500 + "</g></a>", body)
    assert read[0] < 20 * 1500


def by_selection(n, e, c):
    """A pattern's meaning: some ancestor, or the node itself, selects the node."""
    up = n
    while up is not None:
        if any(x is n or X.order(x) == X.order(n) and x.kind == n.kind for x in X.evaluate(e, c.at(up))):
            return True
        up = up.up
    return False


def test_patterns():
    rng = random.Random(5)
    top = model.elem("r")
    made = [top]
    for k in range(60):
        made.append(model.elem(rng.choice("ab"), {"k": str(k % 3)}, *["t"] * (k % 2)))
        rng.choice(made[:-1]).children.append(made[-1])
    tree = model.link(model.root(top))
    c = X.Context(tree)
    nodes = list(tree.walk())
    nodes += [a for n in nodes if n.kind == "element" for a in X.axis_nodes(n, "attribute")]
    for p in ("a", "*", "a/b", "/r/a", "//b", "a//b", "/r//a/b", "@k", "a/@k", "a[b]", "a[@k = 1]/b", "b[not(a)]", "a[1]", "b[last()]", "text()", "a/text()", "node()", "a[count(b) > 1]", "/", "a[.//b]", "a[2][b]"):
        e = X.parse(p)
        want = [e == ("path", "/", []) and n.kind == "root" or by_selection(n, e, c) if p != "/" else n.kind == "root" for n in nodes]
        assert [xslt.matches(n, e, c) for n in nodes] == want, p


def test_steps_down_and_cuts():
    tree, _ = parse_xml("<r><a><a>1</a><b/></a><a>2</a><c><a>3</a></c></r>")
    model.link(tree)
    got = lambda s: [n.text() for n in X.select(tree, s)]
    assert got("//a[1]") == ["1", "1", "3"] and got("(//a)[1]") == ["1"] and got("(//a)[position() > 1]") == ["1", "2", "3"]
    assert got("(//a)[position() > 1][position() >= 2][last()]") == ["3"] and got("(//a)[9]") == got("(//a)[0.5]") == []
    assert got("//a[b]") == ["1"] and X.select(tree, "count((//a)[2 < position()] | //b)") == 3.0
